"""Ids of a public tokenizer for transcript texts, found piece by piece.

A tokenizer of the ``tokenizers`` library never joins characters across the borders
that its pre-tokenizer sets. A text of plain letters, digits and signs is cut at those
borders, and each piece's ids come from the library's model once and are kept. Any
other text is cut at plain spaces first, and a word with other characters goes through
the whole tokenizer. The ids equal those of ``encode`` on the whole text.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = r"!-&(-/:-@\[-`{-~"  # ASCII signs but the apostrophe, which may start a contraction
_OTHER = re.compile(rf"[^{_LETTERS}0-9{_SIGNS}\n ]")
_WORD_PIECES = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")
_BYTE_PIECES = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\s+(?!\S)|\s+")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo(dict):
    """Makes a missing value; keeps it while there is room, so memory has a bound."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.room:
            self[key] = value
        return value


class WordEncoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers.

    ``room`` bounds the number of pieces that are kept, and a quarter of it the number of
    words with other characters; what does not fit is encoded again when it comes again.
    """

    def __init__(self, path: str, room: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        normal, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        steps = [s.get("type") for s in (normal or {}).get("normalizers", [])]
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normal is None:
            self.kind, self.cut = "bytes", _BYTE_PIECES.findall
        elif steps == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence":
            self.kind, self.cut = "words", lambda text: _WORD_PIECES.findall(text.lower())
        else:
            self.kind = "other"
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in _byte_letters().items() if chr(b) != c}
        self.pieces = _Memo(self._piece, room)
        self.words = _Memo(self._word, room // 4)

    def whole(self, text: str) -> bytes:
        """The ids by the library's own ``encode``."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() or piece[0] in " \n":
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def _word(self, word: str) -> bytes:
        plain = _OTHER.search(word) is None and "<|" not in word
        return self._plain(word) if plain else self.whole(word)

    def encode(self, text: str) -> bytes:
        if self.kind == "other":
            return self.whole(text)
        if _OTHER.search(text) is None and "<|" not in text:
            return self._plain(text)
        if self.kind == "words":
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        first, *rest = _LONE_SPACE.split(text)
        return b"".join(map(self.words.__getitem__, [first, *[" " + w for w in rest]]))


def slices(batches, rows: int = 500):
    """Arrow batches in parts of at most ``rows`` rows, so that ids and texts of few documents are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and worker process."""
    return WordEncoder(path)
