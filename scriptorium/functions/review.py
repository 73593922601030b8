"""A raw text beside its candidate: what their words say, in one pass over each pair.

The rules are those of ``text`` and ``align``; each row is a pair, so the work is bounded by its texts.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RulePack
from .align import matching_runs
from .text import LINE_ENDS, THOUSANDS, _fold_table, _loop_words, _loops

_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(rf"\d+(?:{THOUSANDS}\d{{3}})*(?:[.,]\d+)?")
_GAP = re.compile(THOUSANDS)
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}")
_LINES = re.compile(LINE_ENDS)
#: What Unicode calls white space, the ``\s`` of the column rules.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

_LONGS = ("words_raw", "words_candidate", "added", "longest_added")
_DOUBLES = ("altered_numbers", "altered_acronyms", "opening_support")
_FLAGS = ("loop_introduced", "language_leak")


@lru_cache(maxsize=1)
def _plain_table() -> tuple[dict[str, str], frozenset]:
    """Letters with their plain ones, and those that must be made plain before words are cut and lowered."""
    source, target, many = _fold_table()
    plain = dict(zip(source, target)) | dict.fromkeys(source[len(target) :], "") | dict(many)
    cuts = lambda x: not x or not all(ch.isalnum() for ch in x)
    flat = lambda x: "".join([plain.get(ch, ch) for ch in x])
    early = [c for c, p in plain.items() if not p or cuts(c) != cuts(p) or flat(c.lower()) != p.lower()]
    # a capital sigma is lowered by what stands beside it
    return plain, frozenset("σς").union(*early, *(c.lower() for c in early)).difference(map(chr, range(128)))


_ASCII = bytes(range(128))
_GAPS = bytes(i if chr(i).isalnum() or i == 95 or i > 127 else 32 for i in range(256))


def _odd(text: str) -> set[str]:
    """The characters beyond ASCII."""
    return set(text.encode().translate(None, _ASCII).decode())


def words(text: str, odd: set[str] | None = None) -> list[str]:
    """Runs of letters, digits and underscores; ``odd`` are the characters beyond ASCII, if known."""
    if not text.isascii():
        for ch in _odd(text) if odd is None else odd:
            if not ch.isalnum():
                text = text.replace(ch, " ")
    return text.encode().translate(_GAPS).decode().split()


def _folded(text: str, odd: set[str]) -> str:
    plain, _ = _plain_table()
    for ch in odd:
        if ch in plain:
            text = text.replace(ch, plain[ch])
    return text


def compared(text: str) -> list[str]:
    """Lower-case words without accents."""
    return words((text if text.isascii() else _folded(text, _odd(text))).lower())


def _read(text: str, low: str) -> tuple[list[str], list[str], list[str], str]:
    """Lower-case words, words to compare, and words lowered one by one, these joined as well."""
    if low.isascii() and text.isascii():
        own = words(low)
        return own, own, own, " ".join(own)
    odd = _odd(low)
    own = words(low, odd)
    if not _plain_table()[1].isdisjoint(odd):  # folding moves the borders of words, or lowering does
        apart = [w.lower() for w in words(text)]
        return own, compared(text), apart, " ".join(apart)
    joined = " ".join(own)
    return own, own if joined.isascii() else _folded(joined, odd).split(" "), own, joined


def numbers(text: str) -> list[str]:
    if not _DIGIT.search(text):
        return []
    return [_GAP.sub("", n).replace(",", ".").rstrip(".") for n in _NUMBER.findall(text)]


def acronyms(text: str) -> list[str]:
    """Runs of capitals; part of a longer word or of one with a hyphen is none."""
    inside = lambda ch: ch == "-" or ch == "_" or ch.isalnum()
    # as the column rule, which looks back by one 16-bit character and takes half of a rare letter for none
    return [
        m.group() for m in _CAPITALS.finditer(text)
        if not (m.start() and text[m.start() - 1] <= "\uffff" and inside(text[m.start() - 1])) and not (m.end() < len(text) and inside(text[m.end()]))
    ]


def missing_share(left: list[str], right: list[str]) -> float:
    """Share of the left bag that the right bag does not cover."""
    return sum([max(left.count(x) - right.count(x), 0) for x in set(left)]) / len(left) if left else 0.0


def added_words(a: list[str], b: list[str], x: str, y: str) -> tuple[int, int]:
    """Words of ``b`` outside the matching runs, and the longest row of them; ``x`` and ``y`` are both lists joined by blanks."""
    if a == b or not b:
        return 0, 0
    if not a:
        return len(b), len(b)
    x, y = f" {x} ", f" {y} "
    at = y.find(x)
    if at >= 0:  # one run, at the first place that holds all of it
        before = y.count(" ", 0, at)
        return len(b) - len(a), max(before, len(b) - len(a) - before)
    if y in x:
        return 0, 0
    if a[: len(b) - 1] == b[:-1]:  # no run is longer and none begins before; the last word may stand behind it
        return (0, 0) if b[-1] in a[len(b) - 1 :] else (1, 1)
    gaps, upto = [], 0
    for _, j, size in [*matching_runs(a, b), (len(a), len(b), 0)]:
        gaps.append(j - upto)
        upto = j + size
    return sum(gaps), max(gaps)


def best_share(flags: list[bool], window: int) -> float:
    """Largest share of ones over every window; there is one window at least."""
    run = best = sum(flags[:window])
    for leaves, comes in zip(flags, flags[window:]):
        run += comes - leaves
        if run > best:
            best = run
    return best / window


def _foreign_part(f: int, n: int, size: int) -> bool:
    return f >= 4 and f / size >= 0.30 and f > n


def leaks(raw: list[str], candidate: list[str], native: frozenset, foreign: Counter) -> bool:
    """Foreign function words introduced by the candidate, whole or in a 12-word window."""
    found = [w for w in candidate if w in foreign]
    if not found or len(candidate) < 8 or sum([foreign[m] * max(found.count(m) - raw.count(m), 0) for m in set(found)]) < 4:
        return False
    if sum([w in native for w in raw]) < 2:
        return False
    f, n = [w in foreign for w in candidate], [w in native for w in candidate]
    if _foreign_part(sum(f), sum(n), len(f)):
        return True
    return any(_foreign_part(sum(f[i : i + 12]), sum(n[i : i + 12]), 12) for i in range(len(f) - 11))


def opening_share(known: set, candidate: str) -> float | None:
    """Share of known words in the first line, when more than one line is filled."""
    if candidate.isprintable():  # no line ends
        return None
    lines = [x for x in _LINES.split(candidate) if x.strip(_WHITE)]
    if len(lines) < 2:
        return None
    first = compared(lines[0])
    return sum([w in known for w in first]) / len(first) if len(first) >= 4 else None


def _pass(pack: RulePack, windows: tuple[int, ...], aligned: bool):
    """The rules of a pair as one function: raw, candidate to the columns of ``reviewed`` in order."""
    native, foreign = frozenset(pack.native_markers), Counter(pack.foreign_markers)

    def one(raw: str, cand: str):
        kept = raw == cand  # an unchanged text adds, loses and introduces nothing
        low = raw.lower()
        rt, rw, ra, rj = _read(raw, low)
        added, numbers_gone, capitals_gone, loop, leak = (0, 0), 0.0, 0.0, False, False
        if kept:
            ct, cw = rt, rw
        else:
            lowered = cand.lower()
            ct, cw, ca, cj = _read(cand, lowered)
            if aligned:
                added = added_words(ra, ca, rj, cj)
            if left := numbers(raw):
                numbers_gone = missing_share(left, numbers(cand))
            if left := acronyms(raw):
                capitals_gone = missing_share(left, acronyms(cand))
            loop = _loops(_loop_words(lowered)) and not _loops(_loop_words(low))
            leak = leaks(rt, ct, native, foreign)
        opening, shares = None, [None] * len(windows)
        if len(rw) >= 8 and len(cw) >= 8:
            known = set(rw)
            opening = opening_share(known, cand)
            flags = [] if kept else [w in known for w in cw]
            whole = all(flags)
            fits = min(len(rw), len(cw))
            shares = [None if fits < w else 1.0 if whole else best_share(flags, w) for w in windows]
        return (len(rt), len(ct), *added, numbers_gone, capitals_gone, opening, loop, leak, *shares)

    return one


def reviewed(raw: Column | str, candidate: Column | str, pack: RulePack, windows: tuple[int, ...], aligned: bool = True) -> Column:
    """Struct of what the words of two texts, neither null, say about each other.

    words_raw, words_candidate, the shares altered_numbers and altered_acronyms, loop_introduced,
    language_leak, opening_support, support_<window>, and, if ``aligned``, added and longest_added.
    Shares are not rounded. Not deterministic by name only, as ``align``: a filter on what follows
    stays above it.
    """
    doubles = (*_DOUBLES, *(f"support_{w}" for w in windows))
    names = (*_LONGS, *_DOUBLES, *_FLAGS, *doubles[len(_DOUBLES) :])
    kind = lambda n: (T.LongType(), pa.int64()) if n in _LONGS else (T.BooleanType(), pa.bool_()) if n in _FLAGS else (T.DoubleType(), pa.float64())
    one = _pass(pack, windows, aligned)

    def batch(raws: pa.Array, candidates: pa.Array) -> pa.Array:
        rows = [one(r, c) for r, c in zip(raws.to_pylist(), candidates.to_pylist())]
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, kind(n)[1]) for n, c in zip(names, columns)], list(names))

    batch.__name__ = "_aligned" if aligned else "_compared"  # what plans call it
    udf = F.arrow_udf(batch, T.StructType([T.StructField(n, kind(n)[0]) for n in names])).asNondeterministic()
    return udf(raw, candidate)


BESIDE = T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("new", T.BooleanType())]))


@F.arrow_udf(BESIDE)
def words_beside(raw: pa.Array, candidate: pa.Array) -> pa.Array:
    """The words of a candidate to compare, each once, and whether the raw text lacks them; neither is null."""
    offsets, found, new = [0], [], []
    for r, c in zip(raw.to_pylist(), candidate.to_pylist()):
        known, own = set(compared(r)), dict.fromkeys(compared(c))
        found += own
        new += [w not in known for w in own]
        offsets.append(len(found))
    pairs = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(new, pa.bool_())], ["w", "new"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


@F.arrow_udf(T.StringType())
def padded_words(text: pa.Array) -> pa.Array:
    """The words of a text to compare, joined by blanks, with one before and one behind; the text is not null."""
    return pa.array([f" {' '.join(compared(t))} " for t in text.to_pylist()], pa.string())
