"""Ids and text of transcripts through chunks that documents share."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordEncoder, slices, word_encoder

WINDOW = 32


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """A fixed random 64-bit number for each byte."""
    return np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


def cut_points(data: bytes, mean: int = 256, least: int = 64, most: int = 4096) -> list[int]:
    """Ends of content-defined chunks: where the rolling hash of the last 32 bytes has enough leading zeros.

    A cut depends on the bytes before it alone, so equal passages get equal chunks. Chunks
    have ``least`` to ``most`` bytes, and no cut falls inside a code point.
    """
    raw = np.frombuffer(data, np.uint8)
    rolled, step = _gear()[raw], 1
    while step < WINDOW:  # doubles the window: hash of 2s bytes from two hashes of s bytes
        older = rolled[:-step] << np.uint64(step)
        rolled = rolled.copy()
        rolled[step:] += older
        step *= 2
    hits = np.flatnonzero(rolled < np.uint64((1 << 64) // mean)) + 1
    cuts, last = [], 0
    for hit in [*hits.tolist(), len(data)]:
        while hit - last > most:
            last = _border(data, last + most)
            cuts.append(last)
        hit = _border(data, hit)
        if hit - last >= least and hit < len(data):
            cuts.append(hit)
            last = hit
    return [*cuts, len(data)] if not cuts or cuts[-1] < len(data) else cuts


def _border(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


class ChunkEncoder:
    """Encodes each distinct chunk once, joins chunks, and repairs the joins.

    At most ``room`` bytes of chunks and ids are kept; when they are full, they are dropped
    and gathered anew.
    """

    def __init__(self, words: WordEncoder, room: int = 32 << 20):
        self.words, self.room = words, room
        self.kept: dict[bytes, bytes] = {}
        self.held = self.reused = 0

    def chunk(self, data: bytes) -> bytes:
        ids = self.kept.get(data)
        if ids is not None:
            self.reused += 1
            return ids
        ids = self.words.encode(data.decode())
        self.held += len(data) + len(ids) + 200
        if self.held > self.room:
            self.kept, self.held = {}, 0
        self.kept[data] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, as of ``WordEncoder.encode``."""
        data = text.encode()
        if self.words.kind != "words" or len(data) < 128:  # elsewhere a space is part of the next word
            return self.words.encode(text)
        cuts = cut_points(data)
        repairs: list[tuple[int, int, bytes]] = []
        for cut in cuts[:-1]:
            if not repairs or cut >= repairs[-1][1]:
                self._repair(data, cut, repairs)
        encode, out, start, resume = self.words.encode, [], 0, 0
        repairs.reverse()
        for cut in cuts:
            ids, head, tail = self.chunk(data[start:cut]), max(start, min(resume, cut)), cut
            fixed = b""
            if repairs and repairs[-1][0] < cut:
                tail, resume, fixed = repairs.pop()
            if head >= tail:
                ids = b""
            else:  # what lies in a repair goes; its borders are plain spaces, so the rest stands
                ids = ids[len(encode(data[start:head].decode())) : len(ids) - len(encode(data[tail:cut].decode()))]
            out += (ids, fixed)
            start = cut
        return b"".join(out)

    def _repair(self, data: bytes, cut: int, repairs: list[tuple[int, int, bytes]]) -> None:
        """Encodes again around a join, one more word on each side each time, until both sides agree with their neighbours."""
        left, right = data.rfind(b" ", 0, cut) + 1, data.find(b" ", cut)
        right = len(data) if right < 0 else right
        if left == cut or right == cut:
            return
        encode = self.words.encode
        while True:
            middle = encode(data[left:right].decode())
            before, after = data.rfind(b" ", 0, max(0, left - 1)) + 1, data.find(b" ", min(right + 1, len(data)))
            after = len(data) if after < 0 else after
            around = encode(data[before:left].decode()) + middle + encode(data[right:after].decode())
            if around == encode(data[before:after].decode()) or (before, after) == (left, right):
                break
            left, right = before, after
            while repairs and repairs[-1][1] > left:
                left = min(left, repairs.pop()[0])
        repairs.append((left, right, middle))


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(word_encoder(path))


def encode_transcripts(jobs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "raw_text") -> DataFrame:
    """doc_id, ids (array of int), decoded: one row a job.

    The ids of the whole transcript are those of the library's ``encode`` without special
    tokens added, ``decoded`` is its ``decode`` of them with none skipped. A null text counts
    as empty; a repeated row gives a repeated result. Chunks are shared among all documents
    that a worker process meets; its memory of them is bounded.
    """

    def run(batches):
        coder = chunk_encoder(tokenizer)
        library = coder.words.tokenizer
        for batch in slices(batches):
            ids = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
            decoded = [library.decode(array("I", i).tolist(), skip_special_tokens=False) for i in ids]
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return jobs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("raw_text")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256."""

    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
