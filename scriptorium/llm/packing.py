"""Tokens of transcripts in training sequences of a fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .tokens import slices, word_encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class OpenBins:
    """Best fit over a fixed number of open bins.

    Bit ``f`` of ``free`` is set while an open bin has ``f`` places left, so the best fit
    for ``n`` is the lowest bit from ``n`` on. A full bin closes; if none fits and all
    are open, the fullest, which is the lowest bit, closes for a new one.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free, self.at, self.open, self.made = 0, {}, 0, 0

    def _take(self, room: int) -> int:
        names = self.at[room]
        name = names.pop()
        if not names:
            del self.at[room]
            self.free ^= 1 << room
        return name

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the place in it."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            name = self._take(room)
        else:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            room, name = self.capacity, self.made
            self.made, self.open = self.made + 1, self.open + 1
        left = room - length
        if left:
            self.at.setdefault(left, []).append(name)
            self.free |= 1 << left
        else:
            self.open -= 1
        return name, self.capacity - room


def cut_transcripts(
    jobs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "raw_text", end_id: int = 1, capacity: int = 4096, with_ids: bool = True,
) -> DataFrame:
    """The ids of each transcript and ``end_id``, in pieces of ``capacity``: doc_id, piece, start, length, ids_crc32 and, ``with_ids``, ids.

    Only a longer transcript has more than one piece. A null text counts as empty and is
    one piece with the end id alone. A repeated row is a transcript of its own.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encode = word_encoder(tokenizer).encode
        for batch in slices(batches):
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(value or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")[: len(rows[0])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))

    return jobs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("raw_text")).mapInArrow(cut, f"{PIECES}, ids binary" if with_ids else PIECES)


def pack_pieces(pieces: DataFrame, *, length: str = "length", capacity: int = 4096, open_bins: int = 64, sequences_each: int = 2048) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: best fit into sequences of ``capacity`` tokens.

    Pieces are dealt evenly to packers of about ``sequences_each`` full sequences, which
    share nothing; a packer remembers only its ``open_bins`` open bins. The pieces should
    be checkpointed, as their lengths are summed first. No piece may exceed ``capacity``.
    """
    total = pieces.agg(F.sum(length)).first()[0] or 0
    packers = max(1, round(total / (capacity * sequences_each)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(batches):
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(length).to_pylist()]
            found = np.array(placed, np.int64).reshape(-1, 2)
            yield batch.append_column("sequence_id", pa.array(found[:, 0] + base)).append_column("offset", pa.array(found[:, 1].copy()))

    return pieces.repartition(packers).mapInArrow(pack, schema)


def pack_transcripts(
    jobs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "raw_text", end_id: int = 1, capacity: int = 4096, open_bins: int = 64,
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    See ``cut_transcripts`` for nulls, empty texts and repeats. Only lengths and
    checksums are shuffled; ``cut_transcripts`` gives the ids of a piece.
    """
    pieces = cut_transcripts(jobs, tokenizer, doc_id=doc_id, text=text, end_id=end_id, capacity=capacity, with_ids=False)
    return pack_pieces(checkpointed(pieces), capacity=capacity, open_bins=open_bins)
