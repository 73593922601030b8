"""Greedy grouping along a document: paragraphs, chunks, text blocks.

The rule is sequential (a group closes when its length passes a threshold, and
the length restarts), but its state is one bounded number. So a block of rows
acts as a function on that number. Blocks run in parallel, each for every
possible entry value; the functions are then chained, one small row per block;
and a second parallel pass runs each block from its true entry. Documents of one
block, nearly all of them, need the second pass only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .blocks import BLK, BLOCK_ROWS, block_of


@dataclass(frozen=True)
class Rule:
    """When a group closes.

    Before a row: a change of tag, a pause with ``soft_before`` characters
    gathered, or ``cap_before`` characters. After a row: ``cap_after``
    characters, or ``soft_after`` and a row that may close.
    """

    pause: float = float("inf")
    soft_before: int = 1 << 30
    cap_before: int = 1 << 30
    soft_after: int = 1 << 30
    cap_after: int = 1 << 30

    @property
    def top(self) -> int:
        return min(self.cap_before, self.cap_after)


def _breaks(rule: Rule, length, tag, start, prev_tag, prev_end):
    """Does a row open a new group? ``length`` is a number or an array."""
    if tag is not None and prev_tag is not None and tag != prev_tag:
        return length > 0
    limit = rule.cap_before
    if prev_end is not None and start - prev_end >= rule.pause:
        limit = min(limit, rule.soft_before)
    return (length > 0) & (length >= limit)


def _closes(rule: Rule, length, may_close):
    return (length >= rule.cap_after) | (may_close & (length >= rule.soft_after))


def _rows(batch: pa.RecordBatch, keys: list[str]):
    cols = [batch.column(k).to_pylist() for k in (*keys, BLK, "_o", "_add", "_tag", "_s", "_e", "_close", "_h")]
    n = len(keys)
    for row in zip(*cols):
        yield row[:n], row[n], row[n + 1:]


def _transfer(keys: list[str], rule: Rule):
    """Per block: entry length -> (exit length, start of the open group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        current = None
        for batch in batches:
            for key, blk, (o, add, tag, s, e, close, head) in _rows(batch, keys):
                if (key, blk) != current:
                    if current is not None:
                        out.append((*current[0], current[1], *_pack(entry, length, first)))
                    current = (key, blk)
                    entry = np.zeros(1, np.int64) if blk == 0 else np.arange(rule.top + 1)
                    length, first = entry.copy(), np.full(len(entry), -1)
                    prev_tag = prev_end = None
                if head:
                    prev_tag, prev_end = tag, e
                    continue
                new = _breaks(rule, length, tag, s, prev_tag, prev_end)
                length = np.where(new, 0, length)
                first = np.where(length == 0, o, first)
                length = np.minimum(length + add, rule.top)
                length = np.where(_closes(rule, length, close), 0, length)
                prev_tag, prev_end = tag, e
        if current is not None:
            out.append((*current[0], current[1], *_pack(entry, length, first)))
        yield _batch(out, keys)

    def _pack(entry, length, first):
        change = np.flatnonzero((np.diff(length) != 0) | (np.diff(first) != 0))
        ends = np.append(change, len(entry) - 1)
        return entry[ends].tolist(), length[ends].tolist(), first[ends].tolist()

    def _batch(out, keys):
        names = [*keys, BLK, "upto", "length", "first"]
        columns = list(zip(*out)) if out else [[] for _ in names]
        kinds = [None] * (len(keys) + 1) + [pa.list_(pa.int64())] * 3
        arrays = [pa.array(c, type=k) if k else pa.array(c, type=pa.int64()) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _chain(keys: list[str]):
    """Entry length and open group of every block, from the block functions."""

    def run(batches):
        current, out = None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in (*keys, BLK, "upto", "length", "first")]):
                key, (blk, upto, length, first) = row[: len(keys)], row[len(keys):]
                if key != current:
                    current, at, group = key, 0, -1
                out.append((*key, blk, at, group))
                i = int(np.searchsorted(upto, at)) if blk else 0
                group = first[i] if first[i] != -1 else group
                at = length[i]
        names = [*keys, BLK, "_l0", "_g0"]
        columns = list(zip(*out)) if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)

    return run


def _assign(keys: list[str], rule: Rule):
    """Rows with the order value of their group's first row."""

    def run(batches):
        current = None
        for batch in batches:
            groups = []
            l0, g0 = batch.column("_l0").to_pylist(), batch.column("_g0").to_pylist()
            for i, (key, blk, (o, add, tag, s, e, close, head)) in enumerate(_rows(batch, keys)):
                if (key, blk) != current:
                    current, length, group, prev_tag, prev_end = (key, blk), 0, o, None, None
                if head:
                    prev_tag, prev_end, length, group = tag, e, l0[i], g0[i]
                    groups.append(None)
                    continue
                if _breaks(rule, length, tag, s, prev_tag, prev_end):
                    length = 0
                if length == 0:
                    group = o
                length += add
                if _closes(rule, length, close):
                    length = 0
                prev_tag, prev_end = tag, e
                groups.append(group)
            yield batch.append_column("group_start", pa.array(groups, type=pa.int64()))

    return run


def grouped_rows(
    df: DataFrame, keys: list[str], order: str, rule: Rule, *, add, tag=None, start=None, end=None,
    close=None, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with ``group_start``: the ``order`` value of each group's first row.

    ``order`` counts rows of a document from 1. ``keys`` are bigint columns.
    """
    null = F.lit(None)
    fold_in = df.select(
        *df.columns,
        block_of(order, rows).alias(BLK),
        F.col(order).cast("bigint").alias("_o"),
        add.cast("bigint").alias("_add"),
        (null if tag is None else tag).cast("string").alias("_tag"),
        (null if start is None else start).cast("double").alias("_s"),
        (null if end is None else end).cast("double").alias("_e"),
        (F.lit(False) if close is None else close).alias("_close"),
    )
    fields = [*keys, BLK, "_o", "_add", "_tag", "_s", "_e", "_close"]
    key_ddl = ", ".join(f"{k} bigint" for k in keys)

    # documents of more than one block: what the row before each border was
    slim = fold_in.select(*fields)
    long_keys = slim.filter(F.col(BLK) > 0).select(*keys).distinct()
    long_rows = slim.join(long_keys, keys, "left_semi")
    last = long_rows.groupBy(*keys, BLK).agg(F.max_by(F.struct("_tag", "_e"), "_o").alias("v"))
    heads = lagged_edges(last, keys)
    sort = [*keys, BLK, F.col("_h").desc(), "_o"]
    transfer_in = (
        long_rows.withColumn("_h", F.lit(False)).unionByName(heads, allowMissingColumns=True)
        .repartition(*keys, BLK).sortWithinPartitions(*sort)
    )
    functions = transfer_in.mapInArrow(
        _transfer(keys, rule), f"{key_ddl}, {BLK} bigint, upto array<bigint>, length array<bigint>, first array<bigint>"
    )
    entries = (
        functions.repartition(*keys).sortWithinPartitions(*keys, BLK)
        .mapInArrow(_chain(keys), f"{key_ddl}, {BLK} bigint, _l0 bigint, _g0 bigint")
    )
    openings = heads.join(entries, [*keys, BLK])
    ready = (
        fold_in.withColumn("_h", F.lit(False)).unionByName(openings, allowMissingColumns=True)
        .repartition(*keys, BLK).sortWithinPartitions(*sort)
    )
    schema = StructType([*ready.schema.fields, StructField("group_start", LongType())])
    return ready.mapInArrow(_assign(keys, rule), schema).filter(~F.col("_h")).select(*df.columns, "group_start")


def lagged_edges(last: DataFrame, keys: list[str]) -> DataFrame:
    """A header row for each block after the first: the row before its border."""
    from pyspark.sql import Window as W

    prev = F.lag("v").over(W.partitionBy(*keys).orderBy(BLK))
    return last.select(*keys, BLK, prev.alias("v")).filter(F.col("v").isNotNull()).select(
        *keys, BLK, F.col("v._tag").alias("_tag"), F.col("v._e").alias("_e"), F.lit(True).alias("_h")
    )
