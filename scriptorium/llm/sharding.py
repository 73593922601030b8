"""Transcripts in shards of near equal bytes, by histogram sort. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed

DIGITS = 16  # a sort key has 128 bits: 8 digits of the text's hash, 8 of the id's
HALF = 1 << 63


def _halves(key: int) -> tuple[int, int]:
    """A 128-bit key as the two signed hashes it stands for."""
    return (key >> 64) - HALF, (key & (2 * HALF - 1)) - HALF


def _digit(level: int) -> Column:
    half, at = ("hi", level) if level < 8 else ("lo", level - 8)
    digit = F.shiftrightunsigned(half, 56 - 8 * at).bitwiseAND(F.lit(255).cast("bigint"))
    return digit.bitwiseXOR(F.lit(128).cast("bigint")) if at == 0 else digit  # signed order


def _inside(key: int, level: int) -> Column:
    """Whether a row's first ``level`` digits are those of ``key``."""
    high, low = _halves(key)
    bits_hi, bits_lo = min(8 * level, 64), max(0, 8 * level - 64)
    tests = [F.shiftright(name, 64 - bits) == F.lit(value >> (64 - bits)) if bits < 64 else F.col(name) == F.lit(value)
             for name, value, bits in (("hi", high, bits_hi), ("lo", low, bits_lo)) if bits]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def find_splitters(keys: DataFrame, shards: int, *, tolerance: float = 0.001) -> list[int]:
    """Borders between shards, as 128-bit keys: a row belongs behind every border that is not above it.

    ``keys``: hi, lo, size. Each round counts the exact bytes below 256 candidate borders
    inside every range that still holds a splitter, and goes on in the range around its
    target. A splitter is settled when a candidate is within ``tolerance`` of a shard's share
    of its target, or when one row or equal keys are left; the nearer side is taken. The
    driver sees at most 256 sums a splitter and round.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    wanted = [(k, k * share) for k in range(1, shards)]
    where = {k: (0, 0) for k, _ in wanted}  # splitter -> first key of its range, bytes below that
    found: dict[int, int] = {}
    for level in range(DIGITS if total else 0):
        ranges = sorted({key for key, _ in where.values()})
        rows = keys.withColumns({"digit": _digit(level), "range": reduce(
            lambda chain, i: chain.when(_inside(ranges[i], level), i), range(1, len(ranges)), F.when(_inside(ranges[0], level), 0))})
        sums = rows.filter("range is not null").groupBy("range", "digit").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        histogram = {r: sorted((s["digit"], s["size"], s["n"]) for s in sums if s["range"] == r) for r in range(len(ranges))}
        width = 1 << (128 - 8 * (level + 1))
        for k, target in [(k, t) for k, t in wanted if k in where]:
            key, below = where[k]
            for digit, size, n in histogram[ranges.index(key)]:
                if below + size > target or digit == histogram[ranges.index(key)][-1][0]:
                    start = key + digit * width
                    before, after = abs(target - below), abs(below + size - target)
                    if min(before, after) <= tolerance * share or n == 1 or level == DIGITS - 1:
                        found[k] = start if before <= after else start + width
                        del where[k]
                    else:
                        where[k] = (start, below)
                    break
                below += size
        if not where:
            break
    return [found.get(k, 1 << 128) for k in range(1, shards)]


def shard_jobs(
    jobs: DataFrame, *, doc_id: str = "doc_id", text: str = "raw_text", shards: int = 24, tolerance: float = 0.001, cell_rows: int = 32_768,
    to: str = "placed",
) -> DataFrame:
    """Jobs with ``placed``: struct of size (bytes), shard (int, from 0) and slot (bigint, from 0 without gaps).

    Law ``bytes``: shards are ranges of the key (hash of the text, hash of the id), cut where
    the sum of sizes comes nearest to equal shares. A size is the UTF-8 length of the text,
    none if null, plus 8. Equal transcripts stand together and share a shard unless a border
    has to cut their group; rows that agree in text and id are never parted. Null ids and
    texts have keys like any other. The whole rows are exchanged once, by shard and cell of
    about ``cell_rows`` rows, so no shard is sorted in one task; slots count on from cell to
    cell. An empty table stays empty; a column that is already named ``to`` is replaced.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8
    hashes = {"hi": F.xxhash64(text), "lo": F.xxhash64(doc_id)}
    keys = checkpointed(jobs.select(*[h.alias(n) for n, h in hashes.items()], size.alias("size")))
    borders = [_halves(b) if b < 1 << 128 else None for b in find_splitters(keys, shards, tolerance=tolerance)]
    behind = [(F.col("hi") > F.lit(h)) | ((F.col("hi") == F.lit(h)) & (F.col("lo") >= F.lit(l))) for h, l in [b for b in borders if b]]
    shard = reduce(lambda a, b: a + b, [b.cast("int") for b in behind], F.lit(0))
    cells = max(16, -(-keys.count() // (cell_rows * shards)))
    spread = F.xxhash64("lo", "hi")
    cell = F.pmod(spread, F.lit(cells)).cast("int")

    counts = keys.groupBy(shard.alias("shard"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))

    row = F.struct(*[F.col(f"`{c}`") for c in jobs.columns if c != to]).alias("row")
    placed = jobs.select(row, *[h.alias(n) for n, h in hashes.items()], size.alias("size")).withColumns({"shard": shard, "cell": cell})
    within = F.row_number().over(W.partitionBy("shard", "cell").orderBy("lo", "hi")) - 1
    placed = placed.withColumn("within", within).join(firsts, ["shard", "cell"])
    return placed.select("row.*", F.struct("size", "shard", (F.col("first") + F.col("within")).alias("slot")).alias(to))
