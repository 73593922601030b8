"""Ordered operators that stay parallel inside one hot key.

A plain window over ``doc_id`` sorts a whole document in one task. Here each
document is cut into blocks of bounded size; windows run per block, and what
crosses a border travels as one small row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed

BLOCK_ROWS = 65_536
BLK = "_blk"


def block_of(order: str | Column, rows: int = BLOCK_ROWS) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor((order - 1) / rows).cast("bigint")


def _carries(carry: DataFrame) -> DataFrame | None:
    """What crosses a border, kept; none if no key goes on into a second block.

    Only then do the rows have to meet it: planned ahead, that join would move all rows to
    find nothing wherever documents are shorter than a block. For rows that are quick to
    read without what they carry, as they are read once more.
    """
    kept = checkpointed(carry)
    return None if kept.isEmpty() else kept


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    outs: dict[str, tuple[Column, str]],
    *,
    block: Column | None = None,
    inclusive: bool = True,
    ahead: bool = False,
) -> DataFrame:
    """Prefix ``sum`` or ``max`` of expressions along ``order`` per key.

    ``outs`` maps a new column to ``(expression, "sum" | "max")``. ``ahead``: see ``_carries``.
    """
    agg = {"sum": F.sum, "max": F.max}
    base = df.withColumn(BLK, block_of(order[0]) if block is None else block)
    w = W.partitionBy(*keys, BLK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = base.select("*", *[agg[how](e).over(w).alias(f"_l_{n}") for n, (e, how) in outs.items()])
    totals = base.groupBy(*keys, BLK).agg(*[agg[how](e).alias(f"_t_{n}") for n, (e, how) in outs.items()])
    wb = W.partitionBy(*keys).orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *keys, BLK, *[agg[how](f"_t_{n}").over(wb).alias(f"_c_{n}") for n, (_, how) in outs.items()]
    ).filter(F.greatest(*[F.col(f"_c_{n}").isNotNull().cast("int") for n in outs], F.lit(0)) == 1)
    if ahead and (carry := _carries(carry)) is None:
        return local.select(*df.columns, *[F.col(f"_l_{n}").alias(n) for n in outs])
    joined = local.join(carry, [*keys, BLK], "left")

    def combine(n, how):
        l, c = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if how == "max":
            return F.greatest(l, c)
        return F.when(l.isNull(), c).when(c.isNull(), l).otherwise(l + c)

    return joined.select(*df.columns, *[combine(n, how).alias(n) for n, (_, how) in outs.items()])


def lagged(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    cols: dict[str, Column],
    *,
    block: Column | None = None,
    lead: bool = False,
    ahead: bool = False,
) -> DataFrame:
    """Values of the previous (or next) row per key, as new columns. ``ahead``: see ``_carries``."""
    base = df.withColumn(BLK, block_of(order[0]) if block is None else block)
    value = F.struct(*[e.alias(n) for n, e in cols.items()])
    w = W.partitionBy(*keys, BLK).orderBy(*order)
    wb = W.partitionBy(*keys).orderBy(BLK)
    step, pick, shift = (F.lead, F.min_by, F.lead) if lead else (F.lag, F.max_by, F.lag)
    local = base.select("*", step(value).over(w).alias("_p"))
    edge = base.groupBy(*keys, BLK).agg(pick(value, F.struct(*order)).alias("_e"))
    carry = edge.select(*keys, BLK, shift("_e").over(wb).alias("_c")).filter(F.col("_c").isNotNull())
    if ahead and (carry := _carries(carry)) is None:
        joined = local.withColumnRenamed("_p", "_v")
    else:
        joined = local.join(carry, [*keys, BLK], "left").withColumn("_v", F.coalesce("_p", "_c"))
    return joined.select(*df.columns, *[F.col("_v")[n].alias(n) for n in cols])


def ordered_text(
    df: DataFrame, keys: list[str], order: str, text: Column, separator: str = " ", *, rows: int = 4096
) -> DataFrame:
    """Texts joined in order, in numbered parts of bounded size.

    A document with a bounded number of rows has one part, number 0; the parts
    of a longer one follow each other, joined by the separator.
    """
    return (
        df.withColumn("part", block_of(order, rows))
        .groupBy(*keys, "part")
        .agg(joined_text(text, order, separator).alias("content"))
    )


def joined_text(text: Column, order: str | Column, separator: str = " ") -> Column:
    """Aggregate: texts of one bounded group joined in order; nulls are left out."""
    order = F.col(order) if isinstance(order, str) else order
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)
