"""Scores over labelled cases: id, expected, actual, tags, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import OPENING_FLOOR, SUPPORT_FLOOR, WINDOW, misaligned

WINDOWS = (4, 6, 8, 10, 12)
FLOORS = (0.50, 0.60, 0.70, 0.80, 0.90)
OPENING_FLOORS = (0.40, 0.50, 0.60, 0.70)


def outcome(expected: Column, actual: Column) -> Column:
    return (
        F.when((expected == "accept") & (actual == "accept"), "true_accept")
        .when((expected == "reject") & (actual == "reject"), "true_reject")
        .when((expected == "reject") & (actual == "accept"), "false_accept")
        .otherwise("false_reject")
    )


def confusion(scored: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts, accuracy, false-accept and false-reject rates."""
    o = outcome(F.col("expected"), F.col("actual"))
    kinds = ("true_accept", "true_reject", "false_accept", "false_reject")
    counts = scored.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(o == k).alias(k) for k in kinds])
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    return counts.withColumns({
        "accuracy": rate(c("true_accept") + c("true_reject"), c("total")),
        "false_accept_rate": rate(c("false_accept"), c("true_reject") + c("false_accept")),
        "false_reject_rate": rate(c("false_reject"), c("true_accept") + c("false_reject")),
    })


def per_tag(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("tags").alias("tag"), (F.col("expected") == F.col("actual")).alias("right")).groupBy("tag").agg(
        F.count("*").alias("total"), F.count_if("right").alias("correct")
    )


def reason_histogram(scored: DataFrame) -> DataFrame:
    return (
        scored.filter("actual = 'reject'").select(F.explode("reasons").alias("reason"))
        .groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")
    )


def action_accuracy(scored: DataFrame) -> DataFrame:
    right = F.col("expected") == F.col("actual")
    return scored.groupBy("expected", "actual").agg(F.count("*").alias("n"), F.count_if(right).alias("correct"))


def divergences(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("expected") != F.col("actual")).withColumn("outcome", outcome(F.col("expected"), F.col("actual")))


def threshold_sweep(validated: DataFrame) -> DataFrame:
    """False accepts and rejects for every window, floor and opening floor.

    Texts are scanned once, with one support column per window. A row then is its verdicts
    under the settings, of which there are few kinds, as a higher floor refuses what a lower
    one does: rows are counted by these, and the grid meets the counts.
    """
    other = F.size(F.array_except("reasons", F.array(F.lit("prefix_misaligned")))) > 0
    grid = [("window", w, f, OPENING_FLOOR) for w in WINDOWS for f in FLOORS]
    grid += [("opening", WINDOW, SUPPORT_FLOOR, f) for f in OPENING_FLOORS]
    refused = [F.col("_other") | misaligned(window, floor, opening) for _, window, floor, opening in grid]
    kinds = validated.withColumn("_other", other).select("expected", F.array(*refused).alias("_v")).groupBy("expected", "_v").agg(F.count("*").alias("_n"))

    def setting(i, kind, window, floor, opening):
        shown = opening if kind == "opening" else floor
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(window).cast("bigint").alias("window"), F.lit(shown).alias("floor"),
            F.when(F.get("_v", F.lit(i)), "reject").otherwise("accept").alias("actual"),
        )

    rows = kinds.select("expected", "_n", F.explode(F.array(*[setting(i, *g) for i, g in enumerate(grid)])).alias("s")).select("expected", "_n", "s.*")
    o = outcome(F.col("expected"), F.col("actual"))
    return rows.groupBy("kind", "window", "floor").agg(*[F.sum(F.when(o == k, F.col("_n")).otherwise(0)).alias(k) for k in ("false_accept", "false_reject")])


def evaluation_report(scored: DataFrame) -> DataFrame:
    """One row: a compact JSON report and whether the gate holds."""
    c = confusion(scored)
    return c.select(
        F.to_json(F.struct(*[F.col(x) for x in c.columns])).alias("report"),
        ((F.col("false_accept") == 0) & (F.col("false_reject") == 0)).alias("gate"),
    )


def text_report(scored: DataFrame) -> DataFrame:
    """The report as ordered lines: totals, tags, refusal reasons."""
    c = confusion(scored)
    totals = ("total", "true_accept", "true_reject", "false_accept", "false_reject")
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("k"), F.col(n).cast("string").alias("v")) for i, n in enumerate(totals)])
    head = c.select(F.lit(0).alias("section"), F.explode(pairs).alias("p")).select(
        "section", F.format_string("%03d", "p.i").alias("at"), F.concat(F.rpad(F.upper(F.replace("p.k", F.lit("_"), F.lit(" "))), 15, " "), "p.v").alias("line")
    )
    tags = per_tag(scored).select(
        F.lit(1).alias("section"), F.col("tag").alias("at"),
        F.concat(F.rpad("tag", 20, " "), F.lit(" "), F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" correct")).alias("line"),
    )
    reasons = reason_histogram(scored).select(
        F.lit(2).alias("section"), F.concat(F.lpad((F.lit(10**12) - F.col("n")).cast("string"), 13, "0"), "reason").alias("at"),
        F.concat(F.rpad("reason", 24, " "), F.lit(" "), F.col("n").cast("string")).alias("line"),
    )
    return head.unionByName(tags).unionByName(reasons).orderBy("section", "at")
