"""Clock and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def timecode(seconds: Column, separator: str = ",") -> Column:
    """``HH:MM:SS,mmm``; halves round to even."""
    ms = F.rint(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)) * 1000).cast("bigint")
    part = lambda unit, mod: (F.floor(ms / unit) % mod) if mod else F.floor(ms / unit)
    pad = lambda c, n: F.when(F.length(c.cast("string")) >= n, c.cast("string")).otherwise(F.lpad(c.cast("string"), n, "0"))
    return F.concat(
        pad(part(3_600_000, 0), 2), F.lit(":"), pad(part(60_000, 60), 2), F.lit(":"),
        pad(part(1000, 60), 2), F.lit(separator), pad(ms % 1000, 3),
    )


def short_timecode(seconds: Column) -> Column:
    return F.substring_index(timecode(seconds), ",", 1)


def clock(seconds: Column) -> Column:
    """``h:mm:ss`` from one hour, else ``m:ss``."""
    s = seconds.cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes = F.floor(s / 60)
    return F.when(
        s >= 3600,
        F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(minutes % 60), F.lit(":"), two(s % 60)),
    ).otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(s % 60)))


def clip_bounds(start: Column, end: Column, duration: Column, padding: float = 3.0) -> Column:
    """A clip around a segment, kept inside the recording."""
    return F.struct(
        F.greatest(F.lit(0.0), start - padding).alias("clip_start"),
        F.least(duration, end + padding).alias("clip_end"),
    )


def shift_words(words: Column, offset: Column) -> Column:
    """Move word times by an offset, to the millisecond."""
    return F.transform(
        words,
        lambda w: w.withField("start", F.round(w["start"] + offset, 3)).withField("end", F.round(w["end"] + offset, 3)),
    )


def spread_words(tokens: Column, start: Column, end: Column) -> Column:
    """Words spread evenly over ``[start, end]``."""
    def spread(v):
        step = (v["e"] - v["s"]) / F.size(v["t"])
        return let(
            F.struct(v["t"].alias("t"), v["s"].alias("s"), step.alias("step")),
            lambda u: F.transform(
                u["t"],
                lambda t, i: F.struct(
                    F.round(u["s"] + i * u["step"], 3).alias("start"),
                    F.round(u["s"] + (i + 1) * u["step"], 3).alias("end"),
                    t.alias("text"),
                ),
            ),
        )

    return let(F.struct(tokens.alias("t"), start.alias("s"), end.alias("e")), spread)


def confidence_from_logprob(logprob: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 + logprob / 1.5)), 3)


def confidence_class(score: Column) -> Column:
    return (
        F.when(score.isNull() | (score >= 0.8), "")
        .when(score >= 0.6, "conf-mid")
        .otherwise("conf-low")
    )
