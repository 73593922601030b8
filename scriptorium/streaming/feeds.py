"""Live job feeds. Each rule has a batch form and a streaming form with equal results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.blocks import lagged, running

# The states a job may pass to.
LEGAL = {
    "queued": ("running", "canceled"),
    "running": ("queued", "transcribed", "done", "checked", "published", "error", "canceled"),
    "transcribed": ("queued", "running", "done"),
    "done": ("queued", "running", "checked"),
    "checked": ("queued", "running", "published"),
    "published": ("queued", "running"),
    "error": ("queued", "running"),
    "canceled": ("queued", "running"),
}
EVENT = ("job_id", "event_id", "ts", "status", "stage", "progress")
_SNAPSHOT = T.StructType([
    T.StructField("job_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("status", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("progress", T.DoubleType()),
])


FOUND = "doc_id bigint, block_id string, kind string, severity string, message string, start double, raw_excerpt string, source string"


def _hour(ts: str = "ts") -> Column:
    """Blocks of an hour: a job with many events is many small sorts."""
    return F.floor(F.unix_micros(ts) / 3_600_000_000).cast("bigint")


# ---- batch forms ---------------------------------------------------------

SHOWN = ("status", "stage", "progress")


def status_changes(events: DataFrame) -> DataFrame:
    """Snapshots that differ from the one before in status, stage or progress."""
    e = lagged(events, ["job_id"], ["ts", "event_id"], {"_p": F.struct(*SHOWN)}, block=_hour())
    return e.filter(~F.col("_p").eqNullSafe(F.struct(*SHOWN))).drop("_p")


def progress_throttle(events: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Rows worth writing: a new stage, or enough time since the last written row.

    A new stage or a pause of the whole interval always writes, whatever came
    before; so the greedy rule runs only inside the short bursts between them.
    """
    limit = int(seconds * 1_000_000)
    us = F.unix_micros("ts")
    e = lagged(events, ["job_id"], ["ts", "event_id"], {"_ps": F.col("stage"), "_pt": us}, block=_hour())
    fresh = F.col("_pt").isNull() | (F.col("_ps") != F.col("stage")) | (us - F.col("_pt") >= limit)
    e = running(e, ["job_id"], ["ts", "event_id"], {"_burst": (F.when(fresh, 1).otherwise(0), "sum")}, block=_hour())
    e = e.withColumn("_us", us).drop("_ps", "_pt")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        burst = last = None
        for batch in batches:
            mask = []
            for job, b, t in zip(*[batch.column(c).to_pylist() for c in ("job_id", "_burst", "_us")]):
                write = (job, b) != burst or t - last >= limit
                if write:
                    burst, last = (job, b), t
                mask.append(write)
            yield batch.filter(pa.array(mask))

    sorted_rows = e.repartition("job_id", "_burst").sortWithinPartitions("job_id", "_burst", "ts", "event_id")
    return sorted_rows.mapInArrow(keep, e.schema).drop("_burst", "_us")


def latest_status(events: DataFrame) -> DataFrame:
    """Current state per job; the same plan serves batch and stream."""
    rest = [c for c in events.columns if c != "job_id"]
    last = events.groupBy("job_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("v"))
    return last.select("job_id", *[F.col("v")[c].alias(c) for c in rest])


def legal(before: Column, after: Column) -> Column:
    allowed = F.create_map(*[x for k, v in LEGAL.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return before.isNull() | (before == after) | F.coalesce(F.array_contains(F.try_element_at(allowed, before), after), F.lit(False))


def stage_progression(events: DataFrame) -> DataFrame:
    """Each event with the state before it and whether the step is legal."""
    e = lagged(events, ["job_id"], ["ts", "event_id"], {"previous": F.col("status")}, block=_hour())
    return e.withColumn("legal", legal(F.col("previous"), F.col("status")))


def interrupted_jobs(events: DataFrame, as_of: Column, idle_seconds: float) -> DataFrame:
    """Jobs whose last event says running, longer ago than allowed: queue them again."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("ts")
    return latest_status(events).filter((F.col("status") == "running") & (age > int(idle_seconds * 1_000_000))).select("job_id", "ts")


# ---- streaming forms -----------------------------------------------------

def _stateful(stream: DataFrame, fn, state: str, watermark: str, out=_SNAPSHOT) -> DataFrame:
    """Runs ``fn`` with an event-time timer, so rows behind the watermark are dropped and counted by Spark."""
    rows = stream.withWatermark("ts", watermark).select(*EVENT)
    return rows.groupBy("job_id").applyInPandasWithState(fn, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat([f for f in frames if len(f)]).sort_values(["ts", "event_id"])


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


def _per_job(choose, keep_seconds: int):
    """A stateful function that emits the rows ``choose(rows, last)`` marks and keeps the state it gives.

    The state of a job goes when the watermark is ``keep_seconds`` past its last event; the
    job's next event is then a first one.
    """
    def fn(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(frames)
        mask, after = choose(rows, state.get if state.exists else None)
        state.update(after)
        state.setTimeoutTimestamp(max(_millis(rows["ts"].iloc[-1]) + keep_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if any(mask):
            yield rows.loc[list(mask), list(EVENT)]

    return fn


def stream_status_feed(stream: DataFrame, *, watermark: str = "10 minutes", keep_seconds: int = 86_400) -> DataFrame:
    """Emit a job's snapshot when its status, stage or progress changes."""
    def choose(rows, last):
        shown = list(rows[list(SHOWN)].astype(object).where(rows[list(SHOWN)].notna(), None).itertuples(index=False, name=None))
        return [now != before for now, before in zip(shown, [last, *shown])], shown[-1]

    return _stateful(stream, _per_job(choose, keep_seconds), "status string, stage string, progress double", watermark)


def stream_progress_throttle(stream: DataFrame, seconds: float = 2.0, *, watermark: str = "10 minutes", keep_seconds: int = 86_400) -> DataFrame:
    """Write a row on a new stage or after the interval, by event time."""
    def choose(rows, last):
        stage, at = last if last else (None, None)
        mask = []
        for s, t in zip(rows["stage"], rows["ts"].astype("datetime64[us]").astype("int64")):
            write = at is None or s != stage or t - at >= seconds * 1_000_000
            if write:
                stage, at = s, int(t)
            mask.append(write)
        return mask, (stage, at)

    return _stateful(stream, _per_job(choose, max(keep_seconds, int(seconds) + 1)), "stage string, at long", watermark)


def stream_progression(stream: DataFrame, *, watermark: str = "10 minutes", keep_seconds: int = 86_400) -> DataFrame:
    """Illegal steps, as they arrive."""
    def choose(rows, last):
        states = list(rows["status"])
        steps = zip([last[0] if last else None, *states], states)
        return [b is not None and b != s and s not in LEGAL.get(b, ()) for b, s in steps], (states[-1],)

    return _stateful(stream, _per_job(choose, keep_seconds), "status string", watermark)


def stream_interrupted(stream: DataFrame, idle_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """Jobs left running without an event, told by an event-time timer."""
    out = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("last_ts", T.TimestampType())])

    def fn(key, frames, state: GroupState):
        if state.hasTimedOut:
            at = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last_ts": [pd.Timestamp(at, unit="ms")]})
            return
        last = _ordered(frames).iloc[-1]
        at = _millis(last["ts"])
        if last["status"] == "running":
            state.update((at,))
            state.setTimeoutTimestamp(max(at + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return _stateful(stream, fn, "at long", watermark, out)


def stream_claims(claims: DataFrame, watermark: str = "1 day") -> DataFrame:
    """One check per key within the watermark."""
    return claims.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["key"])


def write_findings(pairs: DataFrame, names: DataFrame, path: str, checkpoint: str):
    """Findings with the lexicon, one micro-batch at a time.

    A batch run again replaces its own partition, so a lost executor or a restart
    leaves no double rows.
    """
    from ..operators.findings import rule_findings

    def write(batch: DataFrame, batch_id: int) -> None:
        out = rule_findings(batch, names).withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
