"""Job feeds, and readers over derived lines."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.align import opcodes
from ..session import shared_dir
from ..sources import bindings as B, readers
from ..streaming import feeds as S
from .findings_queries import FULL, names
from .registry import query, with_

COLS = ("job_id", "event_id", "ts", "status", "stage", "progress")
PREV = "pv AS (SELECT *, lag(status) OVER w AS previous, lag(stage) OVER w AS previous_stage, lag(progress) OVER w AS previous_progress FROM ev WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))"
CHANGES = "SELECT job_id, event_id, status FROM pv WHERE (previous, previous_stage, previous_progress) IS DISTINCT FROM (status, stage, progress)"


def events(spark, d):
    return B.job_events(spark, d).select(*COLS)


@query("status_changes", with_(B.EV, PREV) + CHANGES)
def status_changes(spark, d):
    return S.status_changes(events(spark, d)).select("job_id", "event_id", "status")


THROTTLE = """
tn AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn, epoch_us(ts) AS us FROM ev),
tr AS (SELECT job_id, rn, event_id, stage, us AS last, true AS w FROM tn WHERE rn = 1
  UNION ALL
  SELECT n.job_id, n.rn, n.event_id, n.stage, CASE WHEN n.stage <> r.stage OR n.us - r.last >= 21600000000 THEN n.us ELSE r.last END, n.stage <> r.stage OR n.us - r.last >= 21600000000
  FROM tr r JOIN tn n ON n.job_id = r.job_id AND n.rn = r.rn + 1)
"""


@query("progress_throttle", with_(B.EV, THROTTLE) + "SELECT job_id, event_id FROM tr WHERE w")
def progress_throttle(spark, d):
    return S.progress_throttle(events(spark, d), seconds=21600).select("job_id", "event_id")


@query("latest_status", with_(B.EV) + "SELECT job_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(status, {'t': ts, 'e': event_id}) AS status FROM ev GROUP BY job_id")
def latest_status(spark, d):
    return S.latest_status(events(spark, d)).select("job_id", "event_id", "status")


_PAIRS = " OR ".join(f"(previous = '{a}' AND status IN ({', '.join(repr(x) for x in bs)}))" for a, bs in S.LEGAL.items())


@query("stage_progression", with_(B.EV, PREV) + f"SELECT job_id, event_id, previous, status, (previous IS NULL OR previous = status OR {_PAIRS}) AS legal FROM pv")
def stage_progression(spark, d):
    return S.stage_progression(events(spark, d)).select("job_id", "event_id", "previous", "status", "legal")


@query(
    "interrupted_jobs",
    with_(B.EV) + """SELECT job_id, ts FROM (SELECT job_id, max(ts) AS ts, arg_max(status, {'t': ts, 'e': event_id}) AS status FROM ev GROUP BY job_id)
      WHERE status = 'running' AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) > 28800000000""",
)
def interrupted_jobs(spark, d):
    return S.interrupted_jobs(events(spark, d), F.lit("2024-01-31 00:00:00"), 28800).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def run_once(stream, name: str):
    """Run a stream over what is there and give the result as a table."""
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    run = stream.writeStream.format("parquet").option("checkpointLocation", base + "/state").trigger(availableNow=True).start(base + "/rows")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/rows")


def live_events(spark, d):
    raw = B.live_table(spark, d, "events")
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "queued", "view", "running", "click", "transcribed", "purchase", "done", "error", "error")]), F.col("event_type"))
    return raw.select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.col("event_type").alias("stage"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)).alias("progress"))


@query("stream_status_feed", with_(B.EV, PREV) + CHANGES)
def stream_status_feed(spark, d):
    return run_once(S.stream_status_feed(live_events(spark, d)), "feed").select("job_id", "event_id", "status")


@query("stream_progress_throttle", with_(B.EV, THROTTLE) + "SELECT job_id, event_id FROM tr WHERE w")
def stream_progress_throttle(spark, d):
    return run_once(S.stream_progress_throttle(live_events(spark, d), 21600), "throttle").select("job_id", "event_id")


@query("stream_claim_dedupe", "SELECT DISTINCT event_type || ':' || user_id AS key FROM events")
def stream_claim_dedupe(spark, d):
    e = live_events(spark, d).withColumn("key", F.concat_ws(":", "stage", F.col("job_id").cast("string")))
    return run_once(S.stream_claims(e, "60 days"), "claims").select("key")


@query("stream_progression", with_(B.EV, PREV) + f"SELECT job_id, event_id FROM pv WHERE NOT (previous IS NULL OR previous = status OR {_PAIRS})")
def stream_progression(spark, d):
    return run_once(S.stream_progression(live_events(spark, d)), "steps").select("job_id", "event_id")


@query(
    "stream_interrupted",
    with_(B.EV) + """SELECT job_id, date_trunc('milliseconds', ts) AS last_ts FROM (SELECT job_id, max(ts) AS ts, arg_max(status, {'t': ts, 'e': event_id}) AS status, max(max(ts)) OVER () AS latest FROM ev GROUP BY job_id)
      WHERE status = 'running' AND epoch_us(latest) - 600000000 > epoch_us(ts) + 28800000000""",
)
def stream_interrupted(spark, d):
    """Jobs that the stream's timers report: no event for eight hours after a running one, as far as the watermark has come."""
    return run_once(S.stream_interrupted(live_events(spark, d), 28800), "idle").select("job_id", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@query("stream_findings", with_(B.SEG, B.PAIR, B.LEX, B.LEX_NAMES, FULL) + "SELECT doc_id, block_id, kind, severity, message FROM find")
def stream_findings(spark, d):
    """Findings as documents arrive, written batch by batch and read again."""
    raw = B.live_table(spark, d, "documents")
    base = f"{shared_dir(spark)}/findings-{uuid.uuid4().hex}"
    spark.createDataFrame([], S.FOUND).write.parquet(base + "/rows")  # a table without documents has no batch to write it
    S.write_findings(B.pairs_of(B.segments_of(raw, False)), names(spark, d), base + "/rows", base + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(S.FOUND).parquet(base + "/rows").select("doc_id", "block_id", "kind", "severity", "message")


@query("word_opcodes")
def word_opcodes(spark, d):
    p = B.pairs(spark, d).withColumn("o", opcodes("raw", "clean"))
    return p.select("doc_id", "seg_idx", F.explode("o").alias("o")).select("doc_id", "seg_idx", "o.*")


CASE_LINES = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'JSON invalide' WHEN 1 THEN 'champs manquants: expected, tags' END AS reason FROM documents WHERE doc_id % 5 <> 4"""


@query("parse_cases", CASE_LINES)
def parse_cases(spark, d):
    i = F.col("doc_id") % 5
    good = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("raw"), F.col("text").alias("candidate"),
        F.lit("accept").alias("expected"), F.array("lang").alias("tags"), "source",
    ))
    short = F.to_json(F.struct(F.lit("x").alias("id"), F.col("text").alias("raw"), F.col("text").alias("candidate"), "source"))
    value = F.when(i == 0, F.concat(F.lit("{"), good)).when(i == 1, short).when(i == 4, "  ").otherwise(good)
    ok, bad = readers.parse_cases(B.documents(spark, d).select("doc_id", value.alias("value")))
    return ok.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("doc_id", "reason"))


@query(
    "parse_notes",
    """SELECT page_id::VARCHAR || '.md' AS path, CASE page_id % 3 WHEN 0 THEN 'Titre ' || page_id WHEN 1 THEN 'Fait ' || page_id ELSE page_id::VARCHAR END AS title,
      CASE WHEN page_id % 3 = 0 THEN 'a' || page_id || '|b c' ELSE '' END AS aliases, CASE WHEN page_id % 3 = 0 THEN 'cours' ELSE '' END AS type FROM pages""",
)
def parse_notes(spark, d):
    i = F.col("page_id")
    n = i.cast("string")
    front = F.concat(F.lit("---\n# note: x\ntitre: 'Titre "), n, F.lit("'\naliases: [\"a"), n, F.lit("\", 'b c']\ntype: cours\n---\n# Autre\n"), "html")
    content = F.when(i % 3 == 0, front).when(i % 3 == 1, F.concat(F.lit("texte\n# Fait "), n, F.lit("  \nsuite"))).otherwise("sans titre")
    notes = readers.parse_notes(B.table(spark, d, "pages").select(F.concat(n, F.lit(".md")).alias("path"), content.alias("content")))
    return notes.select("path", "title", F.array_join("aliases", "|").alias("aliases"), "type")
