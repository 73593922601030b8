"""Library lists, search, guards, and signal profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import joins as J, library as Y, sequence as Q, signal as G
from ..sources import bindings as B
from . import sqlkit as S
from .claims_queries import VERD, verdicts
from .registry import query, with_
from .sequence_queries import TURNS

AS_OF = "2024-03-05 00:00:00"


@query("library_view", with_(B.JOBS) + "SELECT doc_id, filename, title, status, created_at FROM jobs ORDER BY created_at DESC, doc_id LIMIT 100")
def library_view(spark, d):
    return Y.library_view(B.jobs(spark, d), 100).select("doc_id", "filename", "title", "status", "created_at")


@query(
    "library_filter",
    with_(B.JOBS) + f"SELECT doc_id, status, created_at FROM jobs WHERE status = 'done' AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at) <= 30 * 86400000000 AND len(list_filter(tags, lambda t: contains(lower(t), 'src1'))) > 0",
)
def library_filter(spark, d):
    return Y.library_filter(B.jobs(spark, d), F.lit(AS_OF), status="done", days=30, tag="SRC1").select("doc_id", "status", "created_at")


@query("search_docs", with_(B.JOBS) + "SELECT doc_id, title FROM jobs WHERE contains(lower(filename), 'tion the') OR contains(lower(title), 'tion the') OR contains(lower(raw_text), 'tion the') OR contains(lower(clean_text), 'tion the')")
def search_docs(spark, d):
    return Y.search_docs(B.jobs(spark, d), "Tion The").select("doc_id", "title")


PASSAGES = """
hit AS (SELECT doc_id, arg_min(text, pos) AS text, arg_min("start", pos) AS "start", arg_min("end", pos) AS "end", count(*) AS n FROM turns WHERE contains(lower(text), 'leçon') OR contains(lower(text), 'der er') GROUP BY doc_id)
"""


@query(
    "search_passages",
    with_(B.SEG, TURNS, B.JOBS, PASSAGES.replace("contains(lower(text), 'leçon') OR ", ""))
    + r"""SELECT doc_id, title, regexp_replace(substring(x, (f + 1)::BIGINT, (pz + 6 + 110 - f)::BIGINT), '^\s+|\s+$', '', 'g') AS match_text, "start", "end", coalesce(n, 1) AS match_count FROM (
      SELECT *, greatest(0, pz - 70) AS f FROM (SELECT *, instr(lower(x), 'der er') - 1 AS pz FROM (
        SELECT j.doc_id, coalesce(title, filename) AS title, created_at, "start", "end", n,
          coalesce(hit.text, CASE WHEN contains(lower(title), 'der er') THEN title END, CASE WHEN contains(lower(clean_text), 'der er') THEN clean_text END, CASE WHEN contains(lower(raw_text), 'der er') THEN raw_text END) AS x
        FROM jobs j LEFT JOIN hit USING (doc_id)) WHERE x IS NOT NULL))""",
)
def search_passages(spark, d):
    return Y.search_passages(B.jobs(spark, d), Q.speaker_turns(B.segments(spark, d)), "Der er").drop("created_at")


@query("editor_matches", with_(B.SEG) + "SELECT doc_id, 'segment-' || seg_idx AS block_id FROM seg WHERE contains(lower(text), 'tion')")
def editor_matches(spark, d):
    return Y.editor_matches(B.segments(spark, d).withColumn("block_id", F.concat(F.lit("segment-"), F.col("seg_idx").cast("string"))), "TION")


@query("publication_status", with_(B.JOBS) + "SELECT doc_id, CASE WHEN note_path IS NOT NULL THEN 'publie' WHEN status IN ('done','checked','published') THEN 'pret' ELSE 'non_disponible' END AS publication FROM jobs")
def publication_status(spark, d):
    return B.jobs(spark, d).select("doc_id", Y.publication_status().alias("publication"))


@query(
    "replacement_char_guard",
    with_(B.SEG, B.ASR) + """SELECT doc_id, (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS at_clock FROM (SELECT doc_id, floor(arg_min("start", seg_idx))::BIGINT AS s FROM asr WHERE contains(text, chr(65533)) GROUP BY doc_id)""",
)
def replacement_char_guard(spark, d):
    return Y.replacement_char_guard(B.asr_segments(spark, d))


@query("block_quality_warnings", with_(B.SEG, B.ASR) + "SELECT doc_id, seg_idx, CASE WHEN contains(text, chr(65533)) THEN 'lost_characters' ELSE 'repetition_loop' END AS warnings FROM asr WHERE contains(text, chr(65533)) OR " + S.loop("text"))
def block_quality_warnings(spark, d):
    return B.asr_segments(spark, d).withColumn("w", Y.block_warnings()).filter(F.size("w") > 0).select("doc_id", "seg_idx", F.array_join("w", ",").alias("warnings"))


@query(
    "editorial_text",
    with_(B.SEG, B.JOBS)
    + r"""SELECT doc_id, (seg_idx - 1) // 4096 AS part, string_agg(CASE WHEN seg_idx = 2 THEN text || '!' ELSE text END, chr(10) || chr(10) ORDER BY seg_idx) AS content FROM seg
        WHERE doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM seg WHERE seg_idx = 2) GROUP BY ALL
      UNION ALL SELECT doc_id, 0, regexp_replace(coalesce(clean_text, raw_text), '^\s+|\s+$', '', 'g') FROM jobs WHERE NOT (doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM seg WHERE seg_idx = 2))""",
)
def editorial_text(spark, d):
    seg = B.segments(spark, d)
    edited = F.when((F.col("doc_id") % 3 == 0) & (F.col("seg_idx") == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    blocks = seg.select("doc_id", F.col("seg_idx").alias("pos"), edited.alias("text"))
    return Y.editorial_text(B.jobs(spark, d), blocks, seg)


def annotations(spark, d):
    i = F.col("seg_idx")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    return B.segments(spark, d).select(
        "doc_id", "seg_idx", F.concat(F.lit("segment-"), i.cast("string")).alias("block_id"), pick(("note", "highlight", "review", "blot")).alias("type"),
        pick(("a_verifier", "valide", None, "ignore", "perdu")).alias("status"),
        F.when(i % 6 != 1, i % 4 - 1).alias("range_start"), F.when(i % 6 != 2, i % 5).alias("range_end"),
    )


ANN = """
ann AS (SELECT doc_id, seg_idx, ['note','highlight','review','blot'][seg_idx % 4 + 1] AS type, ['a_verifier','valide',NULL,'ignore','perdu'][seg_idx % 5 + 1] AS status,
  CASE WHEN seg_idx % 6 <> 1 THEN seg_idx % 4 - 1 END AS rs, CASE WHEN seg_idx % 6 <> 2 THEN seg_idx % 5 END AS re FROM seg)
"""


@query(
    "validate_annotations",
    with_(B.SEG, ANN)
    + """SELECT doc_id, seg_idx, array_to_string(list_filter([CASE WHEN type = 'blot' THEN 'type' END, CASE WHEN status = 'perdu' THEN 'status' END,
       CASE WHEN (rs IS NULL) <> (re IS NULL) THEN 'range_half' END, CASE WHEN rs < 0 OR rs >= re THEN 'range' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ann""",
)
def validate_annotations(spark, d):
    return annotations(spark, d).select("doc_id", "seg_idx", F.array_join(Y.annotation_reasons(), ",").alias("reasons"))


@query("pending_annotations", with_(B.SEG, ANN) + "SELECT doc_id, count(*) AS pending FROM ann WHERE status = 'a_verifier' GROUP BY doc_id")
def pending_annotations(spark, d):
    return Y.pending_annotations(annotations(spark, d))


@query("library_with_pending", with_(B.SEG, ANN, B.JOBS) + "SELECT doc_id, status, coalesce(pending, 0) AS pending FROM jobs LEFT JOIN (SELECT doc_id, count(*) AS pending FROM ann WHERE status = 'a_verifier' GROUP BY doc_id) USING (doc_id)")
def library_with_pending(spark, d):
    return J.with_pending(B.jobs(spark, d).select("doc_id", "status"), Y.pending_annotations(annotations(spark, d)))


@query("resumable_jobs", with_(B.JOBS) + "SELECT doc_id, coalesce(stage, 'extraction') AS stage, created_at FROM jobs WHERE status IN ('queued', 'running')")
def resumable_jobs(spark, d):
    return Y.resumable_jobs(B.jobs(spark, d))


@query("get_doc", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 7")
def get_doc(spark, d):
    """One row by id: the predicate and the columns reach the scan."""
    return B.table(spark, d, "documents").filter("doc_id = 7").select("doc_id", "lang", "n_chars")


@query("project_docs", "SELECT doc_id, source FROM documents")
def project_docs(spark, d):
    return B.table(spark, d, "documents").select("doc_id", "source")


@query("new_docs", "SELECT doc_id, 'queued' AS status, 0.0::DOUBLE AS progress, lang AS language, TIMESTAMP '2024-03-05 00:00:00' AS created_at FROM documents")
def new_docs(spark, d):
    inc = B.documents(spark, d).select("doc_id", F.col("lang").alias("language"))
    return Y.new_docs(inc, F.lit("2024-03-05 00:00:00.7")).select("doc_id", "status", "progress", "language", "created_at")


@query("summary_list", with_(B.JOBS) + "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'point ' || doc_id || '|' || tags[1] ELSE '' END AS points FROM jobs")
def summary_list(spark, d):
    return B.jobs(spark, d).select("doc_id", F.array_join(fields.summary_list("summary"), "|").alias("points"))


@query("decode_nested", "SELECT event_id, coalesce((props->>'k')::BIGINT, 0) AS k FROM events")
def decode_nested(spark, d):
    e = B.table(spark, d, "events")
    return e.select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0)).alias("k"))


@query(
    "decode_rows",
    """SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE (props->>'k')::BIGINT END AS k, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS n,
      CASE WHEN event_id % 3 = 0 THEN '' ELSE (props->>'k') || ',' || event_id END AS ks, event_id % 4 > 1 AS publish FROM events""",
)
def decode_rows(spark, d):
    """Several stored columns at once: an object, a list and a flag, each broken or missing in some rows."""
    e, i = B.table(spark, d, "events"), F.col("event_id")
    broken = F.when(i % 5 == 0, F.concat(F.lit("{"), "props")).when(i % 5 == 1, F.lit(None)).otherwise(F.col("props"))
    several = F.when(i % 6 == 0, F.lit("[{")).when(i % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("["), "props", F.lit(', {"k": '), i.cast("string"), F.lit("}]")))
    rows = e.select("event_id", broken.alias("state"), several.alias("parts"), F.when(i % 4 == 0, None).otherwise(i % 4 - 1).alias("publish"))
    out = fields.decode_nested(rows, {"parts": "array<struct<k:bigint>>"}, {"state": "k bigint"}, ("publish", "chain"))
    return out.select("event_id", "state.k", F.size("parts").cast("bigint").alias("n"), F.array_join(F.transform("parts", lambda p: p["k"].cast("string")), ",").alias("ks"), "publish")


@query("uncertain_points", with_(B.SEG, B.CLAIM, VERD) + "SELECT doc_id, count(*) AS uncertain FROM verd WHERE verdict <> 'confirme' GROUP BY doc_id")
def uncertain_points(spark, d):
    v = verdicts(spark, d).filter("verdict <> 'confirme'").select("doc_id", F.lit("fait").alias("kind"))
    return Y.uncertain_points(v)


@query("entities_by_field", with_(B.SEG, B.CLAIM, VERD) + """SELECT doc_id, field, array_to_string(list(citation ORDER BY pos), '|') AS links FROM (
   SELECT doc_id, CASE type WHEN 'nom_propre' THEN 'personnes' WHEN 'organisme' THEN 'organismes' ELSE 'references' END AS field, citation, min(pos) AS pos FROM verd
   WHERE verdict = 'confirme' AND type IN ('nom_propre', 'organisme', 'reference_juridique') GROUP BY ALL) GROUP BY doc_id, field""")
def entities_by_field(spark, d):
    from ..operators.claims import verdict_entities

    return Y.entities_by_field(verdict_entities(verdicts(spark, d))).withColumn("links", F.array_join("links", "|"))


@query("models_used", with_(B.SEG) + "SELECT doc_id, array_to_string(list_sort(list(DISTINCT 'm' || (seg_idx % 3))), ',') AS models FROM seg WHERE seg_idx % 4 <> 0 GROUP BY doc_id")
def models_used(spark, d):
    i = F.col("seg_idx")
    b = B.segments(spark, d).select("doc_id", F.when(i % 4 != 0, F.concat(F.lit("m"), (i % 3).cast("string"))).alias("model"))
    return Y.models_used(b).withColumn("models", F.array_join("models", ","))


@query("search_notes", with_(B.NOTES) + "SELECT path, title FROM notes WHERE contains(lower(strip_accents(title)) || ' ' || lower(strip_accents(array_to_string(aliases, ' '))), 'ti')")
def search_notes(spark, d):
    return Y.search_notes(B.notes(spark, d), "Ti").select("path", "title")


# ---- signal: event values as samples -----------------------------------------

RMS = """
smp AS (SELECT user_id % 4 AS series, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS i, value FROM events),
rms AS (SELECT series, i // 5 AS frame, sqrt(avg(value * value)) AS rms FROM smp GROUP BY ALL)
"""


def profile(spark, d):
    from ..operators.blocks import running

    e = B.table(spark, d, "events").select((F.col("user_id") % 4).alias("series"), "event_id", "value")
    e = running(e, ["series"], ["event_id"], {"n": (F.lit(1), "sum")}).withColumn("i", F.col("n") - 1)
    return G.rms_profile(e, "series", "i", "value", 5)


@query("rms_profile", with_(RMS) + "SELECT series, frame, rms FROM rms")
def rms_profile(spark, d):
    return profile(spark, d)


@query(
    "waveform_peaks",
    with_(RMS) + """SELECT series, frame, CASE WHEN m > 0 THEN round(rms / m, 4) ELSE 0 END AS peak FROM rms JOIN (SELECT series, max(rms) AS m, max(frame) + 1 AS n FROM rms GROUP BY series) USING (series) WHERE frame % greatest(1, (n + 99) // 100) = 0""",
)
def waveform_peaks(spark, d):
    return G.peaks(profile(spark, d), "series", points=100)


QUIET = """
tot AS (SELECT series, max(frame) + 1 AS n FROM rms GROUP BY series),
cand AS MATERIALIZED (SELECT c.series, c.frame AS cursor, n, arg_min(f.frame, {'r': f.rms, 'f': f.frame}) AS best FROM rms c JOIN tot USING (series) JOIN rms f ON f.series = c.series AND f.frame BETWEEN c.frame - 10 AND c.frame + 10 GROUP BY ALL),
cut AS (SELECT series, n, best AS point FROM cand WHERE cursor = 60 AND cursor < n - 30
  UNION ALL
  SELECT c.series, c.n, CASE WHEN c.best <= p.point + 10 THEN c.cursor ELSE c.best END FROM cut p JOIN cand c ON c.series = p.series AND c.cursor = p.point + 60 WHERE c.cursor < c.n - 30)
"""


@query("quiet_points", with_(RMS, QUIET) + "SELECT series, point AS cut FROM cut WHERE point > 0")
def quiet_points(spark, d):
    return G.quiet_points(profile(spark, d), "series", target=60, search=20)


@query("signal_chunks", with_(RMS, QUIET) + """SELECT series, coalesce(lag(z) OVER (PARTITION BY series ORDER BY z), 0) AS "offset", z - coalesce(lag(z) OVER (PARTITION BY series ORDER BY z), 0) AS length
   FROM (SELECT series, point AS z FROM cut UNION ALL SELECT series, n FROM tot)""")
def signal_chunks(spark, d):
    p = profile(spark, d)
    return G.chunks_from_cuts(G.quiet_points(p, "series", target=60, search=20), p, "series")
