"""Turns, paragraphs, chunks, recogniser issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as Q
from ..functions import text as T
from ..sources import bindings as B
from . import sqlkit as S
from .registry import query, with_

TURNS = r"""
t1 AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY doc_id ORDER BY seg_idx) THEN 0 ELSE 1 END AS opens FROM seg),
t2 AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS turn FROM t1),
turns AS (
  SELECT doc_id, turn::BIGINT AS pos, min(seg_idx) AS first, max(seg_idx) AS last,
         CASE WHEN count(*) = 1 THEN 'segment-' || min(seg_idx) ELSE 'block-' || min(seg_idx) || '-' || max(seg_idx) END AS block_id,
         arg_min("start", seg_idx) AS "start", arg_max("end", seg_idx) AS "end", string_agg(text, ' ' ORDER BY seg_idx) AS text,
         string_agg(text, ' ' ORDER BY seg_idx) AS raw_text, min(confidence) AS confidence,
         arg_min_null(speaker, seg_idx) AS speaker, arg_min(role, seg_idx) AS role, count(*) AS n_segments
  FROM t2 GROUP BY doc_id, turn)
"""


@query("speaker_turns", with_(B.SEG, TURNS) + "SELECT * FROM turns")
def speaker_turns(spark, d):
    return Q.speaker_turns(B.segments(spark, d))


@query(
    "turn_words",
    with_(B.SEG, TURNS)
    + """SELECT t.doc_id, t.pos, t.block_id, count(s.seg_idx) AS n_segments, string_agg('segment-' || s.seg_idx, ' ' ORDER BY s.seg_idx) AS source_segment_ids,
      string_agg(CASE WHEN s.seg_idx % 4 <> 0 THEN array_to_string(list_filter(string_split(s.text, ' '), lambda x: x <> ''), '|') END, '|' ORDER BY s.seg_idx) AS words
    FROM turns t JOIN seg s ON s.doc_id = t.doc_id AND s.seg_idx BETWEEN t.first AND t.last GROUP BY ALL""",
)
def turn_words(spark, d):
    """Turns with the words and the ids of their segments; every fourth segment has no words."""
    seg = B.segments(spark, d)
    seg = seg.withColumn("words", F.when(F.col("seg_idx") % 4 != 0, B.words_of(F.col("text"), F.col("start"), F.col("end"))))
    t = Q.speaker_turns(seg)
    said = F.array_join(F.transform("words", lambda w: w["text"]), "|")
    return t.select("doc_id", "pos", "block_id", "n_segments", F.array_join("source_segment_ids", " ").alias("source_segment_ids"), said.alias("words"))


def para_sql(speaker: str, name: str = "par", src: str = "seg", maxc: int = 1100) -> str:
    return f"""
{name}_n AS (SELECT *, {speaker} AS sp, row_number() OVER w AS rn, lag("end") OVER w AS pe, lag({speaker}) OVER w AS ps
         FROM {src} WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx)),
{name}_r AS (
  SELECT doc_id, rn, seg_idx, seg_idx AS g, length(text) + 1 AS l FROM {name}_n WHERE rn = 1
  UNION ALL
  SELECT n.doc_id, n.rn, n.seg_idx,
         CASE WHEN (n.sp <> n.ps) IS TRUE OR (n."start" - n.pe >= 1.2 AND r.l >= 260) OR r.l >= {maxc} THEN n.seg_idx ELSE r.g END,
         CASE WHEN (n.sp <> n.ps) IS TRUE OR (n."start" - n.pe >= 1.2 AND r.l >= 260) OR r.l >= {maxc} THEN 0 ELSE r.l END + length(n.text) + 1
  FROM {name}_r r JOIN {name}_n n ON n.doc_id = r.doc_id AND n.rn = r.rn + 1),
{name} AS (
  SELECT doc_id, g AS first_idx, max(seg_idx) AS last_idx, arg_min("start", seg_idx) AS "start", arg_max("end", seg_idx) AS "end",
         string_agg(text, ' ' ORDER BY seg_idx) AS text
  FROM (SELECT n.*, r.g FROM {name}_n n JOIN {name}_r r ON n.doc_id = r.doc_id AND n.rn = r.rn) GROUP BY doc_id, g)
"""


@query("paragraphs", with_(B.SEG, para_sql("NULL::VARCHAR")) + "SELECT * FROM par")
def paragraphs(spark, d):
    return Q.paragraphs(B.segments(spark, d, speakers=False))


@query("paragraphs_by_speaker", with_(B.SEG, para_sql("speaker")) + "SELECT * FROM par")
def paragraphs_by_speaker(spark, d):
    return Q.paragraphs(B.segments(spark, d))


CHUNKS = r"""
ch_n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) AS rn, length(text) + 1 AS n,
         regexp_matches(text, '[.!?…]["»'')\]]?\s*$') AS fin FROM seg),
ch_r AS (
  SELECT doc_id, rn, seg_idx AS g, CASE WHEN n >= 1500 OR (n >= 1050 AND fin) THEN 0 ELSE n END AS l FROM ch_n WHERE rn = 1
  UNION ALL
  SELECT c.doc_id, c.rn, CASE WHEN r.l = 0 THEN c.seg_idx ELSE r.g END,
         CASE WHEN r.l + c.n >= 1500 OR (r.l + c.n >= 1050 AND fin) THEN 0 ELSE r.l + c.n END
  FROM ch_r r JOIN ch_n c ON c.doc_id = r.doc_id AND c.rn = r.rn + 1)
"""


@query(
    "chunks",
    with_(B.SEG, CHUNKS)
    + """SELECT doc_id, first_idx, "start", "end", text, row_number() OVER (PARTITION BY doc_id ORDER BY first_idx) - 1 AS chunk_idx
    FROM (SELECT n.doc_id, r.g AS first_idx, round(arg_min("start", seg_idx), 3) AS "start", round(arg_max("end", seg_idx), 3) AS "end",
          string_agg(text, ' ' ORDER BY seg_idx) AS text FROM ch_n n JOIN ch_r r ON n.doc_id = r.doc_id AND n.rn = r.rn GROUP BY n.doc_id, r.g)""",
)
def chunks(spark, d):
    return Q.chunks(B.segments(spark, d), max_chars=1500)


@query(
    "paragraph_blocks",
    with_(
        r"""p0 AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS l FROM documents),
p1 AS (SELECT doc_id, len(l) AS n, generate_subscripts(l, 1)::BIGINT AS p, unnest(l) AS para FROM p0),
p2 AS (SELECT *, length(para) + CASE WHEN p < n THEN 2 ELSE 0 END AS size FROM p1),
p3 AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM p2),
p4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rn FROM p3 WHERE trim(para) <> ''),
r AS (SELECT doc_id, rn, p AS g, CASE WHEN size >= 800 THEN 0 ELSE size END AS l FROM p4 WHERE rn = 1
  UNION ALL
  SELECT c.doc_id, c.rn, CASE WHEN r.l = 0 THEN c.p ELSE r.g END, CASE WHEN r.l + c.size >= 800 THEN 0 ELSE r.l + c.size END
  FROM r JOIN p4 c ON c.doc_id = r.doc_id AND c.rn = r.rn + 1)"""
    )
    + """SELECT c.doc_id, r.g AS first_par, min(upto - size)::BIGINT AS "offset", string_agg(para, chr(10) || chr(10) ORDER BY p) AS text
    FROM p4 c JOIN r ON c.doc_id = r.doc_id AND c.rn = r.rn GROUP BY c.doc_id, r.g""",
)
def paragraph_blocks(spark, d):
    docs = B.documents(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return Q.paragraph_blocks(docs, max_chars=800)


GAPS = r"""
gaps AS (SELECT *, greatest(0.0::DOUBLE, "start" - coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS gap FROM {src})
"""


@query("running_gap", with_(B.SEG, GAPS.format(src="seg")) + "SELECT doc_id, seg_idx, gap FROM gaps")
def running_gap(spark, d):
    return Q.running_gap(B.segments(spark, d)).select("doc_id", "seg_idx", "gap")


ISSUES = GAPS.format(src="asr") + rf""",
iss0 AS (SELECT *, trim(text) AS tx, greatest(0.0::DOUBLE, "end" - "start") AS dur FROM gaps),
iss1 AS (SELECT *, CASE WHEN len(regexp_extract_all(tx, '\S+')) = 0 THEN 0.0::DOUBLE
                        ELSE len(regexp_extract_all(tx, '(?i)<unk>|\[unk\]'))::DOUBLE / len(regexp_extract_all(tx, '\S+')) END AS u FROM iss0),
issues AS (
  SELECT doc_id, seg_idx, "start", "end", 'unk_ratio_eleve' AS issue, round_even(u * 100, 0)::BIGINT || '% de tokens <unk> sur ce segment.' AS detail FROM iss1 WHERE u > 0.2
  UNION ALL SELECT doc_id, seg_idx, "start", "end", 'boucle_de_tokens', 'Répétition massive du même mot ou groupe de mots.' FROM iss1 WHERE {S.loop('tx')}
  UNION ALL SELECT doc_id, seg_idx, "start", "end", 'texte_vide_plage_longue', 'Aucun texte reconnu sur une plage audio longue.' FROM iss1 WHERE tx = '' AND (dur >= 8 OR gap >= 8)
  UNION ALL SELECT doc_id, seg_idx, "start", "end", 'segment_anormalement_long', 'Segment de ' || round_even(dur, 0)::BIGINT || ' s, largement au-dessus du typique.' FROM iss1 WHERE dur >= 45)
"""


@query("asr_issues", with_(B.SEG, B.ASR, ISSUES) + "SELECT * FROM issues")
def asr_issues(spark, d):
    return Q.asr_issues(B.asr_segments(spark, d))


RETRY = r"""
rg AS (SELECT doc_id, seg_idx, "start", "end", list(issue ORDER BY CASE issue WHEN 'boucle_de_tokens' THEN 0 WHEN 'unk_ratio_eleve' THEN 1 ELSE 2 END) AS issues
       FROM issues WHERE issue IN ('boucle_de_tokens', 'unk_ratio_eleve', 'texte_vide_plage_longue') GROUP BY ALL),
rp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) AS rn FROM rg)
"""


@query("retry_groups", with_(B.SEG, B.ASR, ISSUES, RETRY) + "SELECT doc_id, seg_idx, array_to_string(issues, ',') AS issues FROM rg")
def retry_groups(spark, d):
    g = Q.retry_groups(Q.asr_issues(B.asr_segments(spark, d)))
    return g.select("doc_id", "seg_idx", F.array_join("issues", ",").alias("issues"))


@query(
    "retry_plan",
    with_(B.SEG, B.ASR, ISSUES, RETRY)
    + """SELECT rp.doc_id, seg_idx, array_to_string(issues, ',') AS issues, rn <= 3 AS attempted,
      CASE WHEN rn <= 3 THEN greatest(0.0::DOUBLE, "start" - 3) END AS clip_start,
      CASE WHEN rn <= 3 THEN least((n_chars % 7200)::DOUBLE, "end" + 3) END AS clip_end,
      CASE WHEN rn > 3 THEN 'retry_limit_reached' END AS reason FROM rp JOIN documents USING (doc_id)""",
)
def retry_plan(spark, d):
    docs = B.jobs(spark, d).select("doc_id", "duration")
    plan = Q.retry_plan(Q.asr_issues(B.asr_segments(spark, d)), docs, limit=3)
    return plan.withColumn("issues", F.array_join("issues", ","))


@query(
    "previous_tail",
    with_(B.SEG, para_sql("NULL::VARCHAR"))
    + """SELECT doc_id, first_idx, CASE WHEN length(p) <= 400 THEN p WHEN instr(right(p, 400), ' ') > 0 THEN substring(right(p, 400), instr(right(p, 400), ' ') + 1) ELSE right(p, 400) END AS context
    FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY first_idx) AS p FROM par)""",
)
def previous_tail(spark, d):
    return Q.previous_tail(Q.paragraphs(B.segments(spark, d, speakers=False))).select("doc_id", "first_idx", "context")


@query(
    "neighbour_bounds",
    with_(B.SEG)
    + """SELECT doc_id, pos, CASE WHEN ne <= ns OR ns < 0 THEN 'bounds' WHEN ns < pe THEN 'overlaps_previous' WHEN ne > nx THEN 'overlaps_next' END AS reason
    FROM (SELECT doc_id, seg_idx AS pos, "start" - (seg_idx % 3) AS ns, "end" + (seg_idx % 5) - 2 AS ne,
            lag("end") OVER w AS pe, lead("start") OVER w AS nx FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx))""",
)
def neighbour_bounds(spark, d):
    b = B.segments(spark, d).select(
        "doc_id", F.col("seg_idx").alias("pos"), "start", "end",
        (F.col("start") - F.col("seg_idx") % 3).alias("new_start"), (F.col("end") + F.col("seg_idx") % 5 - 2).alias("new_end"),
    )
    return Q.neighbour_bounds(b).select("doc_id", "pos", "reason")


@query(
    "first_occurrence",
    with_(B.SEG, B.CLAIM)
    + f"""SELECT doc_id, key, pos, citation FROM (SELECT *, type || ':' || {S.match_norm('citation')} AS key,
        row_number() OVER (PARTITION BY doc_id, type || ':' || {S.match_norm('citation')} ORDER BY pos) AS rn FROM claim) WHERE rn = 1""",
)
def first_occurrence(spark, d):
    c = B.claims(spark, d).select("doc_id", T.cache_key("type", "citation").alias("key"), "pos", "citation")
    return Q.first_occurrence(c, ["doc_id", "key"])


@query(
    "nearest_occurrence",
    with_(B.SEG)
    + """SELECT doc_id, seg_idx, CASE WHEN len(ps) = 0 THEN -1 ELSE (ps[1]).p END AS at_pos FROM (
      SELECT doc_id, seg_idx, list_sort(list_transform(list_filter(range(1, length(text) - 1), lambda i: substring(text, i, 3) = 'the'), lambda i: {'d': abs(i - 1 - length(text) // 2), 'p': i - 1})) AS ps FROM seg)""",
)
def nearest_occurrence(spark, d):
    place = Q.nearest_occurrence(F.col("text"), F.lit("the"), F.floor(F.length("text") / 2))
    return B.segments(spark, d).select("doc_id", "seg_idx", place.cast("bigint").alias("at_pos"))


WRAP = r"""w AS (SELECT doc_id, seg_idx, string_split(coalesce(speaker || ': ', '') || text, ' ') AS w FROM seg),
w2 AS (SELECT doc_id, seg_idx, list_filter(w, lambda x: x <> '') AS w FROM w),
r AS (SELECT doc_id, seg_idx, w, 1 AS i, '' AS done, w[1] AS line FROM w2
  UNION ALL
  SELECT doc_id, seg_idx, w, i + 1, CASE WHEN length(line) + 1 + length(w[i + 1]) > 42 THEN done || line || chr(10) ELSE done END,
         CASE WHEN length(line) + 1 + length(w[i + 1]) > 42 THEN w[i + 1] ELSE line || ' ' || w[i + 1] END FROM r WHERE i < len(w))"""


@query(
    "subtitle_wrap",
    with_(
        B.SEG,
        WRAP,
    )
    + "SELECT doc_id, seg_idx, done || line AS text FROM r WHERE i = len(w)",
)
def subtitle_wrap(spark, d):
    seg = B.segments(spark, d)
    return seg.select("doc_id", "seg_idx", Q.subtitle_text(F.col("text"), F.col("speaker")).alias("text"))


@query("segments_to_text", with_(B.SEG) + "SELECT doc_id, (seg_idx - 1) // 4096 AS part, string_agg(text, ' ' ORDER BY seg_idx) AS content FROM seg GROUP BY ALL")
def segments_to_text(spark, d):
    return Q.segments_to_text(B.segments(spark, d))
