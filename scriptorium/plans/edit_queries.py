"""Batch edits on blocks derived from segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as E, sequence as Q
from ..sources import bindings as B
from .library_queries import ANN, annotations
from .registry import query, with_
from .sequence_queries import TURNS

AS_OF = "2024-06-01 00:00:00"


def blocks(spark, d, words: bool = False):
    """One block per segment."""
    seg, i = B.segments(spark, d), F.col("seg_idx")
    out = seg.select(
        "doc_id", i.alias("pos"), F.concat(F.lit("segment-"), i.cast("string")).alias("block_id"), "start", "end", "text",
        F.col("text").alias("raw_text"), "speaker", "role", (i % 2).alias("review_version"),
    )
    if words:
        timed = F.transform(B.words_of(F.col("text"), F.col("start"), F.col("end")), lambda w: w.withField("confidence", F.lit(0.5)))
        out = out.withColumn("words", timed)
    return out


def marks(spark, d):
    a = annotations(spark, d)
    return a.select("doc_id", "seg_idx", "block_id", F.lit(3).cast("bigint").alias("range_start"), (F.col("seg_idx") % 40 + 4).alias("range_end"))


@query(
    "set_text",
    with_(B.SEG) + """SELECT doc_id, seg_idx AS pos, CASE WHEN seg_idx % 3 = 0 THEN 'Neuf ' || text || ' fin' ELSE text END AS text, n AS n_words, floor(round("start" + ("end" - "start") / n, 3) * 10)::BIGINT AS first_end
      FROM (SELECT *, (len(list_filter(string_split(text, ' '), lambda x: x <> '')) + CASE WHEN seg_idx % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS n FROM seg)""",
)
def set_text(spark, d):
    b = blocks(spark, d, words=True)
    e = b.filter("pos % 3 = 0").select("doc_id", "block_id", F.concat(F.lit("Neuf "), "text", F.lit(" fin")).alias("text"), F.lit(1).alias("seq"))
    out = E.set_text(b, e)
    return out.select("doc_id", "pos", "text", F.size("words").cast("bigint").alias("n_words"), F.floor(F.element_at("words", 1)["end"] * 10).alias("first_end"))


@query(
    "set_bounds",
    with_(B.SEG)
    + """SELECT doc_id, seg_idx AS pos, CASE WHEN ok THEN round(ns, 3) ELSE "start" END AS "start", CASE WHEN ok THEN round(ne, 3) ELSE "end" END AS "end", seg_idx % 4 = 0 AND NOT ok AS refused FROM (
      SELECT *, seg_idx % 4 = 0 AND ne > ns AND ns >= 0 AND (pe IS NULL OR ns >= pe) AND (nx IS NULL OR ne <= nx) AS ok FROM (
        SELECT *, "start" + 0.5 AS ns, "end" - 0.25 AS ne, lag("end") OVER w AS pe, lead("start") OVER w AS nx FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx)))""",
)
def set_bounds(spark, d):
    b = blocks(spark, d)
    e = b.filter("pos % 4 = 0").select("doc_id", "block_id", (F.col("start") + 0.5).alias("new_start"), (F.col("end") - 0.25).alias("new_end"), F.lit(1).alias("seq"))
    out, refused = E.set_bounds(b, e)
    said = refused.select("doc_id", "block_id", F.lit(True).alias("_r"))
    return out.join(said, ["doc_id", "block_id"], "left").select("doc_id", "pos", "start", "end", F.coalesce("_r", F.lit(False)).alias("refused"))


@query(
    "rename_speaker",
    with_(B.SEG)
    + "SELECT doc_id, seg_idx, CASE WHEN speaker = 'S0' AND doc_id % 2 = 0 THEN 'Prof' WHEN speaker = 'S1' AND doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM seg WHERE seg_idx = 4) THEN 'Eleve' ELSE speaker END AS speaker FROM seg",
)
def rename_speaker(spark, d):
    b = blocks(spark, d)
    one = b.filter("pos = 1 and doc_id % 2 = 0").select("doc_id", "block_id", F.lit("Prof").alias("speaker"), F.lit(1).alias("seq"))
    four = b.filter("pos = 4 and doc_id % 3 = 0").select("doc_id", "block_id", F.lit("Eleve").alias("speaker"), F.lit(2).alias("seq"))
    return E.rename_speaker(b, one.unionByName(four)).select("doc_id", F.col("pos").alias("seg_idx"), "speaker")


@query("set_role", with_(B.SEG) + "SELECT doc_id, seg_idx, CASE WHEN speaker = 'S0' AND doc_id % 2 = 0 THEN 'invité' ELSE role END AS role FROM seg")
def set_role(spark, d):
    b = blocks(spark, d)
    e = b.filter("pos = 1 and doc_id % 2 = 0").select("doc_id", "block_id", F.lit("invité").alias("role"), F.lit(1).alias("seq"))
    return E.set_role(b, e).select("doc_id", F.col("pos").alias("seg_idx"), "role")


# every fifth block is cut before its word 4, and what is left of it before word 2; a last cut lies outside
SPLIT = """
sp AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM seg),
cu AS (SELECT *, seg_idx % 5 = 0 AND len(w) > 4 AS far, seg_idx % 5 = 0 AND len(w) > 2 AS near FROM sp)
"""


def cuts(b):
    orders = F.array(*[F.struct(F.lit(k).alias("word_index"), F.lit(seq).alias("seq")) for seq, k in enumerate((4, 2, 3))])
    return b.filter("pos % 5 = 0").select("doc_id", "block_id", F.explode(orders).alias("e")).select("doc_id", "block_id", "e.*")


@query(
    "split_blocks",
    with_(B.SEG, SPLIT)
    + """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx, h) AS pos, text FROM (
      SELECT doc_id, seg_idx, 0 AS h, CASE WHEN near THEN w[1] || ' ' || w[2] ELSE text END AS text FROM cu
      UNION ALL SELECT doc_id, seg_idx, 1, CASE WHEN far THEN w[3] || ' ' || w[4] ELSE array_to_string(w[3:], ' ') END FROM cu WHERE near
      UNION ALL SELECT doc_id, seg_idx, 2, array_to_string(w[5:], ' ') FROM cu WHERE far)""",
)
def split_blocks(spark, d):
    b = blocks(spark, d, words=True)
    return E.split_blocks(b, marks(spark, d), cuts(b))[0].select("doc_id", "pos", "text")


@query(
    "refused_cuts",
    with_(B.SEG, SPLIT)
    + """SELECT doc_id, 's' || seg_idx AS block_id, seq, k AS word_index, CASE WHEN seq = 9 THEN 'bloc_inconnu' ELSE 'hors_du_bloc' END AS reason FROM (
      SELECT doc_id, seg_idx, 0::BIGINT AS seq, 4::BIGINT AS k FROM cu WHERE seg_idx % 5 = 0 AND NOT far UNION ALL SELECT doc_id, seg_idx, 1, 2 FROM cu WHERE seg_idx % 5 = 0 AND NOT near
      UNION ALL SELECT doc_id, seg_idx, 2, 3 FROM cu WHERE seg_idx % 5 = 0 UNION ALL SELECT doc_id, -seg_idx, 9, 1 FROM cu WHERE seg_idx % 10 = 0)""",
)
def refused_cuts(spark, d):
    b = blocks(spark, d, words=True).withColumn("block_id", F.concat(F.lit("s"), F.col("pos").cast("string")))
    unknown = b.filter("pos % 10 = 0").select("doc_id", F.concat(F.lit("s-"), F.col("pos").cast("string")).alias("block_id"), F.lit(1).alias("word_index"), F.lit(9).alias("seq"))
    return E.refused_cuts(b, cuts(b).unionByName(unknown)).withColumns({"seq": F.col("seq").cast("bigint"), "word_index": F.col("word_index").cast("bigint")})


@query(
    "split_annotations",
    with_(B.SEG, SPLIT)
    + """SELECT doc_id, seg_idx, s1 - CASE WHEN m2 THEN p2 ELSE 0 END AS range_start, CASE WHEN m2 THEN t1 - p2 WHEN near AND NOT m1 AND t1 > p2 THEN p2 ELSE t1 END AS range_end, m1 OR m2 AS moved
    FROM (SELECT *, near AND NOT m1 AND s1 >= p2 AS m2 FROM (
      SELECT *, CASE WHEN m1 THEN 3 - p4 ELSE 3 END AS s1, CASE WHEN m1 THEN t - p4 WHEN far AND t > p4 THEN p4 ELSE t END AS t1 FROM (
        SELECT *, far AND 3 >= p4 AS m1 FROM (
          SELECT *, seg_idx % 40 + 4 AS t, length(array_to_string(w[:4], ' ')) AS p4, length(array_to_string(w[:2], ' ')) AS p2 FROM cu))))""",
)
def split_annotations(spark, d):
    b = blocks(spark, d, words=True)
    a = E.split_blocks(b, marks(spark, d), cuts(b))[1]
    return a.select("doc_id", "seg_idx", "range_start", "range_end", F.contains("block_id", F.lit("-split-")).alias("moved"))


MERGE = """
mg AS (SELECT *, sum(CASE WHEN seg_idx > 1 AND (seg_idx - 1) % 4 IN (1, 2) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seg_idx)::BIGINT AS g FROM seg)
"""


@query("merge_with_next", with_(B.SEG, MERGE) + """SELECT doc_id, g AS pos, 'segment-' || min(seg_idx) AS block_id, arg_min("start", seg_idx) AS "start", arg_max("end", seg_idx) AS "end", string_agg(text, ' ' ORDER BY seg_idx) AS text FROM mg GROUP BY doc_id, g""")
def merge_with_next(spark, d):
    b = blocks(spark, d)
    return E.merge_with_next(b, marks(spark, d), b.filter("pos % 4 in (1, 2)"))[0].select("doc_id", "pos", "block_id", "start", "end", "text")


@query(
    "merge_annotations",
    with_(B.SEG, MERGE)
    + """SELECT doc_id, seg_idx, 'segment-' || min(seg_idx) OVER (PARTITION BY doc_id, g) AS block_id, (3 + coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, g ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS range_start FROM mg""",
)
def merge_annotations(spark, d):
    b = blocks(spark, d)
    return E.merge_with_next(b, marks(spark, d), b.filter("pos % 4 in (1, 2)"))[1].select("doc_id", "seg_idx", "block_id", "range_start")


@query("find_replace", with_(B.SEG) + "SELECT doc_id, seg_idx, regexp_replace(text, '(?i)tion', '$1\\\\', 'g') AS text FROM seg")
def find_replace(spark, d):
    return E.find_replace(blocks(spark, d), "TION", "$1\\").select("doc_id", F.col("pos").alias("seg_idx"), "text")


HIST = "hist AS (SELECT doc_id, seg_idx AS pos, seg_idx % 2 AS review_version, text FROM seg)"


@query(
    "restore_version",
    with_(B.SEG, HIST)
    + """SELECT doc_id, pos, review_version, text FROM hist WHERE doc_id % 2 = 1
      UNION ALL SELECT doc_id, pos, (SELECT max(review_version) + 1 FROM hist h2 WHERE h2.doc_id = hist.doc_id), text FROM hist WHERE doc_id % 2 = 0 AND review_version = 1""".replace(
        "FROM hist WHERE doc_id % 2 = 1\n", "FROM hist WHERE doc_id % 2 = 1 OR doc_id NOT IN (SELECT doc_id FROM hist WHERE review_version = 1)\n"),
)
def restore_version(spark, d):
    b = blocks(spark, d)
    history = E.archive_version(b, "Avant", F.lit(AS_OF))
    req = b.filter("doc_id % 2 = 0").select("doc_id").distinct().withColumn("version", F.lit(1).cast("bigint"))
    return E.restore_version(b, history, req, F.lit(AS_OF))[0].select("doc_id", "pos", "review_version", "text")


@query(
    "restore_annotations",
    with_(B.SEG, ANN, HIST)
    + """SELECT doc_id, seg_idx, seg_idx % 2 AS review_version FROM ann
      UNION ALL SELECT doc_id, seg_idx, (SELECT max(review_version) + 1 FROM hist WHERE hist.doc_id = ann.doc_id) FROM ann
      WHERE doc_id % 2 = 0 AND seg_idx % 2 = 1 AND seg_idx % 2 = (SELECT max(review_version) FROM hist WHERE hist.doc_id = ann.doc_id)""",
)
def restore_annotations(spark, d):
    """Annotations of the version that is current when it is archived come back as the next version's."""
    b = blocks(spark, d)
    a = annotations(spark, d).select("doc_id", "seg_idx", "block_id", (F.col("seg_idx") % 2).alias("review_version"))
    history = E.archive_annotations(a, b, "Avant", F.lit(AS_OF))
    req = b.filter("doc_id % 2 = 0").select("doc_id").distinct().withColumn("version", F.lit(1).cast("bigint"))
    return E.restore_annotations(a, history, b, req).select("doc_id", "seg_idx", "review_version")


@query("versions", with_(B.SEG) + "SELECT doc_id, seg_idx % 2 AS review_version, count(*) AS n_blocks FROM seg GROUP BY ALL")
def versions(spark, d):
    return E.versions(E.archive_version(blocks(spark, d), "Avant", F.lit(AS_OF))).select("doc_id", "review_version", "n_blocks")


@query(
    "legacy_docs",
    with_(B.SEG)
    + """SELECT doc_id FROM (SELECT doc_id, bool_or(speaker = ps) AS b FROM (SELECT *, lag(speaker) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS ps FROM seg) GROUP BY doc_id) WHERE b AND doc_id % 4 <> 0 AND doc_id % 5 <> 0""",
)
def legacy_docs(spark, d):
    b = blocks(spark, d)
    b = b.withColumn("text", F.when((F.col("doc_id") % 5 == 0) & (F.col("pos") == 1), F.lit("édité")).otherwise(F.col("text")))
    return E.legacy_docs(b, B.segments(spark, d), annotations(spark, d).filter("doc_id % 4 = 0"))


@query("regroup_legacy_blocks", with_(B.SEG, TURNS) + "SELECT doc_id, block_id, text FROM turns WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, bool_or(speaker = ps) AS b FROM (SELECT *, lag(speaker) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS ps FROM seg) GROUP BY doc_id) WHERE b)")
def regroup_legacy_blocks(spark, d):
    seg = B.segments(spark, d)
    docs = E.legacy_docs(blocks(spark, d), seg, annotations(spark, d).filter("false"))
    return Q.speaker_turns(seg.join(docs, "doc_id", "left_semi")).select("doc_id", "block_id", "text")


@query("annotation_upsert", with_(B.SEG, ANN) + "SELECT doc_id, seg_idx, CASE WHEN seg_idx % 2 = 0 THEN 'valide' ELSE status END AS status, type FROM ann")
def annotation_upsert(spark, d):
    a = annotations(spark, d).select("doc_id", "seg_idx", "type", "status")
    change = a.filter("seg_idx % 2 = 0").select("doc_id", "seg_idx", F.lit("valide").alias("status"), F.lit(2).alias("seq"))
    older = change.withColumns({"status": F.lit("ignore"), "seq": F.lit(1)})
    return E.upsert(a, change.unionByName(older), ["doc_id", "seg_idx"]).select("doc_id", "seg_idx", "status", "type")


@query("annotation_delete", with_(B.SEG, ANN) + "SELECT doc_id, seg_idx FROM ann WHERE seg_idx % 3 <> 0")
def annotation_delete(spark, d):
    a = annotations(spark, d).select("doc_id", "seg_idx")
    return E.delete_rows(a, a.filter("seg_idx % 3 = 0"), ["doc_id", "seg_idx"])


@query("list_annotations", with_(B.SEG, ANN) + "SELECT doc_id, seg_idx FROM ann WHERE seg_idx % 2 = doc_id % 2")
def list_annotations(spark, d):
    a = annotations(spark, d).select("doc_id", "seg_idx", (F.col("seg_idx") % 2).alias("review_version"), F.col("seg_idx").alias("created_at"))
    jobs = B.documents(spark, d).select("doc_id", (F.col("doc_id") % 2).alias("review_version"))
    return E.list_annotations(a, jobs).select("doc_id", "seg_idx")


@query("delete_docs", with_(B.SEG, ANN) + "SELECT doc_id, seg_idx FROM ann WHERE doc_id % 7 <> 0")
def delete_docs(spark, d):
    a = annotations(spark, d)
    gone = B.documents(spark, d).filter("doc_id % 7 = 0")
    return E.delete_docs(gone, a)[0].select("doc_id", "seg_idx")


@query("blocks_to_text", with_(B.SEG) + "SELECT doc_id, (seg_idx - 1) // 4096 AS part, string_agg(text, chr(10) || chr(10) ORDER BY seg_idx) AS content FROM seg GROUP BY ALL")
def blocks_to_text(spark, d):
    return E.blocks_to_text(blocks(spark, d))


@query(
    "lexicon_edits",
    with_(B.LEX)
    + """SELECT term, CASE WHEN h % 3 = 1 THEN 'neuf' ELSE 'ajout' END AS category, definition FROM lex WHERE h % 5 = 0 AND h % 3 <> 2
       UNION ALL SELECT term, 'neuf', definition FROM lex WHERE h % 5 <> 0 AND h % 3 = 1""",
)
def lexicon_edits(spark, d):
    lex = B.lexicon(spark, d).select("term", "category", "definition", "h")
    overlay = lex.filter("h % 5 = 0").withColumn("category", F.lit("ajout")).drop("h")
    log = lex.filter("h % 3 > 0").select(
        "term", F.when(F.col("h") % 3 == 1, "save").otherwise("delete").alias("op"), F.lit("neuf").alias("category"), F.lit(1).alias("seq")
    )
    return E.lexicon_edits(overlay, lex.drop("h"), log)


@query(
    "manual_review_status",
    with_(B.JOBS, B.SEG) + """SELECT doc_id, CASE WHEN has THEN CASE doc_id % 4 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'completed' END END AS manual_review_status,
      CASE WHEN doc_id % 4 < 3 AND NOT has THEN 'no_segments' WHEN doc_id % 4 = 2 THEN 'status' END AS reason
      FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM seg) AS has FROM jobs)""",
)
def manual_review_status(spark, d):
    jobs = B.jobs(spark, d).select("doc_id")
    i = F.col("doc_id") % 4
    req = jobs.filter("doc_id % 4 < 3").withColumn("status", F.when(i == 0, "in_progress").when(i == 1, "completed").otherwise("perdu"))
    done, refused = E.manual_review_status(jobs, B.segments(spark, d), req)
    return done.join(refused.select("doc_id", "reason"), "doc_id", "left")
