"""Transcript tables derived from the given corpus tables.

Segments are the sentences of documents, with times and speakers by rule; pairs
set a segment against a rule-made revision. Each binding has its SQL twin, so
results can be checked by another engine.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def live_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of parts.

    The braces make the path a pattern, which may name a file; a filter on file names would
    leave out every part of a folder.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(os.path.join(sf_dir, f"{{{name}.parquet}}"))


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def sentences(text: Column) -> Column:
    marked = F.regexp_replace(text, r"([.!?])[ \t\n\r]+", "$1\n")
    return F.filter(F.split(marked, "\n"), lambda x: F.trim(x) != "")


def segments(spark, sf_dir, speakers: bool = True) -> DataFrame:
    return segments_of(documents(spark, sf_dir), speakers)


def segments_of(documents: DataFrame, speakers: bool = True) -> DataFrame:
    """doc_id, seg_idx (1-based), start, end, text, speaker, role, confidence, lang, source."""
    docs = documents.select("doc_id", "lang", "source", sentences(F.col("text")).alias("lines"))
    # outer: an inner explode makes the optimizer split every text once more, to test for none
    rows = docs.select("doc_id", "lang", "source", F.posexplode_outer("lines").alias("pos", "line")).filter("pos is not null")
    idx = F.col("seg_idx")
    first_ms = (idx - 1) * 6000 + 1500 * F.floor((idx - 1) / 5)
    turn = F.floor((idx - 1) / 3) % 2
    rows = rows.select(
        "doc_id", "lang", "source", (F.col("pos") + 1).cast("bigint").alias("seg_idx"), F.trim("line").alias("text")
    )
    return rows.select(
        "doc_id", "lang", "source", "seg_idx",
        (first_ms / 1000).alias("start"),
        ((first_ms + F.length("text") * 60) / 1000).alias("end"),
        "text",
        (F.when(idx % 11 == 0, None).when(turn == 0, "S0").otherwise("S1") if speakers else F.lit(None).cast("string")).alias("speaker"),
        F.when(turn == 0, "teacher").otherwise("student").alias("role"),
        F.when(F.length("text") % 7 != 0, (F.length("text") % 100) / 100).alias("confidence"),
    )


def words_of(text: Column, start: Column, end: Column) -> Column:
    """Word entries with times spread evenly over the segment."""
    from ..functions.timing import spread_words

    return spread_words(F.filter(F.split(text, " "), lambda w: w != ""), start, end)


SEG = r"""
seg AS (
  SELECT doc_id, lang, source, seg_idx,
         ((seg_idx - 1) * 6000 + 1500 * ((seg_idx - 1) // 5))::DOUBLE / 1000 AS "start",
         ((seg_idx - 1) * 6000 + 1500 * ((seg_idx - 1) // 5) + length(text) * 60)::DOUBLE / 1000 AS "end",
         text,
         CASE WHEN seg_idx % 11 = 0 THEN NULL WHEN ((seg_idx - 1) // 3) % 2 = 0 THEN 'S0' ELSE 'S1' END AS speaker,
         CASE WHEN ((seg_idx - 1) // 3) % 2 = 0 THEN 'teacher' ELSE 'student' END AS role,
         CASE WHEN length(text) % 7 <> 0 THEN (length(text) % 100)::DOUBLE / 100 END AS confidence
  FROM (SELECT doc_id, lang, source, generate_subscripts(l, 1)::BIGINT AS seg_idx, trim(unnest(l)) AS text
        FROM (SELECT doc_id, lang, source,
                     list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(10), 'g'), chr(10)),
                                 lambda x: trim(x) <> '') AS l
              FROM documents)))
"""


def pairs(spark, sf_dir, speakers: bool = False) -> DataFrame:
    return pairs_of(segments(spark, sf_dir, speakers))


def pairs_of(seg: DataFrame) -> DataFrame:
    """Raw segments against a rule-made revision; block_id follows the segment."""
    idx, text = F.col("seg_idx"), F.col("text")
    clean = (
        F.when(idx % 5 == 0, F.substring(text, 1, F.floor(F.length(text) / 2).cast("int")))
        .when(idx % 2 == 0, F.regexp_replace(text, "[0-9]+", ""))
        .when(idx % 7 == 3, F.regexp_replace(text, "[A-Z]{2,}", "x"))
        .otherwise(text)
    )
    return seg.select(
        "doc_id", "lang", "source", "seg_idx", F.concat(F.lit("segment-"), idx.cast("string")).alias("block_id"),
        "start", "end", text.alias("raw"), clean.alias("clean"),
    )


PAIR = r"""
pair AS (
  SELECT doc_id, lang, source, seg_idx, 'segment-' || seg_idx AS block_id, "start", "end", text AS raw,
         CASE WHEN seg_idx % 5 = 0 THEN substring(text, 1, (length(text) // 2)::INT)
              WHEN seg_idx % 2 = 0 THEN regexp_replace(text, '[0-9]+', '', 'g')
              WHEN seg_idx % 7 = 3 THEN regexp_replace(text, '[A-Z]{2,}', 'x', 'g')
              ELSE text END AS clean
  FROM seg)
"""


def lexicon(spark, sf_dir) -> DataFrame:
    """Terms: distinct ASCII words of 4-8 letters of the benchmark texts.

    pos is the alphabetical position; every fourth term also has an acronym and
    a longer variant, so a term has several names.
    """
    words = (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
        .filter(F.length("term").between(4, 8))
        .groupBy("term").agg(F.min(F.lit(0)).alias("z"))
    )
    h = F.ascii("term") + F.length("term") * 7 + F.ascii(F.reverse("term")) * 3
    return words.select(
        "term",
        h.cast("bigint").alias("h"),
        F.element_at(F.array(*[F.lit(x) for x in ("acteur", "mesure", "autre", "texte", "droit")]), (h % 5 + 1).cast("int")).alias("category"),
        F.when(h % 4 == 0, F.array(F.upper(F.substring("term", 1, 3)))).otherwise(F.array().cast("array<string>")).alias("acronyms"),
        F.when(h % 4 == 1, F.array(F.concat("term", F.lit("s")))).otherwise(F.array().cast("array<string>")).alias("variants"),
        (h % 2 == 0).alias("verified"),
        F.when(h % 3 == 0, F.concat(F.lit("article "), (h % 50 + 400).cast("string"), F.lit(" du code "), F.col("term"))).otherwise("").alias("reference"),
        F.concat(F.lit("Définition de "), F.col("term")).alias("definition"),
        F.col("term").alias("wikilink"),
        F.when(h % 2 == 0, F.array(F.struct(F.lit("t").alias("title"), F.concat(F.lit("https://x/"), F.col("term")).alias("url"))))
        .otherwise(F.array().cast("array<struct<title:string,url:string>>")).alias("sources"),
        F.col("term").alias("pos"),
    )


LEX = r"""
lex AS (
  SELECT term, h, ['acteur','mesure','autre','texte','droit'][h % 5 + 1] AS category,
         CASE WHEN h % 4 = 0 THEN [upper(substring(term, 1, 3))] ELSE CAST([] AS VARCHAR[]) END AS acronyms,
         CASE WHEN h % 4 = 1 THEN [term || 's'] ELSE CAST([] AS VARCHAR[]) END AS variants,
         (h % 2 = 0) AS verified,
         CASE WHEN h % 3 = 0 THEN 'article ' || (h % 50 + 400) || ' du code ' || term ELSE '' END AS reference,
         'Définition de ' || term AS definition, term AS wikilink, term AS pos
  FROM (SELECT term, (ascii(term) + length(term) * 7 + ascii(reverse(term)) * 3)::BIGINT AS h
        FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark)
        WHERE length(term) BETWEEN 4 AND 8))
"""
LEX_NAMES = r"""
lex_names AS (
  SELECT term, pos, category, verified, unnest(names) AS name, generate_subscripts(names, 1)::BIGINT AS name_pos
  FROM (SELECT *, list_concat(list_concat([term], acronyms), variants) AS names FROM lex))
"""


def claims(spark, sf_dir) -> DataFrame:
    """Claims found in documents: numbers, capital words and sentence openings."""
    seg = segments(spark, sf_dir)
    found = F.concat(
        F.transform(
            F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)),
            lambda x: F.struct(F.lit("statistique").alias("type"), x.alias("citation")),
        ),
        F.transform(
            F.regexp_extract_all("text", F.lit("[A-Z]{2,}"), F.lit(0)),
            lambda x: F.struct(F.lit("organisme").alias("type"), x.alias("citation")),
        ),
        F.array(
            F.struct(
                F.when(F.col("seg_idx") % 3 == 0, "reference_juridique").when(F.col("seg_idx") % 3 == 1, "nom_propre").otherwise("date").alias("type"),
                F.regexp_extract("text", "[A-Za-z]+", 0).alias("citation"),
            )
        ),
    )
    return (
        seg.select("doc_id", "seg_idx", "start", F.posexplode(found).alias("k", "c"))
        .select("doc_id", (F.col("seg_idx") * 10000 + F.col("k")).alias("pos"), "seg_idx", "start", "c.type", "c.citation")
        .filter(F.col("citation") != "")
    )


CLAIM = r"""
claim AS (
  SELECT doc_id, seg_idx * 10000 + k - 1 AS pos, seg_idx, "start", c.type AS type, c.citation AS citation
  FROM (SELECT doc_id, seg_idx, "start", unnest(l) AS c, generate_subscripts(l, 1) AS k
        FROM (SELECT doc_id, seg_idx, "start",
                list_concat(list_concat(
                  list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: {'type': 'statistique', 'citation': x}),
                  list_transform(regexp_extract_all(text, '[A-Z]{2,}'), lambda x: {'type': 'organisme', 'citation': x})),
                  [{'type': CASE seg_idx % 3 WHEN 0 THEN 'reference_juridique' WHEN 1 THEN 'nom_propre' ELSE 'date' END,
                    'citation': regexp_extract(text, '[A-Za-z]+')}]) AS l
              FROM seg))
  WHERE c.citation <> '')
"""


def verdict_columns(key: Column) -> dict[str, Column]:
    """A verdict for a claim key, by rule on the key's letters."""
    h = F.length(key) * 13 + F.ascii(F.reverse(key))
    pick = lambda values, step: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(h / step) % len(values) + 1).cast("int"))
    verdict = pick(("corrige", "confirme", "infirme", "introuvable", "ambigu", "corrige"), 1)
    return {
        "verdict": verdict,
        "confidence": pick(("haute", "moyenne", "basse", "haute"), 6),
        "n_sources": (F.floor(h / 5) % 3).cast("bigint"),
        "correct_form": F.when(verdict == "corrige", F.concat(F.upper(key), F.lit("*"))).otherwise(""),
        "age_days": (h % 120).cast("bigint"),
    }


VERDICT_COLS = """
  ['corrige','confirme','infirme','introuvable','ambigu','corrige'][(h // 1) % 6 + 1] AS verdict,
  ['haute','moyenne','basse','haute'][(h // 6) % 4 + 1] AS confidence,
  ((h // 5) % 3)::BIGINT AS n_sources,
  CASE WHEN ['corrige','confirme','infirme','introuvable','ambigu','corrige'][(h // 1) % 6 + 1] = 'corrige' THEN upper(key) || '*' ELSE '' END AS correct_form,
  (h % 120)::BIGINT AS age_days
"""
KEY_HASH = "(length(key) * 13 + ascii(reverse(key)))"


def cases(spark, sf_dir) -> DataFrame:
    """Labelled documents: id, expected, actual by rule, tags, reasons."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    actual = F.when((F.col("n_chars") % 3 == 0) | (F.col("n_chars") < 300), "reject").otherwise("accept")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("expected"),
        actual.alias("actual"),
        F.array("lang", "source").alias("tags"),
        F.when(actual == "accept", F.array().cast("array<string>")).otherwise(
            F.array_compact(F.array(F.when(F.col("n_chars") % 3 == 0, "added_word_ratio"), F.when(F.col("n_chars") < 300, "too_short")))
        ).alias("reasons"),
    )


CASES = r"""
cases AS (
  SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS expected,
         CASE WHEN n_chars % 3 = 0 OR n_chars < 300 THEN 'reject' ELSE 'accept' END AS actual,
         [lang, source] AS tags,
         list_filter([CASE WHEN n_chars % 3 = 0 THEN 'added_word_ratio' END, CASE WHEN n_chars < 300 THEN 'too_short' END], lambda x: x IS NOT NULL) AS reasons
  FROM labels l JOIN documents d USING (doc_id))
"""


def job_events(spark, sf_dir) -> DataFrame:
    """job_id, event_id, ts, status, stage, progress, value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.element_at(
            F.create_map(*[F.lit(x) for x in ("signup", "queued", "view", "running", "click", "transcribed", "purchase", "done", "error", "error")]),
            F.col("event_type"),
        ).alias("status"),
        F.col("event_type").alias("stage"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)).alias("progress"),
        "value",
    )


EV = r"""
ev AS (
  SELECT user_id AS job_id, event_id, ts,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'transcribed'
              WHEN 'purchase' THEN 'done' ELSE 'error' END AS status,
         event_type AS stage, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS progress, value
  FROM events)
"""


def jobs(spark, sf_dir) -> DataFrame:
    """The library: one row per document with state, dates and texts."""
    d, i = documents(spark, sf_dir), F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int"))
    return d.select(
        "doc_id",
        F.concat(F.lit("cours "), F.col("source"), F.lit(" n°"), i.cast("string"), F.lit(".mp3")).alias("filename"),
        F.when(i % 4 != 0, F.concat(F.lit("Leçon "), F.col("lang"), F.lit(" "), (i % 50).cast("string"))).alias("title"),
        F.element_at(F.array(*[F.lit(s) for s in ("queued", "running", "transcribed", "done", "checked", "published", "error", "canceled")]), (i % 8 + 1).cast("int")).alias("status"),
        F.when(i % 3 == 0, "relecture").alias("stage"),
        (day.cast("timestamp") + F.make_dt_interval(secs=(i % 86400).cast("decimal(18,6)"))).alias("created_at"),
        ((F.col("n_chars") % 7200) / 1).alias("duration"),
        F.col("text").alias("raw_text"),
        F.when(i % 5 != 0, F.regexp_replace("text", "[0-9]+", "#")).alias("clean_text"),
        F.when(i % 6 == 0, F.concat(F.lit("vault/"), i.cast("string"), F.lit(".md"))).alias("note_path"),
        F.array("lang", "source").alias("tags"),
        F.when(i % 2 == 0, F.concat(F.lit('["point '), i.cast("string"), F.lit('","'), F.col("lang"), F.lit('"]'))).when(i % 7 == 1, "{broken").alias("summary"),
    )


JOBS = r"""
jobs AS (
  SELECT doc_id, 'cours ' || source || ' n°' || doc_id || '.mp3' AS filename,
         CASE WHEN doc_id % 4 <> 0 THEN 'Leçon ' || lang || ' ' || (doc_id % 50) END AS title,
         ['queued','running','transcribed','done','checked','published','error','canceled'][doc_id % 8 + 1] AS status,
         CASE WHEN doc_id % 3 = 0 THEN 'relecture' END AS stage,
         TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT) + to_seconds((doc_id % 86400)::INT) AS created_at,
         (n_chars % 7200)::DOUBLE AS duration, text AS raw_text,
         CASE WHEN doc_id % 5 <> 0 THEN regexp_replace(text, '[0-9]+', '#', 'g') END AS clean_text,
         CASE WHEN doc_id % 6 = 0 THEN 'vault/' || doc_id || '.md' END AS note_path,
         [lang, source] AS tags,
         CASE WHEN doc_id % 2 = 0 THEN '["point ' || doc_id || '","' || lang || '"]' WHEN doc_id % 7 = 1 THEN '{broken' END AS summary
  FROM documents)
"""


def notes(spark, sf_dir) -> DataFrame:
    """Pages as notes: path, title, aliases (long title words)."""
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.select(
        F.col("page_id").alias("note_id"),
        F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"), title.alias("title"),
        F.filter(F.split(F.regexp_replace(title, "[^A-Za-zÀ-ÿ]+", " "), " "), lambda w: F.length(w) >= 6).alias("aliases"),
    )


NOTES = r"""
notes AS (
  SELECT page_id AS note_id, url || '#' || page_id AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         list_filter(string_split(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-zÀ-ÿ]+', ' ', 'g'), ' '), lambda w: length(w) >= 6) AS aliases
  FROM pages)
"""


def asr_segments(spark, sf_dir) -> DataFrame:
    """Segments with recogniser faults by rule: silence, unknown tokens, loops, lost characters."""
    idx, text = F.col("seg_idx"), F.col("text")
    return segments(spark, sf_dir).withColumn(
        "text",
        F.when(idx % 13 == 0, F.lit(""))
        .when(idx % 17 == 0, F.replace(text, F.lit(" "), F.lit(" <unk> ")))
        .when(idx % 19 == 0, F.repeat(F.concat(F.substring_index(text, " ", 1), F.lit(" ")), 7))
        .when(idx % 23 == 0, F.concat(text, F.lit("�")))
        .otherwise(text),
    )


ASR = r"""
asr AS (
  SELECT * REPLACE (CASE WHEN seg_idx % 13 = 0 THEN '' WHEN seg_idx % 17 = 0 THEN replace(text, ' ', ' <unk> ')
         WHEN seg_idx % 19 = 0 THEN repeat(split_part(text, ' ', 1) || ' ', 7) WHEN seg_idx % 23 = 0 THEN text || chr(65533) ELSE text END AS text)
  FROM seg)
"""


def candidates(spark, sf_dir) -> DataFrame:
    """Pairs with a proposed revision, faulty in a known way for eight of ten rows."""
    p, i, raw = pairs(spark, sf_dir), F.col("seg_idx"), F.col("raw")
    cand = (
        F.when(i % 10 == 0, F.lit(""))
        .when(i % 10 == 1, F.substring(raw, 1, F.floor(F.length(raw) / 2).cast("int")))
        .when(i % 10 == 2, F.concat(F.lit("We need to examine the passage. I will rewrite it for the user: "), raw))
        .when(i % 10 == 3, F.concat(raw, F.repeat(F.lit(" invented words of the rules in this request"), 8)))
        .when(i % 10 == 4, F.concat(F.lit("<think>x</think> "), raw))
        .when(i % 10 == 5, F.concat(raw, F.lit("�")))
        .when(i % 10 == 6, F.concat(F.repeat(F.concat(F.substring_index(raw, " ", 1), F.lit(" ")), 7), raw))
        .when(i % 10 == 7, F.concat(F.lit("Quite another opening line here\n"), raw))
        .otherwise(F.regexp_replace(raw, "[0-9]+", ""))
    )
    return p.withColumn("candidate", cand)


CAND = r"""
cand AS (
  SELECT *, CASE seg_idx % 10 WHEN 0 THEN '' WHEN 1 THEN substring(raw, 1, (length(raw) // 2)::INT)
    WHEN 2 THEN 'We need to examine the passage. I will rewrite it for the user: ' || raw
    WHEN 3 THEN raw || repeat(' invented words of the rules in this request', 8)
    WHEN 4 THEN '<think>x</think> ' || raw WHEN 5 THEN raw || chr(65533)
    WHEN 6 THEN repeat(split_part(raw, ' ', 1) || ' ', 7) || raw WHEN 7 THEN 'Quite another opening line here' || chr(10) || raw
    ELSE regexp_replace(raw, '[0-9]+', '', 'g') END AS candidate
  FROM pair)
"""
