"""Scalar rules over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULT_PACK
from ..functions import fields, text as T, timing
from ..sources import bindings as B
from . import sqlkit as S
from .registry import query, with_

# The corpus is invented prose in four languages: a pack of its frequent words.
CORPUS_PACK = replace(
    DEFAULT_PACK,
    fillers=("the", "of", "le", "la", "der", "und", "el", "in"),
    legit_doubles=("on", "que", "die"),
    native_markers=("le", "la", "les", "de", "et", "des", "un", "une", "que", "qui"),
    foreign_markers=("the", "of", "and", "in", "to", "that", "is", "was", "it", "for"),
)
FILL, DOUB = CORPUS_PACK.fillers, CORPUS_PACK.legit_doubles
DOC = "SELECT doc_id, {e} FROM documents"
SEG = with_(B.SEG) + "SELECT doc_id, seg_idx, {e} FROM seg"
PAIR = with_(B.SEG, B.PAIR) + "SELECT doc_id, seg_idx, {e} FROM pair"


def docs_query(name, column, sql):
    @query(name, DOC.replace("{e}", sql))
    def run(spark, d):
        return B.documents(spark, d).select("doc_id", *column())


def seg_query(name, column, sql):
    @query(name, SEG.replace("{e}", sql))
    def run(spark, d):
        return B.segments(spark, d).select("doc_id", "seg_idx", *column())


def pair_query(name, column, sql):
    @query(name, PAIR.replace("{e}", sql))
    def run(spark, d):
        return B.pairs(spark, d).select("doc_id", "seg_idx", *column())


def joined(c):
    return F.array_join(c, "|")


docs_query("strip_fillers", lambda: [T.strip_fillers("text", CORPUS_PACK).alias("text")], S.strip_fillers("text", FILL) + " AS text")
docs_query("collapse_repeats", lambda: [T.collapse_repeats("text", CORPUS_PACK).alias("text")], S.collapse_repeats("text", DOUB) + " AS text")
docs_query("fix_typography", lambda: [T.fix_typography("text").alias("text")], S.fix_typography("text") + " AS text")


@query(
    "clean_line",
    with_(
        B.SEG,
        f"a AS MATERIALIZED (SELECT doc_id, seg_idx, {S.strip_fillers('text', FILL)} AS t FROM seg)",
        f"b AS MATERIALIZED (SELECT doc_id, seg_idx, {S.collapse_repeats('t', DOUB)} AS t FROM a)",
    )
    + f"SELECT doc_id, seg_idx, {S.fix_typography('t')} AS text FROM b",
)
def clean_line(spark, d):
    return B.segments(spark, d).select("doc_id", "seg_idx", T.clean_line("text", CORPUS_PACK).alias("text"))


docs_query("numbers", lambda: [joined(T.numbers("text")).alias("numbers")], f"array_to_string({S.numbers('text')}, '|') AS numbers")
docs_query("acronyms", lambda: [joined(T.acronyms("text")).alias("acronyms")], f"array_to_string({S.acronyms('text')}, '|') AS acronyms")
docs_query("fold", lambda: [T.fold("text").alias("folded")], S.fold("text") + " AS folded")
seg_query("norm_key", lambda: [T.norm_key("text").alias("key")], S.norm_key("text") + " AS key")
seg_query("norm_title", lambda: [T.norm_title("text").alias("key")], S.norm_title("text") + " AS key")
seg_query(
    "match_norm",
    lambda: [T.match_norm("text").alias("norm"), T.cache_key("role", "text").alias("key")],
    f"{S.match_norm('text')} AS norm, role || ':' || {S.match_norm('text')} AS key",
)
seg_query(
    "slug",
    lambda: [T.slug("text").alias("slug")],
    r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7f]', '', 'g')), '[^a-z0-9\s-]', '', 'g'), '[\s_]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'cours') AS slug",
)
docs_query("word_tokens", lambda: [F.size(T.tokens("text")).cast("bigint").alias("n_tokens"), F.md5(F.array_join(T.tokens("text"), " ")).alias("h")],
           f"len({S.tokens('text')})::BIGINT AS n_tokens, md5(array_to_string({S.tokens('text')}, ' ')) AS h")
docs_query("compare_words", lambda: [F.md5(F.array_join(T.compare_words("text"), " ")).alias("h"), F.md5(T.retry_norm("text")).alias("retry_h")],
           f"md5(array_to_string({S.compare_words('text')}, ' ')) AS h, md5(array_to_string(regexp_extract_all(lower(text), '{S.WORDS}|<unk>'), ' ')) AS retry_h")
seg_query(
    "excerpt",
    lambda: [T.excerpt("text").alias("head"), T.excerpt("text", F.regexp_extract("text", r"[a-z]+\.", 0)).alias("around")],
    f"{S.excerpt('text')} AS head, {S.excerpt('text', chr(39).join(['regexp_extract(text, ', '[a-z]+[.]', ')']))} AS around",
)
seg_query(
    "unk_ratio",
    lambda: [F.round(T.unk_ratio(F.replace(F.col("text"), F.lit(" the "), F.lit(" <unk> "))), 6).alias("ratio")],
    r"(SELECT CASE WHEN len(regexp_extract_all(t, '\S+')) = 0 THEN 0.0 ELSE round(len(regexp_extract_all(t, '(?i)<unk>|\[unk\]'))::DOUBLE / len(regexp_extract_all(t, '\S+')), 6) END FROM (SELECT replace(text, ' the ', ' <unk> ') AS t)) AS ratio",
)
docs_query(
    "repetition_loop",
    lambda: [T.repetition_loop("text").alias("loop"), T.loop_score("text").alias("score")],
    f"{S.loop('text')} AS loop, ({S.loop('text')})::INT::DOUBLE AS score",
)
seg_query(
    "timecode",
    lambda: [timing.timecode(F.col("start")).alias("srt"), timing.timecode(F.col("end") * 7.3, ".").alias("vtt"), timing.short_timecode(F.col("end")).alias("short")],
    f"{S.timecode('''\"start\"''')} AS srt, {S.timecode('(\"end\" * 7.3::DOUBLE)', '.')} AS vtt, split_part({S.timecode('\"end\"')}, ',', 1) AS short",
)
seg_query(
    "clock",
    lambda: [timing.clock(F.col("start") * 20).alias("clock")],
    """(SELECT CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(((s // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0')
        ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END FROM (SELECT floor("start" * 20)::BIGINT AS s)) AS clock""",
)
seg_query(
    "clip_bounds",
    lambda: [c.alias(n) for n, c in (
        ("clip_start", timing.clip_bounds(F.col("start"), F.col("end"), F.lit(600.0))["clip_start"]),
        ("clip_end", timing.clip_bounds(F.col("start"), F.col("end"), F.lit(600.0))["clip_end"]))],
    'greatest(0.0::DOUBLE, "start" - 3.0::DOUBLE) AS clip_start, least(600.0::DOUBLE, "end" + 3.0::DOUBLE) AS clip_end',
)
seg_query(
    "shift_times",
    lambda: [F.array_join(F.transform(
        timing.shift_words(B.words_of(F.col("text"), F.col("start"), F.col("end")), F.lit(12.5)),
        lambda w: F.concat(F.rint(w["start"] * 10).cast("bigint").cast("string"), F.lit(":"), w["text"])), " ").alias("words")],
    """(SELECT array_to_string(list_transform(range(1, len(w) + 1), lambda i:
         round_even(round(round("start" + (i - 1) * (("end" - "start") / len(w)), 3) + 12.5, 3) * 10, 0)::BIGINT || ':' || w[i]), ' ')
        FROM (SELECT list_filter(string_split(text, ' '), lambda x: x <> '') AS w)) AS words""",
)
pair_query(
    "sensitive_refs",
    lambda: [joined(F.array_sort(T.sensitive_refs("raw"))).alias("raw_refs"), T.same_set(T.sensitive_refs("raw"), T.sensitive_refs("clean")).alias("same")],
    f"array_to_string(list_sort({S.sensitive('raw')}), '|') AS raw_refs, (list_sort({S.sensitive('raw')}) = list_sort({S.sensitive('clean')})) AS same",
)
seg_query(
    "meta_markers",
    lambda: [joined(T.meta_markers(F.concat(F.when(F.col("seg_idx") % 4 == 0, "We need to look. ").otherwise(""), F.col("text"), F.when(F.col("seg_idx") % 6 == 0, " I will do it; we need to. Paragraph 3 : x").otherwise("")))).alias("markers"),
             joined(T.model_artifacts(F.concat(F.when(F.col("seg_idx") % 5 == 0, "<think> a </think>").otherwise(""), F.col("text"), F.when(F.col("seg_idx") % 9 == 0, "\nAssistant: x").otherwise("")))).alias("artifacts")],
    """array_to_string(list_sort(list_filter([CASE WHEN seg_idx % 6 = 0 THEN 'i will' END, CASE WHEN seg_idx % 6 = 0 THEN 'paragraph 3 :' END,
        CASE WHEN seg_idx % 4 = 0 OR seg_idx % 6 = 0 THEN 'we need to' END], lambda x: x IS NOT NULL)), '|') AS markers,
       array_to_string(list_filter([CASE WHEN seg_idx % 5 = 0 THEN '</think>' END, CASE WHEN seg_idx % 5 = 0 THEN '<think>' END, CASE WHEN seg_idx % 9 = 0 THEN 'assistant:' END], lambda x: x IS NOT NULL), '|') AS artifacts""",
)
seg_query(
    "yaml_str",
    lambda: [fields.yaml_str(F.concat(F.lit(" "), F.col("text"), F.lit('"'))).alias("quoted"), fields.yaml_str("role").alias("plain"), fields.yaml_list(F.array("role", "text")).alias("items")],
    """'"' || replace(replace(' ' || text || '"', '\\', '\\\\'), '"', '\\"') || '"' AS quoted, role AS plain,
       '[' || role || ', ' || CASE WHEN regexp_matches(text, '[:#{}\\[\\]&*!|>''"%@`,]') THEN '"' || replace(replace(text, '\\', '\\\\'), '"', '\\"') || '"' ELSE text END || ']' AS items""".replace("\\\\", "\\"),
)
seg_query(
    "safe_filename",
    lambda: [fields.safe_filename(F.concat(F.col("source"), F.lit("/"), F.col("text")), "md").alias("download"), fields.filename_for(F.concat(F.lit("2024-01-01 — "), F.col("text"))).alias("note"), fields.safe_name("text").alias("entity")],
    r"""(SELECT substring(coalesce(nullif(regexp_replace(regexp_replace(trim(regexp_replace(stem, '[^\p{L}\p{N}_\- ]+', '', 'g')), '\s+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document'), 1, 80) || '.md'
         FROM (SELECT CASE WHEN regexp_full_match(b, '(?s)(.+)\.[^.]+') THEN regexp_replace(b, '(?s)\.[^.]+$', '') ELSE b END AS stem
               FROM (SELECT string_split(p, '/')[-1] AS b FROM (SELECT regexp_replace(source || '/' || text, '/+$', '') AS p)))) AS download,
        substring(regexp_replace(regexp_replace(trim(regexp_replace('2024-01-01 — ' || text, '[\\/:*?"<>|\x00-\x1f]', '', 'g')), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 150) AS note,
        coalesce(nullif(trim(regexp_replace(text, '[\\/:*?"<>|\x00-\x1f]', '', 'g')), ''), 'Sans titre') AS entity""",
)
seg_query(
    "confidence",
    lambda: [timing.confidence_class(F.col("confidence")).alias("css"), timing.confidence_from_logprob(-F.col("confidence") * 2).alias("score")],
    """CASE WHEN confidence IS NULL OR confidence >= 0.8 THEN '' WHEN confidence >= 0.6 THEN 'conf-mid' ELSE 'conf-low' END AS css,
       round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0 + (-confidence * 2) / 1.5::DOUBLE)), 3) AS score""",
)


@query(
    "locate",
    with_(
        B.SEG, B.PAIR,
        f"""f AS (SELECT doc_id, seg_idx, {S.fingerprint('raw')} AS hp, {S.fingerprint("'«' || substring(clean, 3, 30) || '.'")} AS fp,
              list_filter(list_transform(range(0, length(raw)), lambda i: CASE WHEN regexp_full_match(substring(raw, i + 1, 1), '[\\p{{L}}\\p{{N}}]') THEN i END), lambda i: i IS NOT NULL) AS places
              FROM (SELECT * FROM pair ))""",
    )
    + """SELECT doc_id, seg_idx, CASE WHEN length(fp) >= 4 AND instr(hp, fp) > 0 THEN places[instr(hp, fp)] END AS at_start,
       CASE WHEN length(fp) >= 4 AND instr(hp, fp) > 0 THEN places[instr(hp, fp) + length(fp) - 1] + 1 END AS at_end FROM f""",
)
def locate(spark, d):
    span = T.locate_span("raw", F.concat(F.lit("«"), F.substring("clean", 3, 30), F.lit(".")), 4)
    return B.pairs(spark, d).select("doc_id", "seg_idx", span["start"].alias("at_start"), span["end"].alias("at_end"))


