"""Candidate acceptance, retries and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, text as T
from ..operators import evaluate as E, sequence as Q, validate as V
from ..sources import bindings as B
from . import sqlkit as S
from .findings_queries import names
from .registry import query, with_
from .sequence_queries import ISSUES
from .text_queries import CORPUS_PACK

_NAT, _FOR = S.q(CORPUS_PACK.native_markers), S.q(CORPUS_PACK.foreign_markers)
_part = lambda f, n, size: f"(({f}) >= 4 AND ({f})::DOUBLE / ({size}) >= 0.30::DOUBLE AND ({f}) > ({n}))"
_sum = lambda l, a, b: f"coalesce(list_sum({l}[{a}:{b}]), 0)"
SIGNALS = f"""
sg0 AS MATERIALIZED (SELECT *, {S.compare_words('raw')} AS rw, {S.compare_words('candidate')} AS cw, {S.tokens('raw')} AS rt, {S.tokens('candidate')} AS ct,
    {S.numbers('raw')} AS rn_, {S.numbers('candidate')} AS cn_, {S.acronyms('raw')} AS ra_, {S.acronyms('candidate')} AS ca_,
    list_filter(string_split(candidate, chr(10)), lambda x: trim(x) <> '') AS lines FROM cand),
sg1 AS MATERIALIZED (SELECT *, list_transform(cw, lambda w: list_contains(rw, w)::INT) AS flags, {S.compare_words("coalesce(lines[1], '')")} AS ow,
    list_transform(ct, lambda w: (w IN ({_FOR}))::INT) AS ff, list_transform(ct, lambda w: (w IN ({_NAT}))::INT) AS nf,
    coalesce(list_sum(list_transform(rt, lambda w: (w IN ({_NAT}))::INT)), 0) AS raw_native,
    list_sum(list_transform([{_FOR}], lambda m: greatest(len(list_filter(ct, lambda w: w = m)) - len(list_filter(rt, lambda w: w = m)), 0))) AS introduced FROM sg0),
signals AS (SELECT doc_id, seg_idx, block_id, lang, len(rt)::BIGINT AS words_raw, len(ct)::BIGINT AS words_candidate,
    round({S.missing_ratio('rn_', 'cn_')}, 4) AS altered_numbers, round({S.missing_ratio('ra_', 'ca_')}, 4) AS altered_acronyms,
    CASE WHEN len(lines) > 1 AND len(ow) >= 4 AND len(rw) >= 8 AND len(cw) >= 8 THEN round(list_sum(list_transform(ow, lambda w: list_contains(rw, w)::INT))::DOUBLE / len(ow), 4) END AS opening_support,
    CASE WHEN len(rw) >= 8 AND len(cw) >= 8 THEN round(list_max(list_transform(range(1, len(cw) - 6), lambda i: list_sum(flags[i:i+7])))::DOUBLE / 8, 4) END AS support_8,
    len(ct) >= 8 AND raw_native >= 2 AND introduced >= 4 AND ({_part(_sum('ff', 1, 'len(ff)'), _sum('nf', 1, 'len(nf)'), 'len(ct)')}
      OR len(list_filter(range(1, len(ct) - 10), lambda i: {_part(_sum('ff', 'i', 'i+11'), _sum('nf', 'i', 'i+11'), '12')})) > 0) AS language_leak
  FROM sg1)
"""


@query("candidate_signals", with_(B.SEG, B.PAIR, B.CAND, SIGNALS) + "SELECT doc_id, seg_idx, words_raw, words_candidate, altered_numbers, altered_acronyms, opening_support, support_8, language_leak FROM signals")
def candidate_signals(spark, d):
    return V.signals(B.candidates(spark, d), CORPUS_PACK).select(
        "doc_id", "seg_idx", "words_raw", "words_candidate", "altered_numbers", "altered_acronyms", "opening_support", "support_8", "language_leak"
    )


def validated(spark, d, windows=(8,), lexicon=False):
    return V.validate(
        B.candidates(spark, d), keys=["doc_id", "seg_idx"], names=names(spark, d) if lexicon else None, pack=CORPUS_PACK, windows=windows
    )


@query("validate_candidates")
def validate_candidates(spark, d):
    return validated(spark, d, lexicon=True).select(
        "doc_id", "seg_idx", "valid", F.array_join("reasons", ",").alias("reasons"), "added_words", "longest_added_span", "added_word_ratio"
    )


@query("accept_or_fallback")
def accept_or_fallback(spark, d):
    return V.accept_or_fallback(validated(spark, d), CORPUS_PACK).select("doc_id", "seg_idx", "text", "validation_status", "reject_reason")


@query("rejection_findings")
def rejection_findings(spark, d):
    return V.rejection_findings(V.accept_or_fallback(validated(spark, d), CORPUS_PACK))


@query(
    "loose_gate",
    with_(B.SEG, B.PAIR, B.CAND)
    + f"""SELECT doc_id, seg_idx, contains(candidate, chr(65533)) AS refused,
       (length(candidate) < length(raw) * 0.55::DOUBLE OR ({S.loop('candidate')} AND NOT {S.loop('raw')})) AS fell_back FROM cand""",
)
def loose_gate(spark, d):
    out = V.loose_gate(B.candidates(spark, d), CORPUS_PACK)
    return out.select("doc_id", "seg_idx", "refused", ((F.col("text") != F.col("candidate")) | (F.length("candidate") < F.length("raw") * 0.55)).alias("fell_back"))


RESP = r"""
resp AS (SELECT doc_id, seg_idx, text, CASE seg_idx % 5
   WHEN 0 THEN text WHEN 1 THEN '<revised>draft</revised> then <Revised> ' || text || ' </revised>'
   WHEN 2 THEN '<revised>  </revised>' WHEN 3 THEN 'Here: ```json ' || chr(10) || '{"text": "ok ' || seg_idx || '"}' || chr(10) || '```' ELSE 'x {"text": "in ' || seg_idx || '"} y' END AS response FROM seg)
"""


@query(
    "candidates_from_responses",
    with_(B.SEG, RESP)
    + """SELECT doc_id, seg_idx, CASE seg_idx % 5 WHEN 1 THEN text END AS delimited, CASE seg_idx % 5 WHEN 1 THEN text WHEN 3 THEN 'ok ' || seg_idx WHEN 4 THEN 'in ' || seg_idx END AS structured FROM resp""",
)
def candidates_from_responses(spark, d):
    i = F.col("seg_idx")
    n = i.cast("string")
    resp = (
        F.when(i % 5 == 0, F.col("text"))
        .when(i % 5 == 1, F.concat(F.lit("<revised>draft</revised> then <Revised> "), "text", F.lit(" </revised>")))
        .when(i % 5 == 2, "<revised>  </revised>")
        .when(i % 5 == 3, F.concat(F.lit('Here: ```json \n{"text": "ok '), n, F.lit('"}\n```')))
        .otherwise(F.concat(F.lit('x {"text": "in '), n, F.lit('"} y')))
    )
    return B.segments(spark, d).withColumn("response", resp).select(
        "doc_id", "seg_idx", fields.candidate("response").alias("delimited"), fields.candidate("response", True).alias("structured")
    )


def retries(spark, d):
    seg = B.asr_segments(spark, d)
    i = F.col("seg_idx")
    first = Q.asr_issues(seg).filter(F.col("issue") != "segment_anormalement_long").groupBy("doc_id", "seg_idx").agg(F.min("issue").alias("issue"))
    good = B.segments(spark, d).select("doc_id", "seg_idx", F.col("text").alias("good"))
    retry = (
        F.when(i % 4 == 0, F.lit("")).when(i % 6 == 1, F.concat("good", F.lit(" 99")))
        .when(i % 9 == 2, F.repeat(F.concat("good", F.lit(" ")), 6)).otherwise(F.col("good"))
    )
    return seg.join(first, ["doc_id", "seg_idx"]).join(good, ["doc_id", "seg_idx"]).select(
        "doc_id", "seg_idx", F.col("text").alias("original"), retry.alias("retry"), "issue"
    )


@query("choose_retry")
def choose_retry(spark, d):
    return V.choose_retry(retries(spark, d)).select("doc_id", "seg_idx", "issue", "action", "reason", F.round("similarity", 4).alias("similarity"))


@query("effective_segments")
def effective_segments(spark, d):
    return V.effective_segments(B.asr_segments(spark, d), V.choose_retry(retries(spark, d))).select("doc_id", "seg_idx", "text")


@query(
    "effective_words",
    with_(B.SEG)
    + """SELECT doc_id, seg_idx, CASE WHEN new THEN 'encore ' || text ELSE text END AS text, array_to_string(CASE WHEN new AND seg_idx % 2 = 0 THEN w[2:] ELSE w END, '|') AS words
    FROM (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w, seg_idx % 3 = 0 AND text <> '' AS new FROM seg)""",
)
def effective_words(spark, d):
    """Texts and words laid over where a retry is used; every other used retry brings words of its own."""
    seg = B.segments(spark, d).withColumn("words", B.words_of(F.col("text"), F.col("start"), F.col("end")))
    i = F.col("seg_idx")
    tries = seg.select(
        "doc_id", "seg_idx", F.when(i % 3 == 0, "use_retry").otherwise("keep_original").alias("action"), F.concat(F.lit("encore "), "text").alias("retry"),
        F.when(i % 2 == 0, F.slice("words", 2, F.greatest(F.size("words"), F.lit(0)))).alias("effective_words"))
    said = F.array_join(F.transform("words", lambda w: w["text"]), "|")
    return V.effective_segments(seg, tries).select("doc_id", "seg_idx", "text", said.alias("words"))


CONF = """
conf AS (SELECT count(*) AS total, count(*) FILTER (expected = 'accept' AND actual = 'accept') AS true_accept, count(*) FILTER (expected = 'reject' AND actual = 'reject') AS true_reject,
  count(*) FILTER (expected = 'reject' AND actual = 'accept') AS false_accept, count(*) FILTER (expected = 'accept' AND actual = 'reject') AS false_reject FROM cases)
"""


@query(
    "confusion",
    with_(B.CASES, CONF)
    + """SELECT *, (true_accept + true_reject)::DOUBLE / total AS accuracy, coalesce(false_accept::DOUBLE / nullif(true_reject + false_accept, 0), 0) AS false_accept_rate,
      coalesce(false_reject::DOUBLE / nullif(true_accept + false_reject, 0), 0) AS false_reject_rate FROM conf""",
)
def confusion(spark, d):
    return E.confusion(B.cases(spark, d))


@query("per_tag_accuracy", with_(B.CASES) + "SELECT tag, count(*) AS total, count(*) FILTER (expected = actual) AS correct FROM (SELECT *, unnest(tags) AS tag FROM cases) GROUP BY tag")
def per_tag_accuracy(spark, d):
    return E.per_tag(B.cases(spark, d))


@query("reason_histogram", with_(B.CASES) + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM cases WHERE actual = 'reject') GROUP BY reason")
def reason_histogram(spark, d):
    return E.reason_histogram(B.cases(spark, d))


@query("action_accuracy", with_(B.CASES) + "SELECT expected, actual, count(*) AS n, count(*) FILTER (expected = actual) AS correct FROM cases GROUP BY ALL")
def action_accuracy(spark, d):
    return E.action_accuracy(B.cases(spark, d))


@query("divergences", with_(B.CASES) + "SELECT id, expected, actual, CASE WHEN expected = 'reject' THEN 'false_accept' ELSE 'false_reject' END AS outcome FROM cases WHERE expected <> actual")
def divergences(spark, d):
    return E.divergences(B.cases(spark, d)).select("id", "expected", "actual", "outcome")


@query("evaluation_report", with_(B.CASES, CONF) + "SELECT false_accept = 0 AND false_reject = 0 AS gate, total, false_accept FROM conf")
def evaluation_report(spark, d):
    r = E.evaluation_report(B.cases(spark, d))
    return r.select("gate", F.get_json_object("report", "$.total").cast("bigint").alias("total"), F.get_json_object("report", "$.false_accept").cast("bigint").alias("false_accept"))


@query("evaluation_text", with_(B.CASES) + """SELECT line FROM (SELECT 'x' AS line) WHERE false UNION ALL
  SELECT rpad(tag, 20, ' ') || ' ' || c || '/' || t || ' correct' FROM (SELECT tag, count(*) AS t, count(*) FILTER (expected = actual) AS c FROM (SELECT *, unnest(tags) AS tag FROM cases) GROUP BY tag)
  UNION ALL SELECT rpad(reason, 24, ' ') || ' ' || n FROM (SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM cases WHERE actual = 'reject') GROUP BY reason)
  UNION ALL SELECT rpad(k, 15, ' ') || v FROM (SELECT unnest(['TOTAL', 'TRUE ACCEPT', 'TRUE REJECT', 'FALSE ACCEPT', 'FALSE REJECT']) AS k, unnest([total, true_accept, true_reject, false_accept, false_reject]) AS v FROM
    (SELECT count(*) AS total, count(*) FILTER (expected = 'accept' AND actual = 'accept') AS true_accept, count(*) FILTER (expected = 'reject' AND actual = 'reject') AS true_reject,
     count(*) FILTER (expected = 'reject' AND actual = 'accept') AS false_accept, count(*) FILTER (expected = 'accept' AND actual = 'reject') AS false_reject FROM cases))""")
def evaluation_text(spark, d):
    return E.text_report(B.cases(spark, d)).select("line")


@query("guardrail_evaluation")
def guardrail_evaluation(spark, d):
    """Validation of every candidate, scored against the label of its row."""
    v = validated(spark, d).withColumn("expected", F.when(F.col("seg_idx") % 10 >= 8, "accept").otherwise("reject"))
    return E.confusion(v.withColumn("actual", F.when(F.col("valid"), "accept").otherwise("reject")))


@query("threshold_sweep")
def threshold_sweep(spark, d):
    v = validated(spark, d, windows=E.WINDOWS).withColumn("expected", F.when(F.col("seg_idx") % 10 >= 8, "accept").otherwise("reject"))
    return E.threshold_sweep(v)
