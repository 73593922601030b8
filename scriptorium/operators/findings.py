"""Fidelity findings between a raw text and its revision."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CONTRACT, DEFAULT_PACK, SEVERITIES, RulePack
from ..functions import text as T
from ..functions.align import align
from ..session import checkpointed
from .lexicon import lookup, near_misses

LENGTH_ALERT, PRE_ALERT = DEFAULT_CONTRACT.melted_ratio, DEFAULT_CONTRACT.drift_ratio
FINDING = ("doc_id", "block_id", "kind", "severity", "message", "start", "raw_excerpt", "source")


def _lost() -> Column:
    lost = lambda kind, of: F.transform(
        T.bag_missing(of("raw"), of("clean")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token"))
    )
    return F.concat(lost("chiffre", T.numbers), lost("terme", T.acronyms))


def _melted() -> Column:
    return (F.col("raw") != "") & (F.length("clean") < F.length("raw") * LENGTH_ALERT)


def lost_tokens(pairs: DataFrame) -> DataFrame:
    """Numbers and acronyms said but not written, in one pass over the pairs."""
    return pairs.select(*pairs.columns, F.explode_outer(_lost()).alias("t")).filter("t is not null").select(*pairs.columns, "t.kind", "t.token")


def _filled(label: str, **values: Column) -> Column:
    """A label with its {names} filled in."""
    parts = re.split(r"\{(\w+)\}", label)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def rule_findings(pairs: DataFrame, names: DataFrame | None = None, *, context: bool = False, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """Lost numbers, lost acronyms, melted passages and near-names.

    ``context`` adds ``clean_excerpt``, the place in the revised text.
    """
    # one pass: every finding of a pair is an element of one array; an unchanged text loses nothing
    cut = F.when(_melted(), F.array(F.struct(F.lit("coupure").alias("kind"), F.lit("").alias("token"))))
    none = F.array().cast("array<struct<kind:string,token:string>>")
    changed = pairs.filter(F.col("raw") != F.col("clean"))
    found = changed.select(*pairs.columns, F.explode_outer(F.concat(_lost(), F.coalesce(cut, none))).alias("t")).filter("t is not null")
    found = found.select(*pairs.columns, "t.kind", "t.token")
    kind, token = F.col("kind"), F.col("token")
    known = F.lit(False)
    if names is not None:
        # the search reads its citations several times: kept, the texts behind them are read once
        cited = checkpointed(found.filter("kind = 'terme'").select(token.alias("citation")).distinct())
        terms = lookup(cited, names, verified_only=False)
        found = found.join(terms.select(F.col("citation").alias("token"), F.lit(True).alias("known")), "token", "left")
        known = F.coalesce("known", F.lit(False))
    percent = F.rint((1 - F.length("clean") / F.length("raw")) * 100).cast("bigint").cast("string")
    said = lambda k: _filled(pack.findings[k], token=token, percent=percent)
    message = F.when(kind == "chiffre", said("chiffre")).when(kind == "terme", said("terme")).otherwise(said("coupure"))
    raw_part, clean_part = T.excerpt("raw", "token"), []
    if context:
        only = lambda c, wanted: F.when(wanted, F.col(c))
        is_cut = kind == "coupure"
        found = found.withColumns({
            "_a": align(only("raw", is_cut), only("clean", is_cut)),
            "_m": T.missing_context(only("raw", ~is_cut), only("clean", ~is_cut), token),
        })
        raw_part = F.when(is_cut & F.col("_a.raw_start").isNotNull(), T.excerpt_at(F.col("raw"), F.col("_a.raw_start"))).otherwise(raw_part)
        clean_part = [F.when(is_cut, T.excerpt_at(F.col("clean"), F.col("_a.clean_start"))).otherwise(F.col("_m")).alias("clean_excerpt")]
    out = found.select(
        "doc_id", "block_id", "kind", F.when((kind == "terme") & ~known, "moyenne").otherwise("haute").alias("severity"),
        message.alias("message"), "start", raw_part.alias("raw_excerpt"), F.lit("regles").alias("source"), *clean_part,
    )
    if names is None:
        return out
    # the lexicon pass needs only keys; the texts come back for the rows it finds
    near = near_misses(pairs.select("doc_id", "block_id", "clean"), "clean", names).drop("pos")
    short = F.max("short") if "short" in names.columns else F.max(F.lit(""))
    near = near.join(names.groupBy("term").agg(short.alias("short")), "term")
    # many words of a text may be near a name: its blanks are squeezed once, before they meet
    clean = ["clean"] if context else []
    near = near.join(pairs.select("doc_id", "block_id", "start", T.squeeze("raw").alias("raw"), *clean), ["doc_id", "block_id"])
    message = _filled(pack.findings["lexique"], word=F.col("near_word"), term=F.col("term"), short=F.col("short"))
    lexical = near.select(
        "doc_id", "block_id", F.lit("lexique").alias("kind"), F.lit("basse").alias("severity"), message.alias("message"),
        "start", T.excerpt_of_flat("raw", "near_word").alias("raw_excerpt"), F.lit("lexique").alias("source"),
        *([T.excerpt("clean", "near_word").alias("clean_excerpt")] if context else []),
    )
    return out.unionByName(lexical)


def severity_counts(findings: DataFrame, by: list[str] = ["doc_id"]) -> DataFrame:
    return findings.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "haute", 0).when(severity == "moyenne", 1).when(severity == "basse", 2).otherwise(3)


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), "start", "doc_id", "block_id", "message")


def verify_report(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per document: counts by severity, checked and skipped pairs."""
    checked = pairs.groupBy("doc_id").agg(
        F.count("*").alias("checked_pairs"),
        F.count_if(T.is_blank("raw") | T.is_blank("clean")).alias("skipped_pairs"),
    )
    counts = severity_counts(findings)
    return checked.join(counts, "doc_id", "left").fillna(0, subset=list(SEVERITIES))


def merge_findings(first: DataFrame, second: DataFrame) -> DataFrame:
    """One list of two reports; counts follow by ``severity_counts``."""
    return first.unionByName(second, allowMissingColumns=True)


def pairs_at_risk(pairs: DataFrame, findings: DataFrame, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """Pairs worth a second reading: a finding, a legal reference, or drift in length.

    Findings meet pairs by block id, or by start where a pair has no id.
    """
    by_id = findings.filter(F.col("block_id").isNotNull()).select("doc_id", "block_id").distinct().withColumn("_i", F.lit(True))
    by_start = findings.filter(F.col("block_id").isNull()).select("doc_id", "start").distinct().withColumn("_s", F.lit(True))
    drift = (F.col("raw") != "") & (F.length("clean") < F.length("raw") * PRE_ALERT)
    legal = T.has_legal_reference("raw", pack) | T.has_legal_reference("clean", pack)
    flagged = pairs.join(by_id, ["doc_id", "block_id"], "left").join(by_start, ["doc_id", "start"], "left")
    found = F.when(F.col("block_id").isNotNull(), F.col("_i")).otherwise(F.col("_s"))
    return flagged.filter(F.coalesce(found, F.lit(False)) | legal | drift).select(*pairs.columns)


def pairs_with_findings(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Semi join on two keys: block id where set, else start."""
    named = pairs.filter(F.col("block_id").isNotNull()).join(
        findings.filter(F.col("block_id").isNotNull()).select("doc_id", "block_id"), ["doc_id", "block_id"], "left_semi"
    )
    unnamed = pairs.filter(F.col("block_id").isNull()).join(
        findings.filter(F.col("block_id").isNull()).select("doc_id", "start"), ["doc_id", "start"], "left_semi"
    )
    return named.select(*pairs.columns).unionByName(unnamed.select(*pairs.columns))


def basic_proofread(paragraphs: DataFrame, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """Paragraphs cleaned by rule; blank results are dropped."""
    # exploding a filtered array cleans once; a filter on the column would clean twice
    kept = F.filter(F.array(T.clean_line("text", pack)), lambda c: c != "")
    return paragraphs.select("*", F.explode_outer(kept).alias("clean")).filter("clean is not null").select(
        "doc_id", F.concat_ws("-", F.lit("block"), F.col("first_idx").cast("string"), F.col("last_idx").cast("string")).alias("block_id"),
        "first_idx", "last_idx", "start", "end", F.col("text").alias("raw"), "clean",
    )
