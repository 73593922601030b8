"""Documents to training sequences: language ID, quality rules, near copies, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, all but the last with the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import language, neardup, packing, quality
from scriptorium.session import shared_dir

#: A text that scores this much below this percentile of its language's labelled documents is not text in that language.
LOW_PERCENTILE, MARGIN = 0.01, 0.1


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def least_scores(docs: DataFrame, profiles: dict[str, list[int]]) -> dict[str, float]:
    """Language -> the least score of a text in it, from all labelled documents that may be learned from.

    Only documents found in their own language count. A language that none is found in has no limit.
    """
    taught = docs.select("text", "lang").filter(language.trained_on(docs["doc_id"]) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = language.identify_language(taught, profiles, text="text").filter("detected.lang_pred = lang")
    low = found.groupBy("lang").agg(F.percentile_approx("detected.score", LOW_PERCENTILE, 10_000).alias("low"))
    return {row["lang"]: row["low"] - MARGIN for row in low.collect()}  # a row a language, of at most language.MAX_LANGUAGES


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null texts, texts without letters, noise and other languages go.

    Without any labelled document nothing can be told and all texts with letters stay.
    """
    to = _free(docs, "detected")
    profiles = language.learn_profiles(docs, text="text", language="lang")
    found = language.identify_language(docs, profiles, text="text", to=to)
    if profiles:
        limits = [x for pair in least_scores(docs, profiles).items() for x in map(F.lit, pair)]
        least = F.coalesce(F.create_map(*limits)[F.col(f"{to}.lang_pred")], F.lit(0.0)) if limits else F.lit(0.0)
        known = (F.col(f"{to}.lang_pred") != language.UNKNOWN) & (F.col(f"{to}.score") >= least)
    else:
        known = F.col("text").rlike(r"\p{L}")
    return found.filter(known).select(*[F.col(f"`{c}`") for c in docs.columns])


def readable(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules and the compression bands, learned from all of them, keep."""
    to = _free(docs, "quality")
    bands = quality.learn_bands(docs, text="text")
    return quality.quality_rules(docs, text="text", bands=bands, to=to).filter(F.col(f"{to}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return neardup.drop_copies(docs, text="text", groups=neardup.similar_groups)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with sequence and place."""
    return packing.pack_transcripts(docs, public_tokenizers.path("word_bpe_49k.json"), text="text")


STAGES = [("language ID", known_language), ("quality rules", readable), ("near-dedup", distinct), ("best-fit packing", packed)]

#: Compression, fingerprints and tokenizers cannot be stated in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
