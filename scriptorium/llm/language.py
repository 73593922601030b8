"""Language of a transcript by rank-order profiles of character n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "und"
MAX_LANGUAGES = 1000
BORDER = 1  # stands for any run of characters that are no letters


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1-, 2- and 3-grams of the letters, and their counts.

    Case is ignored, words have a border on both sides, no gram spans two words. A gram
    is one integer of 21 bits a character.
    """
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    chars = np.where(_letters()[chars], chars, BORDER)
    chars = np.concatenate(([BORDER], chars, [BORDER]))
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != BORDER) | (chars[:-1] != BORDER)
    chars = chars[keep]
    if len(chars) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = chars[:-1] << 21 | chars[1:]
    triples = pairs[:-1] << 21 | chars[2:]
    grams = np.concatenate((chars[chars != BORDER], pairs, triples[chars[1:-1] != BORDER]))
    return np.unique(grams, return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent grams first, ties by the gram itself."""
    return grams[np.lexsort((grams, -counts))[:size]]


def trained_on(doc_id: str | Column) -> Column:
    """True for rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def held_out(doc_id: str | Column) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn_profiles(
    jobs: DataFrame, *, doc_id: str = "doc_id", text: str = "raw_text", language: str = "language", sample: int = 1000, size: int = 300,
) -> dict[str, list[int]]:
    """Language -> its most frequent n-grams, in order of rank.

    At most ``sample`` labelled jobs a language are read, those whose id hashes lowest
    among ``trained_on`` rows; jobs without id, text or language take no part. At most
    ``size`` grams a language come to the driver, of at most ``MAX_LANGUAGES`` languages;
    more labels than that are an error. No labelled job: no profile.
    """
    rows = jobs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("raw_text"), F.col(language).alias("language"))
    rows = rows.filter(trained_on("doc_id") & F.col("language").isNotNull() & F.col("raw_text").isNotNull())
    # hashes below twice the wanted share first, so that a language of most rows is no large sort
    known = rows.groupBy("language").agg(F.count(F.lit(1)).alias("known")).limit(MAX_LANGUAGES + 1)
    if known.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).cast("double")
    likely = rows.select("doc_id", "language").join(F.broadcast(known), "language").filter(part * F.col("known") < float((1 << 32) * (2 * sample + 100)))
    order = W.partitionBy("language").orderBy(part, "doc_id")
    chosen = likely.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)
    chosen = chosen.select("doc_id", F.col("language").alias("label"))
    # bounded: sample rows a language
    texts = rows.join(F.broadcast(chosen), (rows.doc_id == chosen.doc_id) & (rows.language == chosen.label), "left_semi")

    def count(batches):
        for batch in batches:
            counts: dict[str, list] = {}
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(label, []).append(ngrams(value))
            for label, found in counts.items():
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([c for _, c in found]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"language": pa.array([label] * len(grams), pa.string()), "gram": grams, "n": sums})

    counts = texts.select("language", "raw_text").mapInArrow(count, "language string, gram bigint, n bigint")
    totals = counts.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    best = W.partitionBy("language").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).select("language", "gram", "rank")
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("language", "rank").toLocalIterator():  # size grams of at most MAX_LANGUAGES
        profiles.setdefault(row["language"], []).append(row["gram"])
    return profiles


class Ranker:
    """Out-of-place distances of one text to every profile."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.languages = size, sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        for k, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[name], np.int64)), k] = np.arange(len(profiles[name]))

    def distances(self, text: str) -> np.ndarray | None:
        """Sum over the text's grams of how far their rank is from the profile's; ``size`` where the profile lacks it."""
        own = ranked(*ngrams(text), self.size)
        if not len(own) or not self.languages:
            return None
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[at]
        off = np.abs(ranks - np.arange(len(own))[:, None])
        return np.where(ranks < 0, self.size, np.minimum(off, self.size)).sum(0) / (len(own) * self.size)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = None if text is None else self.distances(text)
        if found is None:
            return UNKNOWN, 0.0
        best = int(found.argmin())
        return self.languages[best], float(1 - found[best])


def identify_language(
    jobs: DataFrame, profiles: dict[str, list[int]], *, text: str = "raw_text", size: int = 300, to: str = "detected",
) -> DataFrame:
    """Jobs with ``detected``: struct of ``lang_pred`` and ``score``.

    The whole transcript is ranked and compared to each profile; the nearest language
    wins, ties go to the first in alphabetical order. The score is one less the mean
    distance, 0 to 1. Null texts, texts without a letter and an empty set of profiles
    give ``und`` and 0. Every row stays, repeated ones too; a column that is already
    named ``to`` is replaced.
    """
    ranker = Ranker(profiles, size)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        found = [ranker.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"]
        )

    return jobs.withColumn(to, guess.asNondeterministic()(F.col(text)))
