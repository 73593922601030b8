"""Passages of labelled evaluation cases inside transcripts, by winnowing. DataFrame functions only."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Between words stands any run of ASCII characters that are neither digits nor letters; other characters belong to words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: A table is sent to every executor up to this many bytes, counted first; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def words_of(text: Column, lower=lambda t: F.translate(t, string.ascii_uppercase, string.ascii_lowercase)) -> Column:
    """Words of a text with A-Z lowered; none for null."""
    return F.array_remove(F.split(lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row: inside a lambda a plain expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _spanned(base: Column, size: int, merge, then, done: int = 1) -> Column:
    """``then(spans)`` where element i of spans merges elements i to i + size - 1; the last size - 1 are incomplete.

    Spans double with every step, and the last two parts may overlap, which a minimum and a
    hash both allow.
    """
    if done >= size:
        return then(base)
    by = min(done, size - done)
    step = F.zip_with(base, F.slice(base, by + 1, F.size(base)), merge)
    return _let(step, lambda spans: _spanned(spans, size, merge, then, done + by))


def gram_words(window: int) -> int:
    """Words of a k-gram, so that a window holds about as many k-grams as a k-gram has words."""
    return window // 2 + 1


def window_minima(text: Column, window: int, then) -> Column:
    """``then(minima)``: the least k-gram hash inside each window of ``window`` words, by its first word.

    Equal windows have equal minima. All letters are lowered here, which is faster than A-Z
    alone and only lets more windows meet; the caller compares the words themselves.
    """
    k = gram_words(window)
    mix = lambda a, b: F.xxhash64(a, b)
    hashes = F.transform(words_of(text, F.lower), lambda word: F.xxhash64(word))
    cut = lambda minima: F.slice(minima, 1, F.greatest(F.size(minima) - (window - 1), F.lit(0)))
    least = lambda grams: _spanned(grams, window - k + 1, lambda a, b: F.least(a, b), lambda minima: _let(cut(minima), then))
    return _let(hashes, lambda h: _spanned(h, k, mix, least))


def fingerprints(text: Column, window: int) -> Column:
    """Winnowed fingerprints: array of (size, least, first, last), a row for each run of windows with the same minimum.

    A text shorter than the window has none. Texts that share ``window`` words share a
    fingerprint, wherever the words stand.
    """

    def runs(minima: Column) -> Column:
        borders = F.filter(F.sequence(F.lit(0), F.size(minima) - 1), lambda i: ~F.get(minima, i).eqNullSafe(F.get(minima, i - 1)))
        run = lambda own: F.transform(own, lambda i, n: F.struct(
            F.lit(window).alias("size"), F.get(minima, i).alias("least"), i.alias("first"),
            (F.coalesce(F.get(own, n + 1), F.size(minima)) - 1).alias("last")))
        return F.when(F.size(minima) > 0, _let(borders, run)).otherwise(F.array().cast("array<struct<size:int,least:bigint,first:int,last:int>>"))

    return window_minima(text, window, runs)


def _windows(words: Column, starts: Column, size: Column) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_join(F.slice(words, i + 1, size), " ").alias("window")))


def case_windows(cases: DataFrame, *, case_id: str = "id", text: str = "raw", window: int = WINDOW) -> DataFrame:
    """(id, size, window): every run of ``window`` words of a case, or the whole of a shorter one; cases without words have none."""
    own = cases.select(F.col(case_id).alias("id"), words_of(F.col(text)).alias("words"))
    own = own.select("id", "words", F.least(F.size("words"), F.lit(window)).alias("size")).filter("size > 0")
    starts = F.sequence(F.lit(0), F.size("words") - F.col("size"))
    return own.select("id", "size", F.explode(_windows(F.col("words"), starts, F.col("size"))).alias("w")).select("id", "size", "w.window")


def _sized(table: DataFrame, row_bytes: Column, most: int) -> DataFrame:
    """``table``, hinted for a broadcast if its counted bytes are at most ``most``."""
    total = table.agg(F.sum(row_bytes.cast("bigint") + 16)).first()[0] or 0
    return F.broadcast(table) if total <= most else table


def leaked_spans(
    jobs: DataFrame, cases: DataFrame, *, doc_id: str = "doc_id", text: str = "raw_text", case_id: str = "id", case_text: str = "raw",
    window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, digest, spans, case_ids: each distinct transcript that says ``window`` consecutive words of a case.

    ``jobs`` are transcripts, ``cases`` the labelled cases that models are judged by. Of every
    window of words the smallest k-gram hash is kept; transcripts and cases meet on these
    fingerprints, so each shared window is found. Where they meet, the words of the windows
    are compared, and windows that overlap or touch are extended to ``spans``: array of
    (first, last) word numbers from 0, ascending. A case of fewer words is one window of its
    own length. ``case_ids`` are the ids as strings, each once, ascending.

    ``digest`` is the text's 64-bit hash: rows equal in id and text are one row here. Null
    and wordless texts and cases meet nothing; a case without id marks words but is not
    listed; other columns are not read. An empty table on either side gives no rows. The
    case tables are broadcast only up to ``broadcast_bytes``, counted first.
    """
    own = jobs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("digest"))
    listed = checkpointed(case_windows(cases, case_id=case_id, text=case_text, window=window).distinct())
    known = checkpointed(listed.select("size", "window").distinct())
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most ``window`` numbers

    minimum = reduce(lambda a, s: a.when(F.col("size") == s, window_minima(F.col("window"), s, lambda m: F.get(m, F.lit(0)))), sizes, F.when(F.lit(False), F.lit(0).cast("bigint")))
    minima = known.select("size", minimum.alias("least")).distinct()
    runs = F.concat(F.array().cast("array<struct<size:int,least:bigint,first:int,last:int>>"), *[fingerprints(F.col("text"), s) for s in sizes])
    printed = own.select("doc_id", "digest", F.explode(runs).alias("run")).select("doc_id", "digest", "run.*")
    met = printed.join(_sized(minima, F.lit(12), broadcast_bytes), ["size", "least"], "left_semi")
    met = checkpointed(met.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("size", "first", "last")).alias("runs")))

    suspects = own.withColumnsRenamed({"doc_id": "d", "digest": "g"}).join(
        _sized(met, 16 + 12 * F.size("runs"), broadcast_bytes), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("digest")))
    suspects = suspects.groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))
    said = lambda words: F.flatten(F.transform("runs", lambda r: F.transform(
        F.sequence(r["first"], r["last"]), lambda i: F.struct(r["size"].alias("size"), i.alias("start"), F.array_join(F.slice(words, i + 1, r["size"]), " ").alias("window")))))
    tried = suspects.select("doc_id", "digest", F.explode(_let(words_of(F.col("text")), said)).alias("w")).select("doc_id", "digest", "w.*")
    found = checkpointed(tried.join(_sized(known, F.octet_length("window"), broadcast_bytes), ["size", "window"], "left_semi"))

    ends = found.groupBy("doc_id", "digest", "start").agg(F.max(F.col("start") + F.col("size") - 1).alias("last"))
    islands = ends.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("first"), "last"))).alias("own"))
    latest = lambda own, i, n: F.array_max(F.transform(F.slice(own, i + 1, n), lambda x: x["last"]))
    # what reaches a word began at most a window before it
    opens = lambda own: F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (
        F.get(own, i)["first"] > latest(own, F.greatest(i - window, F.lit(0)), F.least(i, F.lit(window))) + 1))
    spans = _let(opens(F.col("own")), lambda s: F.transform(s, lambda i, n: F.struct(
        F.get("own", i)["first"].alias("first"), latest(F.col("own"), i, F.coalesce(F.get(s, n + 1), F.size("own")) - i).alias("last"))))
    names = found.select("doc_id", "digest", "size", "window").distinct().join(
        _sized(listed, F.octet_length("window") + 8, broadcast_bytes), ["size", "window"])
    names = names.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("case_ids"))
    n = names.withColumnsRenamed({"doc_id": "d", "digest": "g"})
    both = islands.join(n, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("digest")))
    return both.select("doc_id", "digest", spans.alias("spans"), "case_ids")


def contamination(jobs: DataFrame, cases: DataFrame, *, doc_id: str = "doc_id", text: str = "raw_text", **params) -> DataFrame:
    """One row a job: doc_id, n_words, n_hit, spans, case_ids. Parameters and cases as in ``leaked_spans``.

    ``n_hit`` counts the words inside ``spans``. Clean transcripts have no spans and no ids; a
    null text has no words; a repeated row gives repeated results.
    """
    found = leaked_spans(jobs, cases, doc_id=doc_id, text=text, **params).withColumnsRenamed({"doc_id": "d", "digest": "g"})
    raw = F.coalesce(F.col(text), F.lit(""))
    counted = jobs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), F.size(words_of(raw, lambda t: t)).cast("bigint").alias("n_words"))
    rows = counted.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + (s["last"] - s["first"] + 1).cast("bigint"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), spans.alias("spans"), F.coalesce("case_ids", F.array().cast("array<string>")).alias("case_ids"))
