"""Collocations of transcripts, counted on a dictionary of content-defined chunks (prefix-free parsing)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir

UNKNOWN = "und"
LONGEST = 4  # words of a phrase
OVERLAP = LONGEST - 1
BITS = 1 << 26  # of the filter of frequent phrases, 8 MB at every size of the corpus
WINDOW = 4 << 20  # bytes of text that are looked at together
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, one for each of two hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Kind of a byte: 0 in a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


@lru_cache(maxsize=8)
def _powers(multiplier: int, length: int) -> np.ndarray:
    out = np.full(length, multiplier, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _size(length: int) -> int:
    return max(WINDOW, 1 << max(length - 1, 1).bit_length())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int) -> np.ndarray:
    """A hash of values[start:end] for each pair, equal for equal runs wherever they stand."""
    power, inverse = (_powers(m, _size(len(values) + 1)) for m in (multiplier, pow(multiplier, -1, 1 << 64)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((values + np.uint64(1)) * power[: len(values)])))
    return _mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """The words of a window of texts: ``row`` their text, ``piece`` their piece; word i is clean[begin[i]:finish[i]], and one space parts the words of a piece."""

    clean: np.ndarray
    begin: np.ndarray
    finish: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    hashes: list[np.ndarray]

    def texts(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The words first to last (included) of one piece, as strings."""
        start, length = self.begin[first], self.finish[last] - self.begin[first]
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
        at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.clean[at])])


def words_of(texts: pa.Array, window: int = WINDOW) -> Iterator[Words]:
    """Words with A-Z lowered, some ``window`` bytes of text after the other; a window ends between pieces."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + window, end)
        if hi < end:
            inner = offsets[(offsets > lo) & (offsets <= hi)]
            cut = np.flatnonzero(KIND[data[lo:hi]] == 2) if not len(inner) else None
            if cut is None:
                hi = int(inner[-1])
            elif len(cut):
                hi = lo + int(cut[-1]) + 1
            else:  # one piece without an end in sight
                stop = int(offsets[np.searchsorted(offsets, hi)])
                while hi < stop and KIND[data[hi - 1]] != 2:
                    step = np.flatnonzero(KIND[data[hi : min(hi + window, stop)]] == 2)
                    hi = hi + int(step[0]) + 1 if len(step) else min(hi + window, stop)
        yield _words(LOWER[data[lo:hi]], offsets, lo)
        lo = hi


def _words(low: np.ndarray, offsets: np.ndarray, lo: int) -> Words:
    kind = KIND[low]
    inside = kind == 0
    opens = np.zeros(len(low) + 1, bool)  # whether a text begins here
    own = offsets[(offsets >= lo) & (offsets <= lo + len(low))] - lo
    opens[own] = True
    before = np.concatenate(([False], inside[:-1]))
    first = inside & (~before | opens[:-1])
    after = np.concatenate((inside[1:], [False]))
    final = inside & (~after | opens[1:])
    s, e = np.flatnonzero(first), np.flatnonzero(final) + 1
    piece = np.cumsum((kind == 2) | opens[:-1])[s]
    row = np.searchsorted(offsets, s + lo, side="right") - 1
    keep = inside | np.concatenate(([False], final[:-1] & ~inside[1:]))  # a word and the one byte behind it
    clean = np.where(inside, low, np.uint8(0x20))[keep]
    place = np.concatenate(([0], np.cumsum(keep)))
    values = low.astype(np.uint64)
    return Words(clean, place[s], place[e], row, piece, [_sequence_hashes(values, s, e, m) for m in MULTIPLIERS])


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the rows sorted so that equal keys stand together, and where each group begins in that order.

    Two 64-bit hashes are compared; the second one sorts too if it ever parts rows that the first one joins.
    """
    order = np.argsort(keys[0], kind="stable")
    one, two = keys[0][order], keys[1][order]
    new = np.concatenate(([True], one[1:] != one[:-1]))[: len(one)]
    if (two[1:] != two[:-1])[~new[1:]].any():
        order = np.lexsort((keys[1], keys[0]))
        one, two = keys[0][order], keys[1][order]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    return order, np.flatnonzero(new)


def cut_chunks(words: Words, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, last) of the chunks of each piece, as word numbers; neighbours share ``OVERLAP`` words.

    A chunk ends behind ``OVERLAP`` words whose hashes sum to a multiple of ``every``, and
    the next one begins with them, so equal passages are cut alike wherever they stand. A
    phrase that starts before the last ``OVERLAP`` words of a chunk lies inside it; the
    ``last`` chunk of a piece owns all its words.
    """
    n, piece = len(words.piece), words.piece
    heads = np.concatenate(([True], piece[1:] != piece[:-1]))[:n]
    tail = np.append(np.flatnonzero(heads)[1:], n)[np.cumsum(heads) - 1] if n else piece  # where each word's piece ends
    sums = words.hashes[0].copy()
    for by in range(1, OVERLAP):
        sums[: n - by] += words.hashes[0][by:]
    trigger = (sums % np.uint64(every) == 0) & (np.arange(n) + OVERLAP < tail)
    start = np.flatnonzero(heads | trigger)
    following = np.append(start[1:], n)
    last = following == tail[start] if n else np.zeros(0, bool)
    return start, np.where(last, tail[start], following + OVERLAP) if n else start, last


def _language_keys(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(n) for n in names], np.uint64)


def _parse(batches, every: int):
    """The distinct chunks of each window of transcripts with their counts."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy()
        for words in words_of(batch.column(1)):
            start, end, last = cut_chunks(words, every)
            language = codes[words.row[start]] if len(start) else start
            keys = [_mixed(_sequence_hashes(h, start, end, m) ^ (2 * language + last).astype(np.uint64)) for h, m in zip(words.hashes, MULTIPLIERS)]
            order, first = _grouped(keys)
            n = np.diff(np.append(first, len(order)))
            chosen = order[first]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(language[chosen])), pa.array(last[chosen]), words.texts(start[chosen], end[chosen] - 1), pa.array(n)],
                ["language", "last", "chunk", "n"])


def chunk_dictionary(jobs: DataFrame, *, text: str = "raw_text", language: str = "language", every: int = 32) -> DataFrame:
    """language, last, chunk, n: the distinct chunks of all transcripts and how often the parse names each.

    ``last`` tells whether a chunk ends its piece and so owns all phrases that start in it.
    """
    rows = jobs.select(F.coalesce(F.col(language), F.lit(UNKNOWN)).alias("language"), F.col(text).alias("text"))
    parsed = rows.mapInArrow(lambda batches: _parse(batches, every), "language string, last boolean, chunk string, n bigint")
    return parsed.groupBy("language", "last", "chunk").agg(F.sum("n").alias("n"))


def _phrase_hashes(words: Words, ends: np.ndarray, size: int) -> list[np.ndarray]:
    """Hashes of the ``size`` words from each word on; without meaning where the row ends before."""
    start = np.arange(len(words.row))
    return [_sequence_hashes(h, start, np.minimum(start + size, ends), m) for h, m in zip(words.hashes, MULTIPLIERS)]


def _row_ends(words: Words) -> np.ndarray:
    return np.searchsorted(words.row, words.row, side="right")


def _frequent_bits(frequent: DataFrame) -> np.ndarray:
    """One bit for the hash of each frequent phrase: a filter of fixed size that may let others pass, never the reverse."""

    def hashed(batches):
        for batch in batches:
            keys = _language_keys(batch.column(0).to_pylist())
            for words in words_of(batch.column(1)):
                ends = _row_ends(words)
                heads = np.flatnonzero(np.concatenate(([True], words.row[1:] != words.row[:-1])))
                found = _phrase_hashes(words, ends, LONGEST)[0][heads]
                yield pa.RecordBatch.from_arrays([pa.array((_mixed(found ^ keys[words.row[heads]]) % np.uint64(BITS)).astype(np.int64) + 1)], ["bit"])  # bitmaps count from 1

    rows = frequent.select("language", "phrase").mapInArrow(hashed, "bit bigint")
    rows = rows.select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():  # at most BITS bits in all
        part = np.frombuffer(r["bits"], np.uint8)
        bits[(r["bucket"] - 1) * len(part) : r["bucket"] * len(part)] = part
    return bits


def _passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (hashes % np.uint64(BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _count(dictionary: DataFrame, sizes: tuple[int, ...], filters: list) -> DataFrame:
    """language, phrase, words, f: phrases of ``sizes`` words, each occurrence counted in the chunk that owns its first word.

    ``filters``: broadcast bits of the frequent words and of the frequent pairs, as far as
    known; a phrase with a part that they exclude is not counted.
    """

    def run(batches):
        for batch in batches:
            coded = batch.column("language").dictionary_encode()
            names, codes = coded.dictionary, coded.indices.to_numpy()
            keys = _language_keys(names.to_pylist())[codes] if batch.num_rows else np.empty(0, np.uint64)
            last, n = batch.column("last").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            for words in words_of(batch.column("chunk")):
                for size, first, f in _ngrams(words, keys, last, n, sizes, [b.value for b in filters]):
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(codes[words.row[first]])), words.texts(first, first + size - 1), pa.array(np.full(len(first), size, np.int32)), pa.array(f)],
                        ["language", "phrase", "words", "f"])

    counted = dictionary.select("language", "last", "chunk", "n").mapInArrow(run, "language string, phrase string, words int, f bigint")
    return counted.groupBy("language", "phrase", "words").agg(F.sum("f").alias("f"))


def _ngrams(words: Words, keys: np.ndarray, last: np.ndarray, n: np.ndarray, sizes: tuple[int, ...], filters: list[np.ndarray]):
    """(size, first, f): the distinct phrases in a window of chunks, by their first word, and their weighted counts."""
    place, ends = np.arange(len(words.row)), _row_ends(words)
    owned = place < np.where(last[words.row], ends, ends - OVERLAP)
    key = keys[words.row]
    good = np.ones(len(place), bool)
    for size in range(1, max(sizes) + 1):
        hashes = [_mixed(h ^ key) for h in _phrase_hashes(words, ends, size)]
        if size > 1:  # both parts of one word less pass
            good = good & np.concatenate((good[1:], [False]))[: len(place)] & (place + size <= ends)
        if len(filters) >= size:
            good &= _passes(hashes[0], filters[size - 1])
        if size in sizes:
            mine = np.flatnonzero(good & owned)
            order, first = _grouped([h[mine] for h in hashes])
            weight = n[words.row[mine]][order]
            yield size, mine[order[first]], np.add.reduceat(weight, first) if len(first) else weight


def _part(words: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(words, start, count), " ")


def mine_phrases(
    jobs: DataFrame, *, text: str = "raw_text", language: str = "language", least: int = 30, most: int = 2000, cover: int = 80, every: int = 32,
) -> DataFrame:
    """language, rank, phrase, a, l, r, n, score: the ``most`` best collocations of each language, as candidates for its lexicon.

    A transcript's text is lowered (A-Z), cut at ``. , ; : ! ?`` and line ends, and its
    phrases are 2 to 4 words in a row, ``a`` >= ``least`` times in all transcripts of the
    language. A cut after k words gives l and r, the counts of both parts, and floor(2000000
    * a / (l + r)); the cut of the lowest score counts, then the smallest k. A phrase inside
    a longer candidate goes if ``cover`` per cent of it, or more, lie there. ``n`` is the
    number of all words of the language. Order: score, a, then the phrase's bytes.

    Counting: transcripts become overlapping chunks, cut where the content says so; the
    distinct chunks with their frequencies hold every phrase, and each occurrence belongs
    to one chunk, so copies are counted without being read again. Words are counted first,
    then pairs of frequent words, then longer phrases of frequent pairs: a filter of fixed
    size keeps out parts that cannot be frequent, and the counts themselves are exact.

    A null language is ``und``; null, empty and wordless texts add nothing; a repeated row
    counts again; a text may be of any length; other columns are not read. An empty table
    gives no rows.
    """
    spark = jobs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/phrases-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    dictionary = stored(chunk_dictionary(jobs, text=text, language=language, every=every), "chunks")
    words = stored(_count(dictionary, (1,), []), "words")
    context = spark.sparkContext
    one = stored(words.filter(F.col("f") >= least), "frequent-1")
    filters = [context.broadcast(_frequent_bits(one))]
    two = stored(_count(dictionary, (2,), filters).filter(F.col("f") >= least), "frequent-2")
    filters.append(context.broadcast(_frequent_bits(two)))
    more = stored(_count(dictionary, (3, 4), filters).filter(F.col("f") >= least), "frequent-3")

    own = two.unionByName(more)  # all candidates
    every_one = own.unionByName(one).select(F.col("language"), F.col("phrase").alias("part"), F.col("f"))
    parts = own.withColumn("w", F.split("phrase", " ")).select(
        "language", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = parts.select("language", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, F.size("w")).alias("right"))
    left = every_one.withColumnsRenamed({"part": "left", "f": "l"})
    right = every_one.withColumnsRenamed({"part": "right", "f": "r"})
    exact = "cast(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as bigint)"
    cuts = parts.join(left, ["language", "left"]).join(right, ["language", "right"]).withColumn("score", F.expr(exact))
    scored = cuts.groupBy("language", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = more.withColumn("w", F.split("phrase", " ")).select("language", "f", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    longer = longer.select("language", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    covered = longer.select("language", _part(F.col("w"), F.col("start"), F.col("size")).alias("phrase"), "f").groupBy("language", "phrase").agg(F.max("f").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    kept = scored.join(covered, ["language", "phrase"], "left").filter(F.col("most").isNull() | (wide("most") * 100 < wide("a") * cover))
    kept = kept.select("language", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    few = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("rank", best("language", "salt")).filter(F.col("rank") <= most)
    top = few.withColumn("rank", best("language").cast("bigint")).filter(F.col("rank") <= most)
    sizes = words.groupBy("language").agg(F.sum("f").alias("n"))
    return top.join(sizes, "language").select("language", "rank", "phrase", "a", "l", "r", "n", "score")
