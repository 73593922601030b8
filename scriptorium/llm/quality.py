"""Rules that tell whether a transcript is readable text: word counts, repeats, compression bands."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size over size, by length: (bytes from, lowest, highest).

    Below the first length nothing is judged. ``chunk`` bytes make a chunk, which has limits
    of its own; a text fails if more than ``bad_chunks`` of its chunks lie outside.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.35, 1.00), (256, 0.38, 0.88), (512, 0.38, 0.80), (1024, 0.36, 0.74), (2048, 0.34, 0.68), (4096, 0.32, 0.64),
        (8192, 0.30, 0.60), (16384, 0.28, 0.58),
    )
    chunk: int = 1024
    chunk_low: float = 0.30
    chunk_high: float = 0.74
    bad_chunks: float = 0.25
    level: int = 3


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 text.

    Words are runs without ASCII white space, which is where ``bytes.split`` cuts.
    """
    words = text.split()
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    chars = len(text.translate(None, SPACE).decode())
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), chars, n_symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside a window of ``width`` words that is found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def base_fails(found: tuple[int, int, int, int, int]) -> bool:
    """Fewer than 10 words, or more than a fifth of them repeated."""
    return found[0] < 10 or 100 * found[4] > 20 * found[0]


class Compression:
    """Ratios of a text and of its chunks, and the verdict of the bands."""

    def __init__(self, bands: Bands):
        self.bands, self.packer = bands, zstandard.ZstdCompressor(level=bands.level, write_content_size=False)

    def ratio(self, data) -> float:
        return len(self.packer.compress(data)) / len(data)

    def chunk_ratios(self, text: bytes) -> list[float]:
        """Of whole chunks; what is left after them is judged by a last chunk that ends with the text."""
        view, chunk = memoryview(text), self.bands.chunk
        starts = [*range(0, len(text) - chunk + 1, chunk)]
        if starts and len(text) % chunk:
            starts.append(len(text) - chunk)
        return [self.ratio(view[i : i + chunk]) for i in starts]

    def judge(self, text: bytes) -> tuple[float | None, int, int, bool]:
        """Ratio of the whole, chunks, chunks outside their limits, whether the text passes."""
        bands = self.bands
        if not text:
            return None, 0, 0, True
        ratio = self.ratio(text)
        limits = [(low, high) for size, low, high in bands.whole if len(text) >= size]
        passes = not limits or limits[-1][0] <= ratio <= limits[-1][1]
        chunks = self.chunk_ratios(text)
        bad = sum(not bands.chunk_low <= r <= bands.chunk_high for r in chunks)
        return ratio, len(chunks), bad, passes and bad <= bands.bad_chunks * len(chunks)


def quality_rules(jobs: DataFrame, *, text: str = "raw_text", bands: Bands = Bands(), to: str = "quality") -> DataFrame:
    """Jobs with ``quality``: the measures, base_failed, ratio, chunks, bad_chunks and kept.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words repeated.
    ``kept``: not base_failed, and the compression bands pass. A null or empty transcript
    has no words, fails and has no ratio. Every row stays, repeated ones too; a column
    that is already named ``to`` is replaced.
    """
    fields = ", ".join(f"{m}:bigint" for m in MEASURES) + ", base_failed:boolean, ratio:double, chunks:bigint, bad_chunks:bigint, kept:boolean"

    @F.arrow_udf(f"struct<{fields}>")
    def rate(texts: pa.Array) -> pa.Array:
        judge = Compression(bands).judge
        out = []
        for value in texts.cast(pa.binary()).to_pylist():
            value = value or b""
            found = measures(value)
            failed = base_fails(found)
            ratio, chunks, bad, passes = judge(value)
            out.append((*found, failed, ratio, chunks, bad, passes and not failed))
        names = (*MEASURES, "base_failed", "ratio", "chunks", "bad_chunks", "kept")
        types = (*[pa.int64()] * len(MEASURES), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
        columns = list(zip(*out)) if out else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))

    return jobs.withColumn(to, rate.asNondeterministic()(F.col(text)))


def length_class(size: int) -> int:
    """Half octaves: class k has from 2 ** (k / 2) bytes."""
    k = 2 * (size.bit_length() - 1)
    return k + (size * size >= 1 << (k + 1))


def learn_bands(jobs: DataFrame, *, text: str = "raw_text", bands: Bands = Bands(), fence: float = 2.0, margin: float = 0.01, least: int = 20) -> Bands:
    """Bands whose limits come from the ratios of all texts that the word rules pass.

    For each half octave of length, and for the chunks of all lengths, the limits lie
    ``fence`` times the distance of the quartiles outside of the quartiles, that distance
    taken as ``margin`` at least. Quartiles do not move with the bad texts as long as those
    are few. Equal texts count once. A class of fewer than ``least`` texts or chunks keeps
    the limits of ``bands``, and nothing is judged below its first length.

    Ratios are counted in steps of 1/10,000, so a few thousand rows a class are sorted.
    """
    first = bands.whole[0][0] if bands.whole else 0

    @F.arrow_udf("array<struct<class:int,ratio:int>>")
    def ratios(texts: pa.Array) -> pa.Array:
        judge, out = Compression(bands), []
        for value in texts.cast(pa.binary()).to_pylist():
            value = value or b""
            found = []
            if not base_fails(measures(value)):
                if len(value) >= max(first, 1):
                    found.append((length_class(len(value)), judge.ratio(value)))
                found += [(-1, r) for r in judge.chunk_ratios(value)]
            out.append([{"class": k, "ratio": round(10_000 * r)} for k, r in found])
        return pa.array(out, pa.list_(pa.struct([("class", pa.int32()), ("ratio", pa.int32())])))

    rated = jobs.select(F.xxhash64(F.col(text)).alias("digest"), ratios.asNondeterministic()(F.col(text)).alias("found"))
    once = rated.groupBy("digest").agg(F.first("found").alias("found"))
    counts = once.select(F.explode("found").alias("f")).groupBy("f.class", "f.ratio").agg(F.count(F.lit(1)).alias("n"))
    quartiles = counts.groupBy("class").agg(F.sum("n").alias("n"), F.expr("percentile(ratio, array(0.25, 0.75), n)").alias("q")).filter(F.col("n") >= least)
    limits = {}
    for row in quartiles.collect():  # a row a class: two for each doubling of length
        low, high = (q / 10_000 for q in row["q"])
        gap = fence * max(high - low, margin)
        limits[row["class"]] = (low - gap, high + gap)
    learned = replace(bands, chunk_low=limits[-1][0], chunk_high=limits[-1][1]) if -1 in limits else bands
    starts = {size: (low, high) for size, low, high in bands.whole}
    for k in (k for k in limits if k >= 0):
        for at in (k, k + 1):  # where the class begins, and where the next one does
            size = max(first, next(x for x in range(int(2 ** (at / 2)), int(2 ** (at / 2)) + 3) if length_class(x) == at))
            kept = [x for x in bands.whole if size >= x[0]]
            starts.setdefault(size, kept[-1][1:])
    whole = [(size, *limits.get(length_class(size), starts[size])) for size in sorted(starts)]
    return replace(learned, whole=tuple(whole))
