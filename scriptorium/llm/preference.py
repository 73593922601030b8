"""Quality of a transcript by pairwise ranking: a Bradley-Terry model over text features."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .quality import SPACE, repeated_words

FEATURES = (
    "log_words", "word_length", "long_words", "symbols", "digits", "upper", "marks", "bars", "repeats", "double_lines", "distinct_words",
    "doubled_words", "compressed", "line_words", "ends", "no_words",
)
THRESHOLD = 0.7
LEAST_SCALE = 1e-6  # of a feature that varies
BINS, FAR = 64, 16  # bins in a unit of raw score, and the score beyond which a pair's loss no longer bends
_MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
_SYMBOLS = b"#*$%&<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def _share(text: bytes, signs: bytes) -> float:
    return (len(text) - len(text.translate(None, signs))) / max(1, len(text))


def features(text: bytes) -> list[float]:
    """The values of ``FEATURES``, of the whole text; each is bounded, those of an empty text too."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    bare = text.translate(None, SPACE)
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters_up, letters_low = _share(bare, _UPPER), _share(bare, _LOWER)
    distinct = len(set(words))
    # expected size of a text without repeats, so that the ratio does not follow the length
    expected = 40 + 0.42 * len(text) + 1.6 * math.sqrt(len(text))
    return [
        min(math.log1p(n), 9.0) / 3,
        min(len(bare) / n, 20.0) / 5,
        sum(len(w) > 15 for w in words) / n,
        min(1.0, 10 * _share(bare, _SYMBOLS)),
        min(1.0, 10 * _share(bare, b"0123456789")),
        letters_up / max(1e-9, letters_up + letters_low) if letters_up + letters_low else 0.5,
        min(1.0, 5 * _share(bare, _MARKS)),
        min(1.0, 10 * _share(bare, b"|")),
        repeated_words(words) / n,
        1 - len(set(lines)) / len(lines),
        distinct / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        min(1.5, len(zlib.compress(text, 6)) / expected),
        min(math.log1p(n / len(lines)), 6.0) / 3,
        sum(line.rstrip()[-1:] in b".!?" for line in lines) / len(lines),
        0.0,
    ]


@dataclass(frozen=True)
class Ranking:
    """Weights over standardized features; ``threshold`` is the raw score that becomes 0.7."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return (rows - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights)

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip(self.raw(rows) - self.threshold + math.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)
        return 1 / (1 + np.exp(-z))


def _solved(sums, width: int, penalty: float, steps: int) -> np.ndarray:
    """Newton steps of the logistic loss; ``sums`` gives slope and curve, per pair, of given weights."""
    weights = np.zeros(width)
    for _ in range(steps):
        slope, curve = sums(weights)
        move = np.linalg.solve(curve + penalty * np.eye(width), slope + penalty * weights)
        weights -= move
        if np.abs(move).max() < 1e-5:
            break
    return weights


def fit(rows: np.ndarray, accepted: np.ndarray, *, pairs: int = 100_000, penalty: float = 1e-3, steps: int = 30) -> Ranking:
    """Bradley-Terry: the logistic loss of (preferred minus other) features, by Newton steps.

    In memory, over every pair of an accepted and a refused row, about ``pairs`` at a time; ``learn_ranking``
    is the form for tables. The threshold is the raw scores' quantile at the share of refused
    rows. Without both kinds of rows every score is 0.7.
    """
    width = rows.shape[1] if rows.ndim == 2 else len(FEATURES)
    good, bad = rows[accepted == 1], rows[accepted == 0]
    if not len(good) or not len(bad):
        return Ranking((0.0,) * width, (1.0,) * width, (0.0,) * width, 0.0)
    mean, scale = rows.mean(0), rows.std(0)
    scale = np.where(scale > LEAST_SCALE, scale, 1.0)
    good, bad = (good - mean) / scale, (bad - mean) / scale
    block = max(1, pairs // len(bad))

    def sums(weights):
        slope, curve = np.zeros(width), np.zeros((width, width))
        for at in range(0, len(good), block):
            gap = (good[at : at + block, None, :] - bad[None, :, :]).reshape(-1, width)
            p = 1 / (1 + np.exp(-np.clip(gap @ weights, -500, 500)))
            slope += gap.T @ (p - 1)
            curve += (gap * (p * (1 - p))[:, None]).T @ gap
        return slope / (len(good) * len(bad)), curve / (len(good) * len(bad))

    weights = _solved(sums, width, penalty, steps)
    raw = np.sort((rows - mean) / scale @ weights)
    threshold = (raw[len(bad) - 1] + raw[len(bad)]) / 2
    return Ranking(tuple(mean), tuple(scale), tuple(weights), float(threshold))


def _combined(parts) -> dict[int, np.ndarray]:
    """Key -> sum of its vectors."""
    total: dict[int, np.ndarray] = {}
    for part in parts:
        for key, x in zip(part.column("key").to_pylist(), part.column("x").to_numpy(zero_copy_only=False)):
            total[key] = total[key] + x if key in total else x
    return total


def _as_batch(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["key", "x"])


def _moments(cases: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For refused and accepted cases, by bin of the score: count, mean score, sum and sum of products of the features.

    A task adds up its rows; about as many tasks as the root of their number add up these
    sums; the driver sees those. A bin is 1 / ``BINS`` of a raw score wide, scores beyond
    ``FAR`` share the outer bins.
    """
    width = len(FEATURES)
    upper = np.triu_indices(width)

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = (part.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - mean) / scale
                score = z @ weights
                bins = np.rint(np.clip(score, -FAR, FAR) * BINS).astype(np.int64)
                key = 2 * (bins + FAR * BINS) + part.column("accepted").to_numpy(zero_copy_only=False)
                order = np.argsort(key, kind="stable")
                keys, starts = np.unique(key[order], return_index=True)
                x = np.concatenate((np.ones((len(z), 1)), score[:, None], z, z[:, upper[0]] * z[:, upper[1]]), 1)[order]
                for k, v in zip(keys.tolist(), np.add.reduceat(x, starts)):
                    total[k] = total[k] + v if k in total else v
        yield _as_batch(total)

    def merged(batches):
        yield _as_batch(_combined(batches))

    tasks = max(1, math.isqrt(cases.rdd.getNumPartitions()))
    schema = "key int, x array<double>"
    found = cases.mapInArrow(summed, schema).repartition(tasks).mapInArrow(merged, schema).toArrow()
    total = _combined(found.to_batches())
    out = []
    for kind in (0, 1):
        x = np.array([total[k] for k in sorted(total) if k % 2 == kind]).reshape(-1, 2 + width + len(upper[0]))
        products = np.zeros((len(x), width, width))
        products[:, upper[0], upper[1]] = products[:, upper[1], upper[0]] = x[:, 2 + width :]
        out.append((x[:, 0], x[:, 1] / np.maximum(x[:, 0], 1), x[:, 2 : 2 + width], products))
    return out


def _pair_sums(bad: tuple[np.ndarray, ...], good: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curve over all pairs of an accepted and a refused case, from the sums by bin."""
    (n, s, x, xx), (m, t, y, yy) = good, bad
    p = 1 / (1 + np.exp(-np.clip(s[:, None] - t[None, :], -500, 500)))
    miss, bend = p - 1, p * (1 - p)
    slope = (miss @ m) @ x - (n @ miss) @ y
    cross = x.T @ bend @ y
    curve = np.einsum("i,ijk->jk", bend @ m, xx) + np.einsum("i,ijk->jk", n @ bend, yy) - cross - cross.T
    pairs = n.sum() * m.sum()
    return slope / pairs, curve / pairs


def value_at(rows: DataFrame, column: str, place: int, *, few: int = 10_000, parts: int = 1000) -> float:
    """The value at a place, from 0, of the ascending column: parts are counted and the right one is looked into.

    The driver sees at most ``parts`` counts a round and ``few`` values at the end.
    """
    x = F.col(column)
    low, high, n = rows.agg(F.min(x), F.max(x), F.count(x)).first()
    while low < high:
        inside = rows.filter(x.between(low, high))
        if n <= few:
            return sorted(r[0] for r in inside.select(x).collect())[place]
        part = F.least(F.floor((x - low) / F.lit(high - low) * parts), F.lit(parts - 1))
        for r in inside.groupBy(part.alias("part")).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n")).orderBy("part").collect():
            if place < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            place -= r["n"]
    return low


def _measured(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([features(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))

    return measure.asNondeterministic()(text)


def learn_ranking(
    jobs: DataFrame, cases: DataFrame, *, doc_id: str = "doc_id", text: str = "raw_text", accepted: str = "accepted", penalty: float = 1e-3, steps: int = 30,
) -> Ranking:
    """Fits on labelled jobs: ``cases`` holds doc_id and accepted (1 or 0).

    As ``fit``, over every pair of an accepted and a refused case. The loss of a pair depends
    on its two scores, so cases are summed by score and the pairs of bins stand for the pairs
    of their cases; each Newton step is one pass over the features. The threshold is exact.
    Cases with null id or label, or any other label, take no part; of repeated cases of one id
    the lowest label counts.
    """
    rows = cases.select(F.col(doc_id).alias("doc_id"), F.col(accepted).cast("int").alias("accepted"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("accepted").isin(0, 1)).groupBy("doc_id").agg(F.min("accepted").alias("accepted"))
    # measured before the join, so that a shuffle moves features and no texts
    measured = jobs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), _measured(F.col(text)).alias("f"))
    known = checkpointed(measured.join(rows, "doc_id").select("accepted", "f"))
    width = len(FEATURES)
    none, one = np.zeros(width), np.ones(width)
    kinds = _moments(known, none, one, none)
    refused, taken = (int(n.sum()) for n, *_ in kinds)
    if not refused or not taken:
        return Ranking((0.0,) * width, (1.0,) * width, (0.0,) * width, 0.0)
    mean = sum(x.sum(0) for _, _, x, _ in kinds) / (refused + taken)
    squares = np.diag(sum(xx.sum(0) for *_, xx in kinds)) / (refused + taken)
    scale = np.sqrt(np.maximum(squares - mean * mean, 0))
    scale = np.where(scale > LEAST_SCALE, scale, 1.0)
    weights = _solved(lambda w: _pair_sums(*_moments(known, mean, scale, w)), width, penalty, steps)
    open_ = Ranking(tuple(mean), tuple(scale), tuple(weights), 0.0)

    def rated(batches):
        for batch in batches:
            f = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(open_.raw(f))], ["raw"])

    raw = checkpointed(known.select("f").mapInArrow(rated, "raw double"))
    threshold = (value_at(raw, "raw", refused - 1) + value_at(raw, "raw", refused)) / 2
    return Ranking(open_.mean, open_.scale, open_.weights, float(threshold))


def score_jobs(jobs: DataFrame, ranking: Ranking, *, text: str = "raw_text", to: str = "preference") -> DataFrame:
    """Jobs with ``preference``: the score of the whole transcript, 0 to 1.

    0.7 is the threshold. Null texts count as empty, which have a score too. Every row stays;
    a column that is already named ``to`` is replaced.
    """

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        rows = np.array([features(t or b"") for t in texts.cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(FEATURES))
        return pa.array(ranking.score(rows))

    return jobs.withColumn(to, rate.asNondeterministic()(F.col(text)))
