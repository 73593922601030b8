"""Groups of whole-number vectors around centroids, by a VA-file. General: transcript tables hold no vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

CELLS = 16  # four bits a component
LARGEST = 1 << 27  # of a whole-number component, so that squared distances of 64 components fit a long


def whole_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, vector: floor(``scale`` * x) of each component, for the vectors of exactly ``size`` components, none null or non-finite."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.size("vector") == size)
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    whole = lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("bigint"))
    return rows.select("vec_id", F.transform("vector", whole).alias("vector"))


def seeds(rows: DataFrame, count: int) -> list[list[int]]:
    """The ``count`` vectors with the smallest sha256 of ``1:<vec_id>``, in that order; ties by the vector, rows without id last."""
    rows = rows.withColumn("hash", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    first = rows.orderBy(F.col("hash").isNull(), "hash", "vector").limit(count).collect()  # at most ``count`` rows
    return [r["vector"] for r in first for _ in range(min(r["copies"], count))][:count]


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Cells:
    """Cells of each dimension: ``borders[d]`` are their upper ends, ``low`` and ``high`` the whole numbers they hold."""

    def __init__(self, borders: list[list[int]], low: list[int], high: list[int]):
        self.size = len(borders)
        self.borders = np.array(borders, np.int64)  # size x (CELLS - 1), ascending
        self.low = np.concatenate((np.array(low, np.int64)[:, None], self.borders + 1), 1)
        self.high = np.concatenate((self.borders, np.array(high, np.int64)[:, None]), 1)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Four-bit cell numbers, two in a byte."""
        cells = np.stack([np.searchsorted(self.borders[d], vectors[:, d], side="left") for d in range(self.size)], 1).astype(np.uint8)
        cells = np.pad(cells, ((0, 0), (0, self.size % 2)))
        return cells[:, ::2] << 4 | cells[:, 1::2]

    def unpacked(self, packed: np.ndarray) -> np.ndarray:
        cells = np.empty((len(packed), 2 * packed.shape[1]), np.int64)
        cells[:, ::2], cells[:, 1::2] = packed >> 4, packed & 15
        return cells[:, : self.size]

    def tables(self, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared difference to a centroid's component, by dimension and cell."""
        below, above = self.low - centroid[:, None], centroid[:, None] - self.high
        outside = np.maximum(np.maximum(below, above), 0)
        inside = np.maximum(np.abs(below), np.abs(above))
        return outside * outside, inside * inside

    def candidates(self, packed: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Rows x centroids: whether a centroid's distance interval reaches below the smallest upper end."""
        at = self.unpacked(packed) + np.arange(self.size) * CELLS
        least, most = np.empty((2, len(packed), len(centroids)), np.int64)
        for k, c in enumerate(centroids):
            low, high = self.tables(c)
            least[:, k], most[:, k] = low.reshape(-1)[at].sum(1), high.reshape(-1)[at].sum(1)
        return least <= most.min(1, keepdims=True)


def learn_cells(rows: DataFrame, size: int, accuracy: int = 1000) -> Cells:
    """Cells that hold about equally many vectors, from quantiles of all rows; the outer ones end at the extremes.

    The driver sees a few numbers a dimension.
    """
    shares = [i / CELLS for i in range(1, CELLS)]
    pairs = rows.select(F.posexplode("vector").alias("d", "x"))
    found = {r["d"]: r for r in pairs.groupBy("d").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", shares, accuracy).alias("q")).collect()}
    return Cells([found[d]["q"] for d in range(size)], [found[d]["low"] for d in range(size)], [found[d]["high"] for d in range(size)])


def _slices(batches, rows: int = 2048):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _bytes(column: pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, -1)


def _nearest(part: pa.RecordBatch, cells: Cells, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and vector of each row: by intervals alone where one is left, else by the distances to those that are."""
    vectors = _matrix(part.column("vector"), cells.size)
    open_ = cells.candidates(_bytes(part.column("cells"), part.num_rows), centroids)
    cluster = open_.argmax(1).astype(np.int32)
    least = np.full(part.num_rows, np.iinfo(np.int64).max)
    unsure = open_.sum(1) > 1
    for k, c in enumerate(centroids):
        rows = np.flatnonzero(open_[:, k] & unsure)
        distance = ((vectors[rows] - c) ** 2).sum(1)
        nearer = distance < least[rows]
        least[rows[nearer]], cluster[rows[nearer]] = distance[nearer], k
    return cluster, vectors


def _sums(rows: DataFrame, cells: Cells, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> count and sums of its vectors; each task adds up its own rows."""

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for part in _slices(batches):
            cluster, vectors = _nearest(part, cells, centroids)
            vectors, copies = np.concatenate((np.ones((part.num_rows, 1), np.int64), vectors), 1), part.column("copies").to_numpy()
            if copies.max() > 1 << 20:
                vectors, copies = vectors.astype(object), copies.astype(object)
            for c in np.unique(cluster).tolist():
                total[c] = total.get(c, 0) + (vectors[cluster == c] * copies[cluster == c][:, None]).sum(0).astype(object)
        found = [(c, d - 1, x) for c, sums in total.items() for d, x in enumerate(sums.tolist())]
        clusters, dims, sums = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int32()), pa.array(dims, pa.int32()), pa.array(sums, pa.decimal128(38, 0))], ["cluster", "d", "x"])

    sums = rows.mapInArrow(summed, "cluster int, d int, x decimal(38,0)").groupBy("cluster", "d").agg(F.sum("x").cast("decimal(38,0)").alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(sums.collect()):  # clusters x (size + 1) numbers
        if r["d"] < 0:
            out[r["cluster"]] = (int(r["x"]), [])
        else:
            out[r["cluster"]][1].append(int(r["x"]))
    return out


def centroid_groups(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 64, count: int = 16, rounds: int = 3,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid: exact k-means on whole-number vectors.

    ``whole_vectors`` says which rows take part and how components become whole numbers;
    ``seeds`` are the first ``count`` centroids. Each round gives every vector to its nearest
    centroid (squared Euclidean distance, ties to the smaller number) and replaces each
    non-empty centroid by the floor of its vectors' mean; at the end vectors are given out
    once more. Sums and floors are exact.

    Vectors are compressed to a four-bit cell a dimension. Tables of the least and greatest
    squared difference by centroid, dimension and cell give an interval for every distance;
    where one centroid's interval stays below all others it is the nearest, and only for other
    rows are distances taken, to the centroids that are left. Cells stand beside the vectors,
    so a round is one pass that moves only each task's sums; the last one gives the distances.

    Equal rows (id and vector) are one row with a number of copies until the end, when each
    gets its result. Fewer rows than ``count``: as many centroids. A component of 2**21 or
    more is an error, as distances would not fit; an empty table gives no rows; a null id
    takes part and comes last among the seeds; other columns are not read.
    """
    rows = whole_vectors(vectors, vec_id=vec_id, vector=vector, size=size, scale=scale)
    key = F.unhex(F.md5(F.concat_ws(",", F.coalesce(F.col("vec_id").cast("string"), F.lit("-")), F.col("vector").cast("array<string>")).cast("binary")))
    full = rows.withColumn("key", key).groupBy("key").agg(F.first("vec_id").alias("vec_id"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"))
    full = checkpointed(full)
    spark = full.sparkSession
    fields = f"vec_id {full.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    centroids = np.array(seeds(full, count), np.int64)
    if not len(centroids):
        return spark.createDataFrame([], fields)
    cells = learn_cells(full, size)

    kind = full.schema["vec_id"].dataType.simpleString()

    def compressed(batches):
        for part in _slices(batches):
            packed = cells.of(_matrix(part.column("vector"), size))
            names = ["vec_id", "vector", "copies"]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array([p.tobytes() for p in packed], pa.binary())], [*names, "cells"])

    filed = checkpointed(full.drop("key").mapInArrow(compressed, f"vec_id {kind}, vector array<bigint>, copies bigint, cells binary"))
    for _ in range(rounds):
        for k, (n, sums) in _sums(filed, cells, centroids).items():
            centroids[k] = [s // n for s in sums]

    def measured(batches):
        for part in _slices(batches):
            cluster, vectors = _nearest(part, cells, centroids)
            gap = vectors - centroids[cluster]
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(cluster), part.column("copies"), pa.array((gap * gap).sum(1))], ["vec_id", "cluster", "copies", "distance"])

    ended = checkpointed(filed.mapInArrow(measured, f"vec_id {kind}, cluster int, copies bigint, distance bigint"))
    exact = F.col("distance").cast("decimal(19,0)") * F.col("copies").cast("decimal(19,0)")
    own = {r["cluster"]: int(r["x"]) for r in ended.groupBy("cluster").agg(F.sum(exact).alias("x")).collect()}
    table = [(k, own.get(k, 0), sum(own.values()), c.tolist()) for k, c in enumerate(centroids)]
    named = F.broadcast(spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>"))  # ``count`` rows
    # copies come back in two steps, so that one row's many copies are no single task
    many = ended.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / 65_536))))
    many = many.repartition(F.xxhash64("vec_id", "distance", "part"))
    left = F.least(F.col("copies") - F.col("part") * 65_536, F.lit(65_536).cast("bigint"))
    return many.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), left))).join(named, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
