"""Nearest vectors by a hierarchical k-means tree. General: transcript tables hold no vectors."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed


@dataclass
class Node:
    centres: np.ndarray  # one row a child
    children: list  # Node or the number of a leaf


class KMeansTree:
    """Splits a sample by k-means again and again until a part has at most ``leaf`` vectors."""

    def __init__(self, sample: np.ndarray, *, branch: int = 8, leaf: int = 256, rounds: int = 12, seed: int = 4):
        self.branch, self.leaf, self.rounds = branch, leaf, rounds
        self.leaves = 0
        self.random = np.random.default_rng(seed)
        self.root = self._grow(sample) if len(sample) else self._leaf()

    def _leaf(self) -> int:
        self.leaves += 1
        return self.leaves - 1

    def _grow(self, part: np.ndarray):
        different = np.unique(part, axis=0) if len(part) <= 4 * self.leaf else part
        if len(part) <= self.leaf or len(different) < 2:
            return self._leaf()
        centres = part[self.random.choice(len(part), min(self.branch, len(different)), replace=False)].copy()
        for _ in range(self.rounds):
            own = self._nearest(part, centres)
            for k in range(len(centres)):
                if (own == k).any():
                    centres[k] = part[own == k].mean(0)
        own = self._nearest(part, centres)
        filled = np.unique(own)
        if len(filled) < 2:
            return self._leaf()
        return Node(centres[filled], [self._grow(part[own == k]) for k in filled])

    @staticmethod
    def _nearest(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (part @ centres.T - (centres * centres).sum(1) / 2).argmax(1)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        found = np.zeros(len(vectors), np.int64)

        def down(node, rows):
            if not isinstance(node, Node):
                found[rows] = node
                return
            own = self._nearest(vectors[rows], node.centres)
            for k, child in enumerate(node.children):
                if (own == k).any():
                    down(child, rows[own == k])

        down(self.root, np.arange(len(vectors)))
        return found

    def leaf_centres(self) -> dict[int, np.ndarray]:
        found, rest = {}, [(self.root, None)]
        while rest:
            node, centre = rest.pop()
            if isinstance(node, Node):
                rest += zip(node.children, node.centres)
            else:
                found[node] = centre
        return found

    def visits(self, query: np.ndarray, most: int, sizes: dict[int, int] | None = None, rows: int = 0, limit: float = np.inf) -> list[int]:
        """Leaves of a best-bin-first walk: the branch whose centre has the largest inner product comes first.

        It ends after ``most`` leaves, but not before they hold ``rows`` vectors, as ``sizes``
        counts them; beyond that it takes leaves whose centre scores ``limit`` or more.
        """
        queue, order, number, held = [(0.0, 0, self.root)], [], 0, 0
        while queue and (len(order) < most or held < rows or limit < np.inf):
            score, _, node = heapq.heappop(queue)
            if not isinstance(node, Node):
                if len(order) < most or held < rows or -score >= limit:
                    order.append(node)
                    held += sizes.get(node, 0) if sizes else 0
                continue
            for score, child in zip((node.centres @ query).tolist(), node.children):
                number += 1
                heapq.heappush(queue, (-score, number, child))
        return order


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last, so equal vectors score equally."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total += vectors[:, j] * query[j]
    return total


def best(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best ids and scores, ties to the smaller id; the query's own row is left out. ``rough`` preselects."""
    if len(ids) > k + 1:
        limit = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
        near = np.flatnonzero(rough >= limit - 1e-9 * (1 + abs(limit)))
    else:
        near = np.arange(len(ids))
    near = near[ids[near] != query_id]
    scores = exact(vectors[near], query)
    order = np.lexsort((ids[near], -scores))[:k]
    return ids[near][order], scores[order]


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def usable(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", size: int | None = None) -> DataFrame:
    """vec_id and vector of the rows that take part.

    Out go null ids and vectors, vectors with null or non-finite components, zero and empty
    ones, and those whose length is not ``size``, the most frequent one if none is given. Of
    rows with the same id the smallest vector stays.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & good)
    if size is None:
        sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
        size = sizes[0]["size"] if sizes else 0
    rows = rows.filter(F.size("vector") == size)
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", sample: int = 20_000,
    leaf: int = 512, calibrate: int = 200, recall: float = 0.96, block: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest by inner product.

    The tree is fitted on at most ``sample`` rows (those whose ids hash lowest); every row is
    indexed in its leaf. ``calibrate`` of the sampled rows, as queries, are compared with all
    rows, and the number of leaves to visit is widened until their mean recall is at least
    ``recall``. So is a margin: how far below the k-th score a leaf's centre may lie. A query
    first visits that number of leaves, more if they hold fewer than ``k`` + 1 rows, then
    those within the margin of the k-th score that it has found, so a query unlike the
    calibration ones walks on. A leaf of more than ``block`` rows or queries is dealt out in
    blocks, so no task holds a whole hot leaf. A query has fewer than ``k`` results only if
    there are fewer candidates; ties go to the smaller id. ``usable`` says which rows take
    part, queries only with the candidates' length; an empty table gives no rows.
    """
    rows = checkpointed(usable(vectors, vec_id=vec_id, vector=vector))
    probe = rows.select(F.size("vector").alias("n")).first()
    asked = checkpointed(usable(queries, vec_id=vec_id, vector=vector, size=probe["n"] if probe else 0))
    spark, count = rows.sparkSession, rows.count()
    hashed = F.xxhash64("vec_id")
    rare = rows if count <= 2 * sample else rows.filter(F.pmod(hashed, F.lit(1_000_000)) < 2_000_000 * sample // count)
    picked = rare.orderBy(hashed, "vec_id").limit(sample).toArrow()
    fit_ids, fit = np.array(picked.column("vec_id").to_pylist(), np.int64), _matrix(picked.column("vector"))
    tree = KMeansTree(fit, leaf=leaf)

    def index(batches):
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaf", pa.array(tree.leaf_of(_matrix(b.column("vector")))))

    indexed = rows.mapInArrow(index, "vec_id bigint, vector array<double>, leaf bigint")
    held = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # a row a leaf of the sample's tree
    visits, margin = _calibrated(indexed, tree, fit_ids[:calibrate], fit[:calibrate], k, recall) if len(fit) else (1, 0.0)

    def route(batches):
        """Leaves of each query; with a k-th score only those beyond the first walk."""
        for b in batches:
            queries = _matrix(b.column("vector"))
            walks = [tree.visits(q, visits, held, k + 1) for q in queries]
            if "kth" in b.schema.names:
                limits = b.column("kth").to_numpy() - margin * np.sqrt((queries * queries).sum(1))
                walks = [tree.visits(q, visits, held, k + 1, limit)[len(w):] for q, w, limit in zip(queries, walks, limits)]
            at = np.repeat(np.arange(len(walks)), [len(w) for w in walks])
            if len(at):
                found = pa.array(np.concatenate(walks).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(at)) for c in ("vec_id", "vector")] + [found], ["vec_id", "vector", "leaf"])

    def search(table):
        return _met(table.mapInArrow(route, "vec_id bigint, vector array<double>, leaf bigint"), indexed, held, k, block)

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda pairs: pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = checkpointed(ranked(search(asked)))
    kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("kth"))
    more = search(asked.join(kth, "vec_id"))
    return ranked(first.drop("rank").unionByName(more)).select("query_id", "rank", "vec_id", "score")


def _met(routed: DataFrame, indexed: DataFrame, held: dict[int, int], k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: the ``k`` best of each query in each block of the leaves it visits."""
    asked = {r["leaf"]: r["count"] for r in routed.groupBy("leaf").count().collect()}
    grid = [(n, -(-held[n] // block), -(-asked[n] // block)) for n in sorted(asked.keys() & held.keys())]
    sizes = F.broadcast(routed.sparkSession.createDataFrame(grid, "leaf bigint, row_blocks int, query_blocks int"))  # at most one row a leaf

    def dealt(table, own, other):
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int")
        rest = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("rest")
        return table.join(sizes, "leaf").select("vec_id", "vector", "leaf", mine.alias("mine"), rest)

    left = dealt(indexed, "row_blocks", "query_blocks").withColumnsRenamed({"mine": "rb", "rest": "qb"})
    right = dealt(routed, "query_blocks", "row_blocks").withColumnsRenamed({"mine": "qb", "rest": "rb"})

    def meet(these, those):
        ids, qids = (np.array(t.column("vec_id").to_pylist(), np.int64) for t in (these, those))
        if not len(ids) or not len(qids):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own, wanted = _matrix(these.column("vector")), _matrix(those.column("vector"))
        found = []
        for at in range(0, len(wanted), 256):
            rough = wanted[at : at + 256] @ own.T
            found += [best(ids, own, q, v, r, k) for q, v, r in zip(qids[at : at + 256], wanted[at : at + 256], rough)]
        return pa.table({
            "query_id": np.repeat(qids, [len(f[0]) for f in found]), "vec_id": np.concatenate([f[0] for f in found]).astype(np.int64),
            "score": np.concatenate([f[1] for f in found]),
        })

    keys = ("leaf", "rb", "qb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")


def _calibrated(indexed: DataFrame, tree: KMeansTree, ids: np.ndarray, queries: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """Leaves to visit so that ``recall`` of the true neighbours of the calibration queries lie in them, and the margin.

    The margin is how far a leaf's centre may score below the k-th neighbour, for a query of
    length 1, so that as many neighbours lie in such leaves.
    """

    def scan(batches):
        top: dict[int, tuple] = {}
        for b in batches:
            own, vectors, leaves = np.array(b.column(0).to_pylist(), np.int64), _matrix(b.column(1)) if b.num_rows else None, np.array(b.column(2).to_pylist(), np.int64)
            if vectors is None:
                continue
            rough = queries @ vectors.T
            for n, q in enumerate(ids):
                found, scores = best(own, vectors, q, queries[n], rough[n], k)
                at = np.argsort(own, kind="stable")
                leaf = leaves[at[np.searchsorted(own, found, sorter=at)]]
                old = top.get(n, (np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)))
                s, i, l = np.concatenate((old[0], scores)), np.concatenate((old[1], found)), np.concatenate((old[2], leaf))
                keep = np.lexsort((i, -s))[:k]
                top[n] = s[keep], i[keep], l[keep]
        for n, (s, i, l) in top.items():
            yield pa.RecordBatch.from_pydict({"n": np.full(len(s), n), "score": s, "vec_id": i, "leaf": l})

    found = indexed.mapInArrow(scan, "n bigint, score double, vec_id bigint, leaf bigint")
    order = W.partitionBy("n").orderBy(F.desc("score"), "vec_id")
    true = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("n", "leaf", "score").collect()
    if not true or tree.leaves == 1:
        return 1, 0.0
    places = [{leaf: at for at, leaf in enumerate(tree.visits(q, tree.leaves))} for q in queries]
    centres = tree.leaf_centres()
    kth: dict[int, float] = {}
    for r in true:
        kth[r["n"]] = min(r["score"], kth.get(r["n"], np.inf))
    needed = sorted(places[r["n"]][r["leaf"]] + 1 for r in true)
    gaps = sorted((kth[r["n"]] - centres[r["leaf"]] @ queries[r["n"]]) / np.sqrt(queries[r["n"]] @ queries[r["n"]]) for r in true)
    at = min(len(true) - 1, int(np.ceil(recall * len(true))) - 1)
    return needed[at], float(gaps[at])
