"""Approximate nearest neighbours: one vantage-point tree per shard, pruned by the triangle inequality.

Vectors are scaled to length one, where Euclidean order is cosine order. A subtree is left when no
point in it can be closer than the ones found, judged by ``gap * factor > reach``: factor one is the
exact bound, larger factors prune more and may lose neighbours. Shards are hash buckets of
bounded size, every shard sees every query, and the best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NEIGHBOURS = 5
SHARD_ROWS = 1024
LEAF_ROWS = 64
#: Pruning factor of the registered query: exact search.
FACTOR = 1.0


def rounding(dim: int) -> float:
    """More than any scalar product of two unit vectors, or the cosine, is off in double precision:
    normalising and a sum of ``dim`` products lose less than ``dim + 8`` half units each way."""
    return 4 * (dim + 8) * 2.0**-53


class Tree:
    """Unit vectors of one shard; equal vectors are one point with their smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int) -> None:
        # a repeated id stands for the first of its vectors by their components
        order = np.lexsort((*vectors.T[::-1], ids))
        order = order[np.append(True, np.diff(ids[order]) != 0)]
        ids, vectors = ids[order], vectors[order]
        self._off = rounding(vectors.shape[1])
        # a distance is the root of 2 - 2 * product: near 0 it is off by the root of its error
        self._slack = 4 * np.sqrt(2 * self._off)
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        _, point, inverse = np.unique(
            np.ascontiguousarray(unit).view(f"V{unit.shape[1] * 8}").ravel(),
            return_index=True, return_inverse=True,
        )
        inverse = inverse.ravel()
        self.points = unit[point]
        members = np.argsort(inverse, kind="stable")  # ascending ids inside a point
        starts = np.searchsorted(inverse[members], np.arange(len(point)))
        rank = np.arange(len(members)) - starts[inverse[members]]
        members = members[rank < keep]  # of equal vectors later ids can never be among the nearest
        self._of = np.searchsorted(inverse[members], np.arange(len(point) + 1))
        self._members = members
        self.ids, self.vectors = ids, vectors
        self.root = self._grow(np.arange(len(point)), np.random.default_rng(len(point)))

    def _grow(self, at: np.ndarray, rng) -> tuple:
        if len(at) <= LEAF_ROWS:
            return (at,)
        pick = int(rng.integers(len(at)))
        vantage, rest = at[pick], np.delete(at, pick)
        d = np.sqrt(np.maximum(0, 2 - 2 * self.points[rest] @ self.points[vantage]))
        radius = float(np.median(d))
        near, far = rest[d <= radius], rest[d > radius]
        if not len(far):
            return (at,)  # all at one distance: nothing to split by
        return (vantage, radius, self._grow(near, rng), self._grow(far, rng))

    def _visit(self, queries: np.ndarray, offer, reach, factor: float) -> None:
        """Offer all queries the points that ``reach(query)`` does not rule out."""

        def distances(q: np.ndarray, at: np.ndarray) -> np.ndarray:
            products = queries[q] @ self.points[at].T
            offer(q, at, products)
            return np.sqrt(np.maximum(0, 2 - 2 * products))

        def visit(node: tuple, q: np.ndarray) -> None:
            if not len(q):
                return
            if len(node) == 1:
                distances(q, node[0])
                return
            vantage, radius, near, far = node
            d = distances(q, np.array([vantage]))[:, 0]
            inside = d <= radius
            visit(near, q[inside])
            visit(far, q[~inside])
            open_ = np.abs(d - radius) * factor <= reach(q) + self._slack
            visit(far, q[inside & open_])
            visit(near, q[~inside & open_])

        visit(self.root, np.arange(len(queries)))

    def search(self, queries: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """Rows that may be among the ``k`` nearest of each unit query: first the product of the
        k-th nearest point, then every point that rounding cannot tell from it or a nearer one."""
        best = np.full((len(queries), k), -np.inf)

        def better(q: np.ndarray, at: np.ndarray, products: np.ndarray) -> None:
            both = np.concatenate((best[q], products), axis=1)
            best[q] = -np.partition(-both, k - 1, axis=1)[:, :k]

        def reach(q: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, 2 - 2 * best[q].min(axis=1)))

        self._visit(queries, better, reach, factor)
        least = best.min(axis=1) - 2 * self._off
        hits: list[tuple[np.ndarray, np.ndarray]] = []

        def collect(q: np.ndarray, at: np.ndarray, products: np.ndarray) -> None:
            row, column = np.nonzero(products >= least[q][:, None])
            hits.append((q[row], at[column]))

        far = np.sqrt(np.maximum(0, 2 - 2 * least))
        self._visit(queries, collect, lambda q: far[q], factor)
        asked = np.concatenate([q for q, _ in hits]) if hits else np.zeros(0, np.int64)
        found = np.concatenate([at for _, at in hits]) if hits else np.zeros(0, np.int64)
        order = np.argsort(asked, kind="stable")
        asked, found = asked[order], found[order]
        cuts = np.searchsorted(asked, np.arange(len(queries) + 1))
        return [
            np.concatenate([self._members[:0], *(self._members[self._of[p] : self._of[p + 1]] for p in found[i:j])])
            for i, j in zip(cuts, cuts[1:])
        ]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In double precision, each sum from the first component to the last."""
    dot, left, right = (np.zeros(len(a)) for _ in range(3))
    for i in range(a.shape[1]):
        dot += a[:, i] * b[:, i]
        left += a[:, i] * a[:, i]
        right += b[:, i] * b[:, i]
    return dot / (np.sqrt(left) * np.sqrt(right))


def usable(vector: str) -> Column:
    """Not null, no null, NaN or infinite component, not all zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = NEIGHBOURS,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows by cosine, nearest first.

    Ties go to the smaller id; a query's own id is no candidate; with fewer candidates all come. Rows
    that are unusable or without id take no part, vectors only meet those of their length. A
    repeated id counts once, among the candidates of a length by the first of its vectors in the
    order of their components, among the queries by the shortest, then first. Empty tables give no
    rows, other columns are left out. With factor one the result is exact, near ties included: all
    points that rounding cannot tell from the k-th are compared by the cosine itself.
    """
    v = F.col(vector).cast("array<double>")
    clean = vectors.where(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector).alias("dim")
    )
    asked = queries.where(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector).alias("dim")
    )
    asked = asked.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("first"))
    asked = asked.select("id", "first.v", "first.dim")
    shards = max(1, -(-vectors.count() // shard_rows))
    placed = clean.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    every = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = placed.withColumn("ask", F.lit(False)).unionByName(every.withColumn("ask", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, ids, held = None, None, [], []
        for batch in batches:
            dims, shard = batch.column("dim").to_numpy(), batch.column("shard").to_numpy()
            ask = batch.column("ask").to_numpy(zero_copy_only=False)
            own = batch.column("id").to_numpy()
            lists = batch.column("v")
            edges = np.flatnonzero(
                (np.diff(dims) != 0) | (np.diff(shard) != 0) | (np.diff(ask.astype(int)) != 0)
            ) + 1
            for a, b in zip(np.concatenate(([0], edges)), np.append(edges, len(own))):
                if a == b:
                    continue
                now = (int(dims[a]), int(shard[a]))
                part = lists.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                if now != key:
                    key, tree, ids, held = now, None, [], []
                if not ask[a]:
                    ids.append(own[a:b])
                    held.append(part)
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(ids), np.concatenate(held), k + 1)
                unit = part / np.sqrt((part * part).sum(axis=1))[:, None]
                found = tree.search(unit, k + 1, factor)
                q = np.repeat(np.arange(b - a), [len(f) for f in found])
                at = np.concatenate(found)
                score = cosine(part[q], tree.vectors[at])
                keep = tree.ids[at] != own[a:b][q]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[a:b][q][keep]), pa.array(tree.ids[at][keep]), pa.array(score[keep])],
                    names=["query_id", "vec_id", "score"],
                )

    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    hits = (
        rows.repartition(parts, "dim", "shard")
        .sortWithinPartitions("dim", "shard", "ask", "id")
        .mapInArrow(run, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
