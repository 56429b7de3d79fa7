"""Nearest neighbours with a vantage-point tree per shard.

Vectors are dealt into shards of bounded size and each shard is built into one tree, stored as one row.
Queries come in blocks of bounded size; a task searches one tree for one block. A subtree is skipped for
a query when, by the triangle inequality, everything in it is further away than the query's k-th best so
far divided by ``relax``: with 1 nothing nearer is ever skipped and the search is exact, larger factors
skip more. The best of all shards are merged by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightwatch.llm.registry import query
from flightwatch.llm.tables import settled, table

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
LEAF = 64
#: Rounding of a bound: nothing is skipped on a difference this small.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` (doubles) of vectors that take part: not null, empty or all zero, every component finite."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return (vectors.filter(v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(some, F.lit(False))
                           & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")))


def _runs(batches, rows: int):
    """(dimension, ids, matrix) of runs of at most ``rows`` rows; vectors of unlike length never mix."""
    kept: dict[int, list] = {}

    def ready(d):
        ids, vs = zip(*kept.pop(d), strict=True)
        return d, np.asarray(ids, np.int64), np.stack(vs)

    for batch in batches:
        for i, v in zip(batch.vec_id, batch.v, strict=True):
            group = kept.setdefault(len(v), [])
            group.append((i, np.asarray(v, np.float64)))
            if len(group) == rows:
                yield ready(len(v))
    for d in list(kept):
        yield ready(d)


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points and, per node, ``begin, end, near, far`` and the least and largest distance
    from the vantage point to each child.

    The vantage point of a node is its first point in the order. Children are the nearer and the further
    half, so the tree is balanced even if all points are equal.
    """
    order = np.arange(len(points))
    nodes: list[list[int]] = []
    reach: list[list[float]] = []

    def grow(begin: int, end: int) -> int:
        me = len(nodes)
        nodes.append([begin, end, -1, -1])
        reach.append([0.0, 0.0, 0.0, 0.0])
        if end - begin > LEAF:
            rest = order[begin + 1:end]
            d = np.sqrt(((points[rest] - points[order[begin]]) ** 2).sum(axis=1))
            by = np.argsort(d, kind="stable")
            order[begin + 1:end] = rest[by]
            d, half = d[by], len(by) // 2
            reach[me] = [d[0], d[half - 1], d[half], d[-1]]
            nodes[me][2] = grow(begin + 1, begin + 1 + half)
            nodes[me][3] = grow(begin + 1 + half, end)
        return me

    grow(0, len(points))
    return order, np.asarray(nodes, np.int64), np.asarray(reach)


class Search:
    """The k best of one tree for a block of queries, ties to the smaller id."""

    def __init__(self, ids, points, nodes, reach, query_ids, queries, k: int, relax: float):
        self.ids, self.points, self.nodes, self.reach = ids, points, nodes, reach
        self.query_ids, self.queries, self.k, self.relax = query_ids, queries, k, relax
        self.best = np.full((len(queries), k), np.inf)
        self.who = np.full((len(queries), k), np.iinfo(np.int64).max)

    def run(self):
        self.visit(0, np.arange(len(self.queries)))
        return self.best, self.who

    def measure(self, active: np.ndarray, begin: int, end: int) -> np.ndarray:
        d = np.empty((len(active), end - begin))
        for at in range(0, len(active), 64):
            part = self.queries[active[at:at + 64], None, :] - self.points[None, begin:end]
            d[at:at + 64] = np.sqrt((part * part).sum(axis=2))
        return d

    def offer(self, active: np.ndarray, begin: int, end: int, d: np.ndarray) -> None:
        ids = np.broadcast_to(self.ids[begin:end], d.shape)
        d = np.where(ids == self.query_ids[active, None], np.inf, d)  # never the query itself
        d = np.concatenate([self.best[active], d], axis=1)
        who = np.concatenate([self.who[active], np.where(np.isinf(d[:, self.k:]), np.iinfo(np.int64).max, ids)], axis=1)
        by = np.lexsort((who, d))[:, :self.k]
        self.best[active], self.who[active] = np.take_along_axis(d, by, 1), np.take_along_axis(who, by, 1)

    def visit(self, node: int, active: np.ndarray) -> None:
        if not len(active):
            return
        begin, end, near, far = self.nodes[node]
        if near < 0:
            self.offer(active, begin, end, self.measure(active, begin, end))
            return
        d = self.measure(active, begin, begin + 1)
        self.offer(active, begin, begin + 1, d)
        d = d[:, 0]
        near_lo, near_hi, far_lo, far_hi = self.reach[node]
        inner = d < (near_hi + far_lo) / 2
        for first in (True, False):  # every query sees its own side first, then, if it must, the other
            for child, lo, hi, mine in ((near, near_lo, near_hi, inner == first), (far, far_lo, far_hi, inner != first)):
                gap = np.maximum(lo - d, d - hi)
                need = gap * self.relax * (1 - SLACK) - SLACK <= self.best[active, -1]
                self.visit(child, active[mine & need])


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def tree_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: a tree over at most ``shard_rows`` of the ``vec_id, v`` given."""
    def build(batches):
        for d, ids, points in _runs(batches, shard_rows):
            order, nodes, reach = build_tree(points)
            yield pd.DataFrame([{"dim": d, "ids": _pack(ids[order]), "points": _pack(points[order]),
                                 "nodes": _pack(nodes), "reach": _pack(reach)}])

    return vectors.mapInPandas(build, "dim int, ids binary, points binary, nodes binary, reach binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, relax: float = 1.0,
            shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest of ``vectors`` for each row of ``queries`` (both ``vec_id, v`` as from ``usable``).

    Returns ``query_id, rank, vec_id, score``: Euclidean distance in doubles, nearest first, ties to the
    smaller id; all candidates if there are fewer than ``k``. A vector never finds its own id, and is only
    compared with vectors of its own length. A repeated candidate row counts as often as it occurs, a
    repeated query id is answered once. Empty tables give no rows. ``relax`` of 1 is exact.
    """
    if k < 1 or relax < 1:
        raise ValueError("k and relax must be at least 1")
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    trees = settled(tree_index(vectors.repartition(shards), shard_rows)
                    .withColumn("shard", F.monotonically_increasing_id()))

    def block(batches):
        for d, ids, points in _runs(batches, block_rows):
            yield pd.DataFrame([{"dim": d, "query_ids": _pack(ids), "queries": _pack(points)}])

    asked = queries.dropDuplicates(["vec_id"]).mapInPandas(block, "dim int, query_ids binary, queries binary")

    def search(batches):
        for batch in batches:
            for r in batch.itertuples():
                ids = np.frombuffer(r.query_ids, np.int64)
                best, who = Search(
                    np.frombuffer(r.ids, np.int64), np.frombuffer(r.points).reshape(-1, r.dim),
                    np.frombuffer(r.nodes, np.int64).reshape(-1, 4), np.frombuffer(r.reach).reshape(-1, 4),
                    ids, np.frombuffer(r.queries).reshape(-1, r.dim), k, relax).run()
                at, _ = np.nonzero(np.isfinite(best))
                yield pd.DataFrame({"query_id": ids[at], "vec_id": who[np.isfinite(best)], "score": best[np.isfinite(best)]})

    # Each block of queries goes to every tree of its dimension; both sides of a pair are bounded.
    places = trees.select("shard", F.col("dim").alias("_dim"))
    pairs = (asked.join(places, F.col("dim") == F.col("_dim")).select("shard", "query_ids", "queries")
             .join(trees, "shard").repartition("shard", F.xxhash64("query_ids")))
    found = pairs.mapInPandas(search, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@query("op2_neighbours", """
WITH fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
""")
def op2_neighbours(spark, sf_dir):
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
