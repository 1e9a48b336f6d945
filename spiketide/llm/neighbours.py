"""Nearest neighbours by cosine: a vantage-point tree per shard, searched by blocks of queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare

#: Vectors of a shard and queries of a block on average; they bound a task's memory whatever the table's size.
SHARD, BLOCK = 8192, 4096
LEAF = 64
#: Chord distances carry rounding errors up to about 1e-7 near zero; pruning keeps this much more.
SLACK = 1e-6


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each query with each vector, summed component by component in order, in double precision."""
    dot = np.zeros((len(q), len(x)))
    for k in range(q.shape[1]):
        dot += q[:, k, None] * x[None, :, k]
    return dot / (norm(q)[:, None] * norm(x)[None, :])


def norm(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * x[:, k]
    return np.sqrt(out)


class VPTree:
    """Vantage-point tree over unit vectors with chord distance, which orders as cosine does.

    `relax` divides the radius that a subtree has to overlap: 1 keeps the search exact, more prunes harder.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors = ids, vectors
        self.unit = vectors / norm(vectors)[:, None]
        self.leaf = leaf
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        point = rows[0]
        far = self._chord(self.unit[point][None], rows)[0]
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        mu = far[order[half]]
        return point, mu, self._build(rows[order[:half]]), self._build(rows[order[half:]])

    def _chord(self, q: np.ndarray, rows) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (q @ self.unit[rows].T)))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, relax: float = 1.0):
        """For each query the k nearest others: rows of (score, id), best first, ties to smaller ids."""
        self.q, self.q_ids, self.q_unit, self.relax = queries, ids, queries / norm(queries)[:, None], relax
        self.best = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(ids)))
        return self.best, self.who

    def _reach(self, active: np.ndarray) -> np.ndarray:
        """Chord distance of the k-th best so far."""
        worst = self.best[active, -1]
        return np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * worst))) / self.relax + SLACK

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self._leaf(node, active)
            return
        point, mu, inside, outside = node
        far = self._chord(self.q_unit[active], [point])[:, 0]
        near = far < mu
        self._visit(inside, active[near])
        self._visit(outside, active[~near])
        self._visit(outside, active[near & (mu - far <= self._reach(active))])
        self._visit(inside, active[~near & (far - mu <= self._reach(active))])

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        score = cosine(self.q[active], self.vectors[rows])
        score[self.q_ids[active][:, None] == self.ids[rows][None, :]] = -np.inf
        k = self.best.shape[1]
        scores = np.concatenate([self.best[active], score], axis=1)
        ids = np.concatenate([self.who[active], np.broadcast_to(self.ids[rows], score.shape)], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        self.best[active] = np.take_along_axis(scores, order, 1)
        self.who[active] = np.take_along_axis(ids, order, 1)


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<double>) of the vectors that take part: not null, nor zero, nor with null or non-finite components,
    with an id."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return rows.filter(F.coalesce(sound, F.lit(False))).filter(F.exists("v", lambda x: x != 0))


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, relax: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine for each query, its own id left out.

    Vectors are dealt over shards and queries over blocks by hash; a task holds one shard and one block, builds the
    shard's tree and searches it for the block. With relax 1 the result is exact. Vectors are compared with those of
    their own length only. Rows with equal ids count as one row of one of their vectors as a query and as candidates
    each. Null, zero and non-finite vectors take no part; an empty side gives no rows.
    """
    prepare(table.sparkSession)
    points, asked = usable(table, id_col, vector_col), usable(queries, id_col, vector_col).dropDuplicates(["id"])
    shards = max(1, -(-points.count() // shard))
    blocks = max(1, -(-asked.count() // block))
    dealt = points.withColumns({"s": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "n": F.size("v")})
    posed = asked.withColumns({"b": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "s": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "n": F.size("v")})

    def search(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(points) or not len(asked):
            return none
        tree = VPTree(points["id"].to_numpy(), np.stack(points["v"].to_numpy()))
        ids = asked["id"].to_numpy()
        best, who = tree.search(ids, np.stack(asked["v"].to_numpy()), k, relax)
        found = np.isfinite(best)
        return pd.DataFrame({"query_id": np.repeat(ids, found.sum(1)), "vec_id": who[found], "score": best[found]})

    found = dealt.groupBy("s", "b", "n").cogroup(posed.groupBy("s", "b", "n")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
