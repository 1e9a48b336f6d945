"""Complete-linkage clustering of a bounded number of summaries, cut into clusters, and their silhouette.

Rows are summed up into cells first (number and mean), which merge in any order; only the cells, at most `most`, are linked. No
table of all pairs is made.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chain(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Complete linkage by nearest-neighbour chains: (a, b, height) of each merge in order of height; clusters are known by their least
    point. Equally near neighbours: the least counts."""
    n = len(points)
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    alive, stack, merges = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not stack:
            stack.append(int(np.flatnonzero(alive)[0]))
        a = stack[-1]
        row = np.where(alive, d[a], np.inf)
        b = int(np.argmin(row))
        if len(stack) > 1 and d[a, stack[-2]] <= row[b]:
            b = stack[-2]
            stack = stack[:-2]
            low, high = min(a, b), max(a, b)
            merges.append((low, high, float(d[a, b])))
            joined = np.maximum(d[low], d[high])
            d[low], d[:, low] = joined, joined
            d[low, low] = np.inf
            alive[high] = False
        else:
            stack.append(b)
    return sorted(merges, key=lambda m: m[2])


def cut(merges: list[tuple[int, int, float]], n: int, clusters: int | None = None, height: float | None = None) -> np.ndarray:
    """The cluster of each of n points, numbered from 0 in order of their least point: so many clusters, or those joined below a height."""
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, b, h) in enumerate(merges):
        if (clusters is not None and n - k <= clusters) or (height is not None and h >= height):
            break
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    roots = np.array([root(i) for i in range(n)], int)
    return np.unique(roots, return_inverse=True)[1]


def cells(vectors: DataFrame, key: str, vector: str, most: int, seed: int = 1) -> DataFrame:
    """(key, v, cell): vectors with the number of their cell: one for each different vector if these are at most `most`, else the nearest of so
    many k-means centres."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    distinct = rows.select("v").distinct().limit(most + 1).collect()
    if len(distinct) <= most:
        numbered = rows.sparkSession.createDataFrame([(i, list(r[0])) for i, r in enumerate(sorted(distinct, key=lambda r: list(r[0])))], "cell int, v array<double>")
        return rows.join(F.broadcast(numbered), "v").select(key, "v", "cell")
    ready = rows.withColumn("features", array_to_vector("v"))
    return KMeans(k=most, seed=seed).fit(ready).transform(ready).select(key, "v", F.col("prediction").cast("int").alias("cell"))


def complete_linkage(vectors: DataFrame, key: str, vector: str, clusters: int | None = None, height: float | None = None, most: int = 512) -> DataFrame:
    """(key, cluster): complete-linkage clusters of the cells' means, so many or those joined below a height; see cells().

    Clusters are numbered by their least mean in order of components. Null vectors are left out; vectors have one length and
    finite components. With as few different vectors as `most` the result is that of linking every vector.
    """
    placed = cells(vectors, key, vector, most)
    means = placed.select("cell", F.posexplode("v").alias("k", "x")).groupBy("cell", "k").agg(F.avg("x").alias("x"))
    rows = means.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean")).collect()  # at most `most`
    rows = sorted(rows, key=lambda r: list(r["mean"]))
    points = np.array([r["mean"] for r in rows], float)
    labels = cut(chain(points), len(rows), clusters, height) if len(rows) else []
    named = vectors.sparkSession.createDataFrame([(r["cell"], int(c)) for r, c in zip(rows, labels, strict=True)], "cell int, cluster int")
    return placed.join(F.broadcast(named), "cell").select(key, "cluster")


def silhouette(vectors: DataFrame, labels: DataFrame, key: str, vector: str) -> DataFrame:
    """(cluster, n, silhouette): simplified silhouettes, averaged by cluster: of a vector's distances a from its cluster's mean and b from the nearest other
    mean, (b - a) / max(a, b); null with a single cluster, 0 where both are 0. Means of clusters are broadcast."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")).join(labels.select(key, "cluster"), key)
    means = rows.select("cluster", F.posexplode("v").alias("k", "x")).groupBy("cluster", "k").agg(F.avg("x").alias("x"))
    means = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean"))
    every = means.agg(F.collect_list(F.struct("cluster", "mean")).alias("means"))
    far = lambda m: F.sqrt(F.aggregate(F.zip_with("v", m, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))
    split = rows.join(F.broadcast(every)).withColumn("d", F.transform("means", lambda m: F.struct(m["cluster"].alias("cluster"), far(m["mean"]).alias("far"))))
    least = lambda test: F.array_min(F.transform(F.filter("d", test), lambda x: x["far"]))
    told = split.select("cluster", least(lambda x: x["cluster"] == F.col("cluster")).alias("a"), least(lambda x: x["cluster"] != F.col("cluster")).alias("b"))
    s = F.when(F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return told.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"))
