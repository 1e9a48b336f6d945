"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _least(pairs: DataFrame, key: str, value: str) -> DataFrame:
    return pairs.groupBy(F.col(key).alias("hub")).agg(F.min(value).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the least node of the neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "a", "b").withColumn("least", F.least("hub", "least"))
    return (
        both.filter("b > a").join(least, F.col("a") == F.col("hub"))
        .select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the least of them."""
    least = _least(edges, "a", "b")
    moved = edges.join(least, F.col("a") == F.col("hub")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select(F.col("hub").alias("a"), F.col("least").alias("b"))).filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one root and no root points further."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of non-null longs -> (node, component), component the least node reachable.

    Nodes without an edge do not appear; self-loops and repeated edges change nothing; no edges give no rows.
    Each round aggregates before it joins, so a hub costs one row per task; rounds grow with the logarithm of the
    longest path and end as soon as only stars are left. A round's table is cut into the shared folder.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        edges = cut(_small_star(_large_star(edges)))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
