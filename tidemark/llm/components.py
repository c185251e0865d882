"""Connected components of an edge table, by alternating star operations.

Each round replaces every edge by one to the smallest neighbour (large star: for neighbours above
the node; small star: for those below). Edges end as stars around the smallest node of each
component. A round is two grouped minima, combined inside tasks, and two joins on plain keys that
adaptive execution can split, so a hub with very many neighbours meets no single task. Every
round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b); root is the smallest node of its component.

    Edges from a node to itself, repeated edges and both directions of one edge change nothing; edges with a
    null end go; no edges give no rows. Rounds grow with the logarithm of the longest path, so they end.
    """
    edges = stored(edges.select("a", "b").filter("a != b").distinct(), "edges")
    seen = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
