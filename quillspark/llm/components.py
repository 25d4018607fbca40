"""Connected components of a graph that never leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % 1_000_000_007))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).distinct()
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, root) of every node that has an edge to another; root is the least node reachable.

    Alternates large-star and small-star steps, which converge in about the square of the logarithm of the number of
    nodes, until the edges stay the same. Sums are combined before the shuffle and joins are left to the planner, so a
    node with very many neighbours is split. Each round is a written table.
    """
    edges = saved(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where(F.col("a") != F.col("b")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = saved(small_star(large_star(edges)), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
