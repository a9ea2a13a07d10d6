"""Connected components of a graph given as an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the least of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none."""
    each = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    return each.groupBy("node").agg(F.sum("down").alias("n"), F.min("down").alias("root")).where("n > 1 or n = 1 and root = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of longs to (node, component): the least node reachable; one row per node that has an edge.

    Rounds continue until the edges are stars around least nodes; every round is a
    table in the shared folder.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for turn in range(MOST_ROUNDS):
        before, edges = edges, scratch(_small_star(_large_star(edges)), "edges")
        if turn:
            discard(before)
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components did not settle")
