"""Connected components by alternating large and small stars, without a group in one task.

Each round rewrites the edges so that every node points at smaller ones; the rounds number about
the logarithm of the longest chain. Rounds are cut by tables in the shared folder. The smallest
neighbour of a node is written before it is joined back, so that adaptive execution can split a
node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialise

MAX_ROUNDS = 60


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the component is the smallest node reachable.

    Nulls, loops and repeated edges are ignored; an empty input gives an empty result.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, label)
    before = None
    for _ in range(MAX_ROUNDS):
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == before or seen["n"] == 0:
            return _labels(edges)
        before = seen
        edges = materialise(_small_star(_large_star(edges, label), label), label)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _large_star(edges: DataFrame, label: str) -> DataFrame:
    """Every larger neighbour of a node is joined to the node's smallest neighbour (or the node itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), label)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, label: str) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are joined to the smallest of them."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), label)
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _labels(edges: DataFrame) -> DataFrame:
    stars = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.union(roots.join(stars, "node", "left_anti"))
