"""Connected components of an undirected graph by alternating star steps; edges stay tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.session import stage

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node reachable) of every node of `edges` (a, b) that has an edge to another.

    A round links every neighbour of a node to its least neighbour: first the larger ones, then the smaller ones.
    It ends when the edges don't change, which is when each component is a star around its least node.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stage(edges, "components"), None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        larger = both.where("b > a").join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("least"))
        smaller = larger.join(least, "a").where("b <> least").select("b", "least").toDF("a", "b")
        edges = stage(smaller.unionByName(least.toDF("a", "b")).distinct(), "components")
        # a table of the same edges has the same count and sum of hashes
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if after == before:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
