"""Connected components of a graph given as links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settled


def connected(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b: long): root is one node of its component.

    Alternating star contraction: each round hangs the larger neighbours of every node under its
    smallest neighbour, then the smaller ones likewise, until nothing changes, in a number of
    rounds that grows with the logarithm of the longest path. A hub's neighbours are met by a
    join, whose large partitions Spark splits, and its minimum by a partial aggregate.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _digest(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settled(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = _digest(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct()
            )
        seen = now


def _digest(edges: DataFrame) -> tuple:
    low, high = F.shiftright(F.xxhash64("a", "b"), 32), F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(low), F.sum(high)).first())
