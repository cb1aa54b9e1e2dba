"""Connected components by alternating large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import publish


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node has one neighbour below it, which has none itself."""
    n, nodes = edges.agg(F.count("*"), F.countDistinct("a")).first()
    return n == nodes and not edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").take(1)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root (smallest node of its component) for the nodes of edges (a, b); loops are ignored.

    A node with very many neighbours is no problem: minima are partial aggregates, and the join
    that hands them out is an equi-join, which adaptive execution splits on a hot key. Each
    round is written to the shared folder.
    """
    now = publish(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while not _settled(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = publish(small, label)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
