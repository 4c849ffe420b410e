"""Connected components of a graph of any ids by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)`` of every node that isn't the least of its component.

    Large stars hang a node's greater neighbours on the least node it sees, small stars its lesser
    ones; rounds grow with the logarithm of the longest chain. Self-loops, repeated and null edges are
    ignored. Each round's table replaces the one before.
    """
    star = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, now = None, _digest(star)
    while now != before and now[0]:
        back = star.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = star.unionByName(back).groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = materialise(back.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        nxt = materialise(small.unionByName(least.select("u", F.col("low").alias("v"))).distinct())
        drop(star, large)
        star, before, now = nxt, now, _digest(nxt)
    return star.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(star: DataFrame) -> tuple:
    return tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
