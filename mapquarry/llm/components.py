"""Connected components by alternating large-star and small-star rounds.

Each round rewrites the edge list so that every node moves closer to the least id it can see;
the fixpoint is one star per component.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: A table of node minima is broadcast up to this many rows (16 bytes each), else it is joined
#: by a sort-merge join whose hot partitions adaptive execution splits.
BROADCAST_ROWS = 100_000


def _beside(rows: DataFrame, least: DataFrame) -> DataFrame:
    if least.count() <= BROADCAST_ROWS:
        least = F.broadcast(least)
    return rows.join(least, "u")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)`` for every node of an edge that isn't its root.

    ``root`` is the least node reachable. Self-loops, repeated and null edges are ignored; an
    empty input gives an empty result.
    """
    e = scratch.write(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(e)
    while state[0]:
        back = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = scratch.write(
            e.unionByName(back).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        )
        large = scratch.write(_beside(back, low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = scratch.write(
            _beside(large, low2).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        )
        for t in (e, low, large, low2):
            scratch.drop(t)
        e, before, state = small, state, _state(small)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
