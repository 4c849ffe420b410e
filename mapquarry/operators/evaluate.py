"""Retrieval metrics over ranked, graded results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ndcg(ranked: DataFrame, pool: DataFrame, k: int = 10) -> DataFrame:
    """Gains (2^rel - 1) / log2(rank + 1) of the first ``k`` of ``ranked(query_id, rank, rel)`` over the best ones.

    ``pool(query_id, rel, n)`` counts the judged rows of each grade, retrieved or not; the ideal order
    takes the highest grades first. A query whose pool has no gain gets 0; one without results too.
    """
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1)
    got = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain).alias("dcg"))
    # discounts of the ranks up to r are one number each, so that a grade's rows need no row of their own
    sums = [0.0]
    for r in range(1, k + 1):
        sums.append(sums[-1] + 1 / math.log2(r + 1))
    upto = lambda r: F.element_at(F.array(*map(F.lit, sums)), (F.least(r, F.lit(k)) + 1).cast("int"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, 0)
    graded = pool.withColumn("to", F.sum("n").over(w))
    share = (F.pow(F.lit(2.0), F.col("rel")) - 1) * (upto(F.col("to")) - upto(F.col("to") - F.col("n")))
    best = graded.groupBy("query_id").agg(F.sum(share).alias("best"))
    return best.join(got, "query_id", "left").select(
        "query_id", F.when(F.col("best") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("best")).otherwise(0.0).alias("ndcg")
    )


def recall(ranked: DataFrame, relevant: DataFrame, k: int = 20) -> DataFrame:
    """Relevant rows among the first k over all ``relevant(query_id, total)``."""
    hits = ranked.where((F.col("rank") <= k) & (F.col("rel") > 0)).groupBy("query_id").agg(F.count("*").alias("hits"))
    return relevant.join(hits, "query_id", "left").select(
        "query_id", F.when(F.col("total") > 0, F.coalesce("hits", F.lit(0)) / F.col("total").cast("double")).otherwise(0.0).alias("recall")
    )


def exact_intent_match(results: DataFrame, *by: str) -> DataFrame:
    """Share of queries whose parsed dimensions all equal the truth: ``results(query_id, dim, got, want)``, whole or by columns of a query."""
    each = results.groupBy("query_id", *by).agg(F.bool_and(F.col("got").eqNullSafe(F.col("want"))).alias("ok"))
    return each.groupBy(*by).agg(F.avg(F.col("ok").cast("double")).alias("eimr"))


def mean_by(rows: DataFrame, level: str, metric: str) -> DataFrame:
    return rows.groupBy(level).agg(F.avg(metric).alias(metric))
