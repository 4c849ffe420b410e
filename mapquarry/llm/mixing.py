"""Mixing sources to target weights, in DataFrame functions only.

Tokens are summed per source, targets follow from weights and caps, and each document is
emitted ``floor(rate)`` times plus one Bernoulli copy whose coin is a keyed hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

WORD = "[^ \\t-\\r]+"
#: The table of sources is broadcast up to this many rows; beyond it adaptive joins split hot keys.
BROADCAST_ROWS = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``(source, source_size)`` -> adds ``target``.

    The level ``z`` at which uncapped sources get ``z * weight`` is found in one sorted pass: in
    order of cap / weight, the first ``k`` sources are capped when the level left for the others
    reaches past them. One row a source goes through that sort.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("at") - 1) % len(weights) + 1).cast("int"))
    sources = sizes.withColumn("at", F.row_number().over(order)).withColumn("weight", w)
    ratio = F.col("source_size") / F.col("weight")
    before = Window.orderBy(ratio, "at").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (
        F.lit(float(share)) * F.sum("source_size").over(every)
        - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    )
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    most = F.lit(float(cap)) * F.col("source_size")
    leveled = sources.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= most)
    first = F.min(F.when(F.col("open"), F.struct(ratio.alias("r"), "at", "level"))).over(every)["level"]
    final = F.least(most, F.coalesce(first * F.col("weight"), most))
    return leveled.withColumn("target", final).select("source", "source_size", "target")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1"
) -> DataFrame:
    """Copies of each document: one row per row of ``docs(doc_id, text, source)``.

    Returns doc_id, source, size, source_size, target, rate, copies, taken. Sources in code-point
    order (null last) take ``weights`` in turn. Null and empty texts have size 0 and get rate 0
    where their whole source is empty. Repeated ids share a coin; a null id has a coin of its own.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    sized = scratch.write(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    if sized.count() <= BROADCAST_ROWS:
        sized = F.broadcast(sized)
    s = sized.withColumnRenamed("source", "_source")
    return (
        rows.join(s, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")
    )


def copies(rate: Column, doc_id: Column, seed: str) -> Column:
    """``floor(rate)`` plus a copy when the id's coin in [0, 1) is below the fraction."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    coin = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as ``mix`` says, with the columns of ``docs``.

    Reads doc_id, text and source; all columns go through whatever their names. Nulls, ties and
    repeated rows count as in ``mix``; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    rows = docs.select("source", words(F.col("text")).alias("size"))
    o = {"weights": (3, 1, 2), "share": 1.5, "cap": 2.0, "seed": "mix-1"} | options
    of, rate, times, turn = (free(docs.columns, n) for n in ("source", "rate", "copies", "copy"))
    s = scratch.write(
        targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), o["weights"], o["share"], o["cap"])
        .select(F.col("source").alias(of), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate))
    )
    if s.count() <= BROADCAST_ROWS:
        s = F.broadcast(s)
    return (
        docs.join(s, F.col("source").eqNullSafe(F.col(of)))
        .withColumn(times, copies(F.col(rate), F.col("doc_id"), o["seed"]))
        .where(F.col(times) > 0)
        .withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def free(taken: list[str], name: str) -> str:
    """``name`` with as many underscores before it as no column of ``taken`` has."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name
