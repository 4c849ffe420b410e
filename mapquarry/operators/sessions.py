"""Conversation turns: indices, previews, recent turns, completion; stage durations of a status feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import shorten

#: Stages of a request in order.
STAGES = ("intent", "normalise", "match", "filter", "score", "evidence", "select", "answer")


#: Dimensions that a title names, in order.
TITLED = ("topic", "format", "license", "organization", "source", "space", "time")


def next_index(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    n = turns.groupBy("conv_id").agg(F.max("turn").alias("m"))
    return conversations.join(n, "conv_id", "left").select("conv_id", F.coalesce(F.col("m") + 1, F.lit(0)).cast("long").alias("next_turn"))


def previews(turns: DataFrame, n: int = 100) -> DataFrame:
    """First user message of each conversation, cut at ``n`` characters."""
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", shorten(F.col("text"), n).alias("preview"))


def recent(turns: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` turns of each conversation as ``role: text`` lines in order."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    line = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("recent"))


def last_of_role(turns: DataFrame, role: str) -> DataFrame:
    return turns.where(F.col("role") == role).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def completed(turns: DataFrame) -> DataFrame:
    """Conversations with an assistant turn whose meta says done, or holds datasets (``meta`` is JSON)."""
    data = F.get_json_object("meta", "$.datasets")
    some = data.isNotNull() & ~F.trim(data).isin("", "[]", "{}", "0", "null", "false")
    done = (F.get_json_object("meta", "$.stage") == "done") | some
    return turns.groupBy("conv_id").agg(F.bool_or((F.col("role") == "assistant") & F.coalesce(done, F.lit(False))).alias("completed"))


def visible(conversations: DataFrame, user: str) -> DataFrame:
    return conversations.where(~F.col("deleted") & (F.col("shareable") | (F.col("api_key") == user)))


def listed(conversations: DataFrame) -> DataFrame:
    """Conversations in the order of their listing: newest first, ties by id."""
    return conversations.orderBy(F.desc("created_at"), "conv_id")


def title(intent: Column, n: int = 100) -> Column:
    """Title of a conversation from a struct of texts by dimension: the known ones in order, cut at ``n`` characters."""
    parts = [F.when(F.coalesce(F.trim(intent[d]), F.lit("")) != "", F.trim(intent[d])) for d in TITLED]
    return shorten(F.concat_ws(" | ", *parts), n)


def latest_state(feed: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return feed.groupBy(key).agg(F.max_by(value, order).alias(value))


def status_feed(events: DataFrame) -> DataFrame:
    """Status changes read from the events table: user, stage number, status, time in microseconds."""
    stage = (F.get_json_object("props", "$.k").cast("long") % len(STAGES)).alias("stage")
    status = F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "skipped")
    return events.select(F.col("user_id").alias("session"), stage, status.alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id").where("status is not null")


def durations(feed: DataFrame) -> DataFrame:
    """Every closing that ends a running stage: from the first ``active`` since the last closing.

    A closing starts a new island; within an island the first ``active`` counts, and an island
    without one gives no duration.
    """
    w = Window.partitionBy("session", "stage").orderBy("at", "event_id")
    closing = (F.col("status") != "active").cast("int")
    island = F.sum(closing).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = feed.withColumn("island", F.coalesce(island, F.lit(0)))
    g = marked.groupBy("session", "stage", "island").agg(
        F.min(F.when(F.col("status") == "active", F.col("at"))).alias("start"), F.max(F.when(F.col("status") != "active", F.col("at"))).alias("stop"),
        F.max(F.when(F.col("status") != "active", F.col("status"))).alias("status"),
    )
    return g.where("start is not null and stop is not null").select("session", "stage", "status", (F.col("stop") - F.col("start")).alias("micros"), "stop")


def pipeline_state(feed: DataFrame, spans: DataFrame) -> DataFrame:
    """All stages of every session with their last closing status and last duration."""
    dims = feed.sparkSession.createDataFrame([(k, s) for k, s in enumerate(STAGES)], "stage long, name string")
    last = feed.where("status != 'active'").groupBy("session", "stage").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"))
    took = spans.groupBy("session", "stage").agg(F.max_by("micros", "stop").alias("micros"))
    every = feed.select("session").distinct().withColumn("stage", F.explode(F.array(*[F.lit(k).cast("long") for k in range(len(STAGES))])))
    return (
        every.join(F.broadcast(dims), "stage").join(last, ["session", "stage"], "left").join(took, ["session", "stage"], "left")
        .select("session", "stage", "name", F.coalesce("status", F.lit("pending")).alias("status"), "micros")
    )
