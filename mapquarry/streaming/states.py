"""State of conversations over a stream of messages, kept in value, list and map state with timers.

A message is (conv_id, at, seq, kind, name, value); ``at`` counts microseconds after 1970 and orders with ``seq``. Kinds: ``intent`` sets
a dimension, ``question`` leaves a question pending that ``answer`` takes back, ``turn`` joins the memory, ``reset`` starts a
new question, which clears these three; ``subscribe`` and ``unsubscribe`` open and close the status feed, and a ``status``
goes out only while it is open. A conversation that was idle for longer than ``idle`` begins anew, subscription included.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.tables import on_workers

MESSAGES = "conv_id long, at long, seq long, kind string, name string, value string"
#: ``state`` rows tell a conversation's state after a batch, ``status`` rows are delivered, ``expired`` rows tell whose state went.
OUT = "row string, conv_id long, at long, seq long, name string, value string, question long, intent string, pending string, turns long, last_turn string, subscribed boolean"
ROW = Row(*(c.split()[0] for c in OUT.split(", ")))
STATE = ["conv_id", "at", "seq", "question", "intent", "pending", "turns", "last_turn", "subscribed"]
#: Microseconds after which a conversation is idle.
IDLE = 24 * 3600 * 1_000_000
#: Files a batch so that all that are there are one.
ALL = 2**31 - 1
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Conversations(StatefulProcessor):
    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # counts of the memory and the timer that waits are kept here too: a batch neither reads the memory nor looks for timers
        self.last = handle.getValueState("last", "at long, seq long, question long, pending string, subscribed boolean, turns long, last_turn string, timer long")
        self.intent = handle.getMapState("intent", "dim string", "value string")
        self.memory = handle.getListState("memory", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get()
        at, seq, question, pending, subscribed, turns, last_turn, timer = known or (None, None, 0, None, False, 0, None, None)
        cleared, dims, said, out = False, {}, [], []
        # the order of time, whatever order the batch has
        for now, number, kind, name, value in sorted(((r.at, r.seq, r.kind, r.name, r.value) for r in rows), key=lambda r: r[:2]):
            idle = at is not None and now - at > self.idle
            if idle or kind == "reset":
                cleared, dims, said, pending, turns, last_turn = True, {}, [], None, 0, None
                subscribed = subscribed and not idle
            question += kind == "reset"
            if kind == "intent":
                dims[name] = value
            elif kind in ("question", "answer"):
                pending = value if kind == "question" else None
            elif kind == "turn":
                said.append(value)
                turns, last_turn = turns + 1, value
            elif kind in ("subscribe", "unsubscribe"):
                subscribed = kind == "subscribe"
            elif kind == "status" and subscribed:
                out.append(ROW("status", key[0], now, number, name, value, *[None] * 6))
            at, seq = now, number
        if cleared and known:
            self.intent.clear()
            self.memory.clear()
        for dim, value in dims.items():
            self.intent.updateValue((dim,), (value,))
        if said:
            self.memory.appendList([(x,) for x in said])
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (at + self.idle) // 1000 + 1
        self.handle.registerTimer(timer)
        self.last.update((at, seq, question, pending, subscribed, turns, last_turn, timer))
        held = dims if cleared or not known else {k[0]: v[0] for k, v in self.intent.iterator()}
        intent = ";".join(f"{k}={'' if v is None else v}" for k, v in sorted(held.items()))
        yield from out
        yield ROW("state", key[0], at, seq, None, None, question, intent, pending, turns, last_turn, subscribed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What an idle conversation held goes; its count of questions and the time of its last message stay."""
        at, seq, question, *_ = self.last.get()
        self.intent.clear()
        self.memory.clear()
        self.last.update((at, seq, question, None, False, 0, None, None))
        yield ROW("expired", key[0], at, seq, None, None, question, "", None, 0, None, False)

    def close(self) -> None:
        pass


def stream(messages: DataFrame, idle: int = IDLE, late: int | None = None) -> DataFrame:
    """Rows of ``OUT`` for a stream of messages; one more than ``late`` (by default ``idle``) behind the greatest time is dropped.

    Messages of one conversation must not come before earlier batches' in time.
    """
    timed = messages.withColumn("time", F.timestamp_micros("at")).withWatermark("time", f"{idle if late is None else late} microseconds")
    return timed.groupBy("conv_id").transformWithState(Conversations(idle), OUT, "Append", "EventTime")


def run(spark: SparkSession, path: str, out: str, checkpoint: str, files: int = 1, idle: int = IDLE) -> DataFrame:
    """Drain the message files of ``path``, ``files`` a batch, into the Parquet table ``out``; a second call goes on where the first ended."""
    key = "spark.sql.streaming.stateStore.providerClass"
    on_workers(spark)
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        source = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files).parquet(path)
        q = stream(source, idle).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(OUT).parquet(out)


def latest(rows: DataFrame) -> DataFrame:
    """The state of each conversation after its last message."""
    others = [c for c in STATE if c != "conv_id"]
    best = rows.where("row = 'state'").groupBy("conv_id").agg(F.max_by(F.struct(*others), F.struct("at", "seq")).alias("s"))
    return best.select("conv_id", *[F.col(f"s.{c}").alias(c) for c in others])


def delivered(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'status'").select("conv_id", "at", "seq", "name", "value")


# ---- the same as batch plans -------------------------------------------------------------------


def _marked(messages: DataFrame, idle: int) -> DataFrame:
    """Messages with the number of pauses, of beginnings (pauses and resets) and of questions up to them."""
    w = Window.partitionBy("conv_id").orderBy("at", "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    pause = F.coalesce(F.col("at") - F.lag("at").over(w) > idle, F.lit(False))
    reset = F.col("kind") == "reset"
    rows = messages.withColumns({"pause": pause, "reset": reset})
    count = lambda c: F.sum(c.cast("long")).over(so_far)
    return rows.withColumns({"visit": count(F.col("pause")), "epoch": count(F.col("pause") | F.col("reset")), "question": count(F.col("reset"))})


def states(messages: DataFrame, idle: int = IDLE) -> DataFrame:
    """The state of each conversation after its last message, as ``latest`` of the stream has it."""
    rows = _marked(messages, idle)
    last = rows.groupBy("conv_id").agg(F.max("epoch").alias("epoch"), F.max("visit").alias("visit"), F.max("question").alias("question"), F.max(F.struct("at", "seq")).alias("m"))
    when = F.struct("at", "seq")
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    now = rows.join(last.select("conv_id", "epoch"), ["conv_id", "epoch"])
    dims = now.where(is_("intent")).groupBy("conv_id", "name").agg(F.max_by("value", when).alias("value"))
    intent = dims.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "value"))), lambda d: F.concat(d["name"], F.lit("="), F.coalesce(d["value"], F.lit("")))), ";").alias("intent"))
    asked = F.max_by(F.when(is_("question"), F.col("value")), F.when(is_("question", "answer"), when))
    said = now.groupBy("conv_id").agg(asked.alias("pending"), F.count_if(is_("turn")).alias("turns"), F.max_by("value", F.when(is_("turn"), when)).alias("last_turn"))
    visit = rows.join(last.select("conv_id", "visit"), ["conv_id", "visit"])
    feed = visit.groupBy("conv_id").agg(F.max_by("kind", F.when(is_("subscribe", "unsubscribe"), when)).alias("feed"))
    return (
        last.join(said, "conv_id", "left").join(intent, "conv_id", "left").join(feed, "conv_id", "left")
        .select("conv_id", "m.at", "m.seq", "question", F.coalesce("intent", F.lit("")).alias("intent"), "pending", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"), "last_turn", F.coalesce(F.col("feed") == "subscribe", F.lit(False)).alias("subscribed"))
    )


def statuses(messages: DataFrame, idle: int = IDLE) -> DataFrame:
    """The status messages that are delivered."""
    w = Window.partitionBy("conv_id", "visit").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    feed = F.last(F.when(F.col("kind").isin("subscribe", "unsubscribe"), F.col("kind")), ignorenulls=True).over(w)
    rows = _marked(messages, idle).withColumn("feed", feed)
    return rows.where("kind = 'status' and feed = 'subscribe'").select("conv_id", "at", "seq", "name", "value")
