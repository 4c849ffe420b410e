"""Writers: JSON arrays, merge logs, keyed tables, tables that streams write to."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import last_wins, upsert


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_merge_log(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def merge_table(new: DataFrame, path: str, keys: list[str], out: str, keep: tuple[str, ...] = ()) -> None:
    """Upsert into the Parquet table at ``path``, written to ``out`` (never in place)."""
    old = new.sparkSession.read.parquet(path)
    upsert(old, new, keys, keep).write.mode("overwrite").parquet(out)


@dataclass
class KeyedSink:
    """A keyed table that ``foreachBatch`` writes to; a batch that is written again replaces itself.

    Each batch has a folder named by its number and is read once all of it is there. Of rows with one key the first
    batch's counts (``update`` false: do nothing on conflict) or the last batch's (``update`` true); within a batch the first
    or last in ``order``, which must tell rows of one key apart. Rows with a null key go.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: Sequence[str]
    order: Sequence[str]
    update: bool = False

    def _wins(self, rows: DataFrame, *first: Column) -> DataFrame:
        when = F.struct(*first, *self.order)
        if self.update:
            return last_wins(rows, list(self.keys), when)
        others = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.min_by(F.struct(*others), when).alias("_row"))
        return best.select(*self.keys, *[F.col(f"_row.{c}").alias(c) for c in others])

    def write(self, batch: DataFrame, number: int) -> None:
        """For ``writeStream.foreachBatch``: one row a key of ``batch`` as batch ``number``."""
        columns = batch.sparkSession.createDataFrame([], self.schema).columns
        whole = batch.select(*columns).dropna(subset=list(self.keys))
        self._wins(whole).write.mode("overwrite").parquet(f"{self.path}/batch={int(number):010d}")

    def _batches(self) -> list[str]:
        """Folders of batches that are complete."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(conf)
        if not files.exists(root):
            return []
        found = [x.getPath() for x in files.listStatus(root) if x.getPath().getName().startswith("batch=")]
        return sorted(p.toString() for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        """The table as its batches leave it; without one it is empty."""
        folders = self._batches()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, batch long").option("basePath", self.path).parquet(*folders)
        return self._wins(rows, F.col("batch")).select(*self.spark.createDataFrame([], self.schema).columns)


TURNS = "conversation_id long, question_index int, turn_index int, role string, text string"


def turn_sink(spark: SparkSession, path: str) -> KeyedSink:
    """Conversation turns; one that is known by conversation, question and turn stays as it is."""
    return KeyedSink(spark, path, TURNS, ["conversation_id", "question_index", "turn_index"], ["role", "text"])


def turns(rows: DataFrame) -> DataFrame:
    """Rows that may be written as turns: indices from 1 on, missing roles and texts as empty ones."""
    kept = rows.where("conversation_id is not null and question_index >= 1 and turn_index >= 1")
    return kept.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
