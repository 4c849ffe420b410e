"""Keyed writes and intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only when the session names no shared folder (local sessions, tests).
LOCAL_DEFAULT = "/tmp/checkpoints/mapquarry"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_DEFAULT


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the folder that driver and executors share."""
    path = f"{shared_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned and that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def on_workers(spark: SparkSession) -> None:
    """Name this package's folder to Python workers, which matters in sessions that were started elsewhere; clusters install the package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}".rstrip(":")


def free(name: str, *tables: DataFrame) -> str:
    """``name``, or a longer one that no column of ``tables`` has in any case, for a helper column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def active(rows: DataFrame, since: str | None = None) -> DataFrame:
    """Rows whose ``status`` is ACTIVE or missing and, with ``since``, whose ``created_at`` string isn't before it."""
    kept = rows.where(F.coalesce("status", F.lit("ACTIVE")) == "ACTIVE")
    return kept if since is None else kept.where(F.col("created_at") >= since)


def last_wins(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row a key: the last in ``order``. Aggregates before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Full outer join by key: new values win; columns in ``keep`` hold the old value where the new is null."""
    mark = free("_new", old, new)
    seen = F.col(f"n.{mark}").isNotNull()
    joined = old.alias("o").join(new.withColumn(mark, F.lit(True)).alias("n"), list(keys), "full_outer")
    cols = [
        (F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep else F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c)
        for c in old.columns if c not in keys
    ]
    return joined.select(*keys, *cols)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert that does nothing on conflict; of new rows of one key that differ the greatest is inserted, so reruns agree."""
    others = [c for c in new.columns if c not in keys]
    one = last_wins(new, keys, F.struct(*others)).select(*new.columns) if others else new.distinct()
    return old.unionByName(one.join(old, list(keys), "left_anti"))


def changed(rows: DataFrame, updates: DataFrame, key: str, column: str, guard: Column | None = None) -> DataFrame:
    """Keyed update of one column where ``guard`` holds."""
    to, met = free("_to", rows), free("_hit", rows)
    u = updates.select(key, F.col(column).alias(to), F.lit(True).alias(met))
    hit = F.col(met).isNotNull() & (guard if guard is not None else F.lit(True))
    return rows.join(u, key, "left").withColumn(column, F.when(hit, F.col(to)).otherwise(F.col(column))).select(*rows.columns)
