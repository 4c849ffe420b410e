"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing Parquet below ``spark.checkpoint.dir``.  The
files outlive any executor, so a lost executor costs a re-read and never a wrong result.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only when the session names no shared folder (local sessions, tests).
LOCAL_DEFAULT = "/tmp/checkpoints/mapquarry"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_DEFAULT


def sized(spark: SparkSession, records: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that long texts don't fill a Python worker.

    Plans run after this call returns, so the bound stays set for the session; larger ones are lowered, smaller ones kept.
    Also names this package's folder to Python workers, which matters in sessions that were
    started elsewhere; clusters install the package or ship it with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}".rstrip(":")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > records:
        spark.conf.set(key, str(records))


class Scratch:
    """Named tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Materialise ``df`` and return it as a scan of the written files."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``write`` returned and that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
