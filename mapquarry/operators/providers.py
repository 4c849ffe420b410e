"""External-model operators behind one protocol; the default answers are deterministic and offline."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free

#: Rows of a model call.
BATCH = 12


class Provider(Protocol):
    def __call__(self, texts: list[str]) -> list[str]: ...


def no_topics(texts: list[str]) -> list[str]:
    """The answer of a failed extraction: no topics."""
    return ["[]"] * len(texts)


def create_topic(texts: list[str]) -> list[str]:
    """The answer of a failed decision: create the topic."""
    return ["create"] * len(texts)


def answer(rows: DataFrame, text: str, name: str, provider: Provider, batch: int = BATCH) -> DataFrame:
    """Adds the provider's answer to each row in batches of a partition, and ``<name>_error``.

    An error leaves null in its batch and its text beside it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[str | None] = []
            errors: list[str | None] = []
            for k in range(0, len(f), batch):
                part = f[text].iloc[k : k + batch].tolist()
                try:
                    out += provider(part)
                    errors += [None] * len(part)
                except Exception as e:
                    out += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"[:500]] * len(part)
            yield f.assign(**{name: out, f"{name}_error": errors})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, `{name}` string, `{name}_error` string")


def embedding_states(rows: DataFrame, text: str, vectors: DataFrame | None) -> DataFrame:
    """``SKIPPED`` for blank texts, ``DONE`` where ``vectors(id, embedding)`` has one, ``FAILED`` elsewhere."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    if vectors is None:
        return rows.withColumn("embedding_status", F.when(blank, "SKIPPED").otherwise("FAILED"))
    got = vectors.select("id", F.lit(True).alias("_got")).dropDuplicates(["id"])
    return rows.join(got, "id", "left").withColumn(
        "embedding_status", F.when(blank, "SKIPPED").when(F.col("_got"), "DONE").otherwise("FAILED")
    ).drop("_got")


def reserve(rows: DataFrame, limit: int, now: Column, stuck_after: str = "1 HOUR") -> DataFrame:
    """Marks the next ``limit`` rows IN_PROGRESS at ``now``: rows without a status, or stuck in progress for longer.

    ``rows(id, embedding_status, reserved_at, ...)``; least ids first.
    """
    open_ = F.col("embedding_status").isNull() | (F.col("embedding_status") == "IN_PROGRESS") & (F.col("reserved_at") < now - F.expr(f"INTERVAL {stuck_after}"))
    mark = free("_taken", rows)
    taken = rows.where(open_).select("id").orderBy("id").limit(limit).withColumn(mark, F.lit(True))
    marked = rows.join(taken, "id", "left")
    return (
        marked.withColumn("embedding_status", F.when(F.col(mark), "IN_PROGRESS").otherwise(F.col("embedding_status")))
        .withColumn("reserved_at", F.when(F.col(mark), now).otherwise(F.col("reserved_at"))).drop(mark)
    )


def select_top(ranked: DataFrame, choices: DataFrame | None, n: int = 10) -> DataFrame:
    """Datasets that a model chose, by its rank, with 3 reasons at most; the first ``n`` ranked when it gave none."""
    if choices is None:
        return ranked.where(F.col("rank") <= n).select("dataset_id", "rank", F.array().cast("array<string>").alias("reasons"))
    good = choices.where("rank > 0").select("dataset_id", "rank", F.slice("reasons", 1, 3).alias("reasons"))
    return good.join(ranked.select("dataset_id"), "dataset_id", "left_semi").orderBy("rank").limit(n)
