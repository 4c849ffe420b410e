"""A persisted inverted-file index over vectors with product-quantised residuals.

k-means on a bounded sample gives lists; each vector is in the list of its nearest mean and is coded by what is left of it, a
byte for each slice of dimensions. A search looks through the lists nearest to a query by codes, and computes the exact
cosine of the best only. How many lists it takes to find the wanted share of true neighbours is measured on the
sample. Every vector is indexed; ``exact`` searches without the index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import cosine
from .retrieve import in_blocks, top_per_group
from .tables import materialise, on_workers

#: Vectors that lists and codes are fitted on, by least hash of their id; lists, code slices and codes of a slice at most.
SAMPLE, LISTS, SLICES, CODES = 20_000, 1024, 16, 256
#: Share of the true neighbours that a search should find, and codes for each neighbour whose vectors are compared exactly.
RECALL, AGAIN = 0.95, 10
#: Vectors and queries that one task compares.
CELL_ROWS, CELL_QUERIES = 50_000, 5_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; an empty mean moves to the row farthest from its own."""
    means = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        far = (x**2).sum(1)[:, None] - 2 * x @ means.T + (means**2).sum(1)[None]
        own, least = far.argmin(1), far.min(1)
        sums = np.zeros_like(means)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        means[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        means[empty] = x[np.argsort(-least, kind="stable")[: len(empty)]]
    return means


@dataclass
class Quantiser:
    means: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # of each slice: codes x its dimensions
    cuts: list[int]
    probes: int = 1

    def lists(self, x: np.ndarray) -> np.ndarray:
        return ((self.means**2).sum(1)[None] - 2 * x @ self.means.T).argmin(1)

    def codes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        left = x - self.means[own]
        return np.stack([((b**2).sum(1)[None] - 2 * left[:, lo:hi] @ b.T).argmin(1).astype(np.uint8) for b, lo, hi in zip(self.books, self.cuts, self.cuts[1:], strict=False)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query's slices with every code: queries x slices x codes."""
        return np.stack([np.pad(q[:, lo:hi] @ b.T, ((0, 0), (0, CODES - len(b)))) for b, lo, hi in zip(self.books, self.cuts, self.cuts[1:], strict=False)], axis=1)

    def products(self, q: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Products of queries and coded vectors of the lists ``own``, nearly."""
        table, out = self.tables(q), (q @ self.means.T)[:, own]
        for k in range(codes.shape[1]):
            out += table[:, k, codes[:, k]]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows that are zero or not finite become NaN."""
    with np.errstate(all="ignore"):
        out = x / np.sqrt((x**2).sum(1))[:, None]
    out[~np.isfinite(out).all(1)] = np.nan
    return out


def _matrix(column: pa.Array | pd.Series, size: int) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    out = np.full((len(rows), size), np.nan)
    for k, r in enumerate(rows):
        if r is not None and len(r) == size:
            out[k] = np.array(r, dtype=float)
    return unit(out)


def fit(sample: np.ndarray, n: int, recall: float = RECALL, k: int = 10) -> Quantiser:
    """Lists and codes from a sample of unit rows of a table of ``n``, with the probes that find ``recall`` of a part of the sample's neighbours."""
    size = sample.shape[1]
    means = kmeans(sample, max(1, min(LISTS, round(n**0.5), len(sample) // 4)))
    cuts = np.linspace(0, size, min(SLICES, size) + 1).astype(int).tolist()
    model = Quantiser(means, [], cuts)
    own = model.lists(sample)
    left = sample - means[own]
    model.books = [kmeans(left[:, lo:hi], min(CODES, len(sample))) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    asked = sample[:: max(1, len(sample) // 300)]
    near = asked @ sample.T
    k = min(k + 1, len(sample))
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ means.T), axis=1), axis=1)  # of each list for each query
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel()) + 1
    model.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    return model


def build(rows: DataFrame, path: str, recall: float = RECALL, sample: int = SAMPLE) -> VectorIndex:
    """Write the index of ``rows(id, embedding)``; ids are longs, vectors have the length of the first in the sample.

    Null and zero vectors, those with a null or non-finite component and those of another length aren't in the index, as
    they have no cosine. A list as large as a third of the table is split among tasks like the others.
    """
    spark = rows.sparkSession
    on_workers(spark)
    plain = rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    n = plain.count()
    picked = [r[0] for r in plain.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()]
    size = len(picked[0]) if picked else 0
    known = _matrix(pa.array(picked, pa.list_(pa.float64())), size) if size else np.zeros((0, 0))
    known = known[~np.isnan(known).any(1)]
    model = fit(known, n, recall) if len(known) else None

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), size)
            good = ~np.isnan(x).any(1)
            own = model.lists(x[good])
            codes = model.codes(x[good], own)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column(0).filter(pa.array(good)), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "id", "code"])

    schema = "list int, id long, code binary"
    coded = plain.mapInArrow(code, schema) if model else spark.createDataFrame([], schema)
    coded.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.parquet(f"{path}/codes")
    if model:
        stored = {"means": model.means.tolist(), "books": [b.tolist() for b in model.books], "cuts": model.cuts, "probes": model.probes}
        spark.createDataFrame([(json.dumps(stored),)], "model string").coalesce(1).write.parquet(f"{path}/model")
    else:
        spark.createDataFrame([], "model string").write.parquet(f"{path}/model")
    return VectorIndex(spark, path)


class VectorIndex:
    """An index that ``build`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        on_workers(spark)
        stored = spark.read.parquet(f"{path}/model").collect()
        self.model = None
        if stored:
            m = json.loads(stored[0][0])
            self.model = Quantiser(np.array(m["means"]), [np.array(b) for b in m["books"]], m["cuts"], m["probes"])

    def candidates(self, queries: DataFrame, k: int, probes: int | None = None, again: int = AGAIN) -> DataFrame:
        """(query_id, id) of the ``again * k`` nearest by code in the ``probes`` nearest lists of ``queries(query_id, embedding)``."""
        model, most = self.model, again * k
        probes = min(probes or model.probes, len(model.means))
        size = model.cuts[-1]

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = _matrix(b.column(1), size)
                good = np.flatnonzero(~np.isnan(q).any(1))
                near = np.argsort(-(q[good] @ model.means.T), axis=1, kind="stable")[:, :probes]
                at = np.repeat(good, probes)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["list", "query_id", "embedding"])

        plain = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        asked = materialise(plain.where("embedding is not null").mapInArrow(probe, "list int, query_id long, embedding array<double>"))
        codes = self.spark.read.parquet(f"{self.path}/codes")
        # at most LISTS rows of counts each; a crowded list's vectors and queries are dealt to a grid of tasks
        rows = {r["list"]: -(-r["count"] // CELL_ROWS) for r in codes.groupBy("list").count().collect()}
        asks = {r["list"]: -(-r["count"] // CELL_QUERIES) for r in asked.groupBy("list").count().collect()}
        grid = self.spark.createDataFrame([(x, rows[x], asks[x]) for x in rows.keys() & asks.keys()], "list int, parts long, shares long")
        part, share = F.pmod(F.xxhash64("id"), "parts"), F.pmod(F.xxhash64("query_id"), "shares")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = codes.join(F.broadcast(grid), "list").withColumn("part", part).withColumn("share", every("shares")).select("list", "part", "share", "id", "code")
        right = asked.join(F.broadcast(grid), "list").withColumn("share", share).withColumn("part", every("parts")).select("list", "part", "share", "query_id", "embedding")

        def compare(key: tuple, there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(there) and len(here):
                code = np.stack([np.frombuffer(c, np.uint8) for c in there["code"]])
                ids, own = there["id"].to_numpy(), np.full(len(there), key[0])
                for lo in range(0, len(here), 64):
                    some = here.iloc[lo : lo + 64]
                    score = model.products(_matrix(some["embedding"], size), own, code)
                    best = np.argpartition(-score, min(most, len(ids)) - 1, axis=1)[:, :most]
                    out.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), best.shape[1]), "id": ids[best.ravel()], "near": np.take_along_axis(score, best, axis=1).ravel()}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "near": np.zeros(0)})

        cell = ["list", "part", "share"]
        found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(compare, "query_id long, id long, near double")
        return top_per_group(found, "query_id", most, F.desc("near"), F.asc("id")).select("query_id", "id")

    def search(self, queries: DataFrame, rows: DataFrame, k: int, probes: int | None = None, again: int = AGAIN) -> DataFrame:
        """The ``k`` nearest of ``rows(id, embedding)``, the indexed table, by exact cosine: query_id, id, score, rank; a query isn't its own neighbour."""
        if self.model is None:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        pairs = materialise(self.candidates(queries, k + 1, probes, again).where("id != query_id"))
        both = pairs.join(rows.select("id", "embedding"), "id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
        scored = both.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
        return top_per_group(scored, "query_id", k, F.desc("score"), F.asc("id"))


def exact(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The same by comparing every query with every row, in blocks."""
    both = in_blocks(queries.select("query_id", F.col("embedding").alias("q")), rows.select("id", "embedding"), "query_id", "id").where("id != query_id")
    scored = both.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")).where("score is not null and not isnan(score)")
    return top_per_group(scored, "query_id", k, F.desc("score"), F.asc("id"))


def recall(found: DataFrame, true: DataFrame) -> float | None:
    """Share of the rows ``(query_id, id)`` of ``true`` that ``found`` has; None without any."""
    hit = true.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    n, hits = hit.agg(F.count("*"), F.count("hit")).first()
    return hits / n if n else None
