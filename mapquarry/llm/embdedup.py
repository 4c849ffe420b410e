"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors are folded first. The distinct ones are rotated onto the principal axes of all
vectors, strongest first, and cut into tiles along the first axis. Two tiles are compared in one
cell: the leading coordinates' products plus the product of the suffix norms bound every cosine,
so most pairs stop after a quarter of the dimensions; survivors accumulate more coordinates
and the rest are computed in full, in double precision, from the original vectors. A cell returns
link counts and a spanning forest of its links, never its pairs.

Each row is copied to as many cells as there are tiles within reach. Up to TILE_MOST times the
square root of six times the shuffle partitions that number is set by the partitions alone; beyond
it tiles stay at TILE_MOST rows, so copies grow with the table unless the first axis tells
tiles apart: every copy then still pays for TILE_MOST comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import forest, runs
from .components import components
from .scratch import Scratch, sized

COSINE = 0.95
#: Limits of a tile's vectors; a cell task holds two tiles.
TILE_LEAST, TILE_MOST = 256, 32768
#: Strips along the first axis, at most; the driver holds one bound and one count of each.
STRIPS = 1024
#: Rows of one side of a cell that are multiplied at once.
ROWS = 1024


def usable(v: Column) -> Column:
    """True for a vector with finite components that aren't all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0.0
    for b in batches:
        if b.num_rows:
            x = unit(matrix(b.column(0)))
            total = total + x.T @ x
    if not isinstance(total, float):
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])


def axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns: principal axes of the unit vectors, strongest first. d(d+1)/2 sums reach the driver."""
    got = vectors.select("v").mapInArrow(_moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s")).collect()
    second = np.zeros((dim, dim))
    for i, j, s in got:
        second[i, j] = second[j, i] = s
    values, basis = np.linalg.eigh(second)
    return np.ascontiguousarray(basis[:, np.argsort(-values, kind="stable")])


def first_axis(basis: np.ndarray):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = unit(matrix(b.column("v"))) @ basis[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), b.column("v"), pa.array(y)], ["id", "n", "v", "y"])

    return project


def reach(low: np.ndarray, high: np.ndarray, cosine: float) -> list[tuple[int, int]]:
    """Strips whose first coordinates come within the chord of ``cosine`` of each strip's."""
    chord = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    return [(int(np.searchsorted(high, a - chord, "left")), int(np.searchsorted(low, b + chord, "right"))) for a, b in zip(low, high, strict=True)]


def stages(dim: int) -> list[int]:
    return sorted({max(1, dim // 4), max(1, dim // 2), dim})


def compare(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, cosine: float, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= ``cosine``. ``x, y``: rotated unit rows; ``ux, uy``: exact unit rows."""
    dims, slack = stages(x.shape[1]), 1e-5
    tail = lambda z, k: np.sqrt(np.maximum(0, (z[:, k:] ** 2).sum(1)))
    lead = dims[0]
    a = np.concatenate([x[:, :lead], tail(x, lead)[:, None]], axis=1).astype(np.float32)
    b = np.concatenate([y[:, :lead], tail(y, lead)[:, None]], axis=1).astype(np.float32)
    tails = {k: (tail(x, k), tail(y, k)) for k in dims[1:-1]}
    for lo in range(0, len(x), ROWS):
        for ro in range(lo if upper else 0, len(y), ROWS):
            i, j = np.nonzero(a[lo : lo + ROWS] @ b[ro : ro + ROWS].T >= cosine - slack)
            i, j = i + lo, j + ro
            if upper:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                for k in dims[1:-1]:
                    bound = np.einsum("ij,ij->i", x[p, :k], y[q, :k]) + tails[k][0][p] * tails[k][1][q]
                    p, q = p[bound >= cosine - slack], q[bound >= cosine - slack]
                real = np.einsum("ij,ij->i", ux[p], uy[q]) >= cosine
                if real.any():
                    yield p[real], q[real]


def cells(basis: np.ndarray, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "cell"):
            keys = table["cell"].to_numpy()
            bounds = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                t = table.slice(lo, hi - lo)
                ids, weight, left = t["id"].to_numpy(), t["n"].to_numpy(), t["left"].to_numpy().astype(bool)
                exact = unit(matrix(t["v"]))
                same = bool((keys[lo:hi] == t["own"].to_numpy()).all())
                order = np.argsort(~left, kind="stable")
                ids, weight, exact, n = ids[order], weight[order], exact[order], int(left.sum())
                rotated = exact @ basis
                first = slice(0, None) if same else slice(0, n)
                second, shift = (slice(0, None), 0) if same else (slice(n, None), n)
                links, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
                for p, q in compare(rotated[first], rotated[second], exact[first], exact[second], cosine, same):
                    q = q + shift
                    links += np.bincount(p, weight[q], len(ids)).astype(np.int64) + np.bincount(q, weight[p], len(ids)).astype(np.int64)
                    a, b = label[p], label[q]
                    new = a != b
                    if new.any():
                        label = forest(len(ids), a[new], b[new])[label]
                some = np.flatnonzero(links)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(links[some])], ["id", "to", "links"]
                    )

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tile: int | None = None) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept.

    Links join vectors of one length whose cosine in double precision is at least ``cosine``.
    Null, empty or zero vectors, those with null or non-finite components and rows with a null
    vec_id link with nothing (component_id is the own vec_id). Different vectors with one
    vec_id share a component and the sum of their links. Other columns are ignored; an empty table gives
    none.
    """
    spark = vectors.sparkSession
    sized(spark)
    scratch = Scratch(spark, "embeddings")
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    good = F.col("vec_id").isNotNull() & usable(F.col("v"))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    folded = scratch.write(rows.where(good).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    found = None
    for (dim,) in sorted(folded.select(F.size("v")).distinct().collect()):
        part = _found(folded.where(F.size("v") == dim), dim, cosine, tile, scratch)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    found = scratch.write(found)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), scratch)
    stars = stars.select(F.col("node").alias("id"), "root")
    known = scratch.write(
        folded.join(counts, "id", "left").join(stars, "id", "left")
        .select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    )
    linked = rows.where(good).join(known, "v").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _found(folded: DataFrame, dim: int, cosine: float, tile: int | None, scratch: Scratch) -> DataFrame:
    spark = folded.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    basis = axes(folded, dim)
    kind = folded.schema["v"].dataType.simpleString()
    placed = scratch.write(folded.mapInArrow(first_axis(basis), f"id long, n long, v {kind}, y double"))
    total = placed.count()
    tile = tile or int(min(TILE_MOST, max(TILE_LEAST, total / math.sqrt(6 * width))))
    strips = int(min(STRIPS, max(1, total // tile)))
    quantiles = placed.select(F.percentile_approx("y", [k / strips for k in range(1, strips)] or [0.5], 20_000)).first()[0] or [0.0]
    edges = sorted(set(quantiles)) if strips > 1 else []
    strip = sum((F.when(F.col("y") > e, 1).otherwise(0) for e in edges), F.lit(0)) if len(edges) < 64 else None
    if strip is None:  # position by one binary search in a sorted literal instead of a long sum
        strip = F.size(F.filter(F.lit(edges), lambda e: e < F.col("y")))
    cut = placed.withColumn("strip", strip.cast("int"))
    stats = {r[0]: r[1:] for r in cut.groupBy("strip").agg(F.count("*"), F.min("y"), F.max("y")).collect()}
    order = sorted(stats)
    low, high = np.array([stats[s][1] for s in order]), np.array([stats[s][2] for s in order])
    tiles = [max(1, -(-stats[s][0] // tile)) for s in order]
    offset = np.concatenate([[0], np.cumsum(tiles)]).tolist()
    near = reach(low, high, cosine)
    row = lambda k: F.struct(F.lit(offset[k]).alias("base"), F.lit(tiles[k]).alias("tiles"), F.lit(offset[near[k][0]]).alias("from"), F.lit(offset[near[k][1]]).alias("to"))
    plan = F.create_map(*[x for k, s in enumerate(order) for x in (F.lit(s), row(k))])
    dealt = (
        cut.withColumn("p", plan[F.col("strip")])
        .withColumn("own_tile", F.col("p.base") + F.pmod(F.xxhash64("id"), F.col("p.tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.col("p.from"), F.col("p.to") - 1)))
        .select(
            F.xxhash64(F.least("own_tile", "other"), F.greatest("own_tile", "other")).alias("cell"),
            F.xxhash64("own_tile", "own_tile").alias("own"), (F.col("own_tile") <= F.col("other")).alias("left"), "id", "n", "v",
        )
    )
    return dealt.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(cells(basis, cosine), "id long, to long, links long")
