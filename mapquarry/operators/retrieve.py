"""Hard filters, expansion of selected entities, weighted contributions, ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, similarity, times
from .tables import free, materialise, on_workers

#: Entities of a dimension that are scored, in order of their score; the union filter uses all.
SCORED = {"Topic": 100, "Keyword": 100, "Format": 50, "License": 50, "Organization": 50}
#: A side is broadcast only when the caller states that it is a selection of this size at most.
SELECTION = 5000


def selection(candidates: DataFrame, n: int, order: Sequence[Column] | None = None) -> DataFrame:
    """The best ``n`` rows of a candidate list: a bounded table that may be broadcast."""
    assert n <= SELECTION
    return F.broadcast(candidates.orderBy(*(order or (F.desc("score"), F.asc("id")))).limit(n))


def hard_filter(space: DataFrame, time: DataFrame, box: geo.Box | None, span: tuple[str, str] | None) -> DataFrame | None:
    """Datasets that overlap the box and the span; with both, one that lacks either is out. None: no filter."""
    sides = []
    if box:
        sides.append(space.where(geo.overlaps(*(F.col(c) for c in ("west", "south", "east", "north")), box)).select("dataset_id"))
    if span:
        sides.append(time.where(times.overlaps(F.col("begin"), F.col("end"), *span)).select("dataset_id"))
    return reduce(lambda a, b: a.join(b, "dataset_id", "left_semi"), sides).distinct() if sides else None


def source_filter(provides: DataFrame, sources: Sequence[str]) -> DataFrame:
    return provides.where(F.col("entity_id").isin(*sources)).select("dataset_id").distinct()


#: Source ids of the catalogs that a request may switch on.
PORTALS = {
    "datagov": "data.gov", "pasda": "pasda", "stacGoogle": "3886fcaf359f302ca7255a9b71b265b33662f88b", "stacDedl": "7148d4a5544f0896e63775cc95908897fa0e8a36",
    "stacMicrosoft": "32c3d214ac192b3316cef7a5996e3cba84989ffd", "stacPaituli": "c923746393499b170b2172f45ffe2f8037be3a9e",
}


def portal_sources(portals: dict[str, bool] | None, ids: dict[str, str] = PORTALS) -> list[str] | None:
    """Source ids of the switched-on portals; None when all are on or none is named (no filter). All off is an error."""
    if not portals:
        return None
    if not any(portals.values()):
        raise ValueError("select at least one catalog")
    if all(portals.get(k, False) for k in ids):
        return None
    return [ids[k] for k, on in portals.items() if on and k in ids]


def text_hits(dataset: DataFrame, text: str, limit: int = 150, has_keyword: DataFrame | None = None) -> DataFrame:
    """(dataset_id) whose title, notes or, if given, a keyword holds the text; ``limit`` at most, least ids first."""
    q = text.lower()
    holds = F.coalesce(F.lower("title").contains(q), F.lit(False)) | F.coalesce(F.lower("notes").contains(q), F.lit(False))
    found = dataset.where(holds).select(F.col("id").alias("dataset_id"))
    if has_keyword is not None:
        found = found.unionByName(has_keyword.where(F.lower("entity_id").contains(q)).select("dataset_id")).distinct()
    return found.orderBy("dataset_id").limit(limit)


#: The property that a text search looks into, by kind of node; the first that a table has.
SEARCHED = {
    "Topic": ("name",), "Keyword": ("name",), "Format": ("name",), "Source": ("title", "name"), "Organization": ("title", "name"), "License": ("title", "name"),
    "Dataset": ("title", "notes"),
}


def searched(nodes: DataFrame, label: str) -> Column:
    return F.coalesce(*[F.col(c) for c in SEARCHED[label] if c in nodes.columns])


def vector_candidates(nodes: DataFrame, probe: Sequence[float], k: int, threshold: float, mode: str = "index") -> DataFrame:
    """The ``k`` nodes ``(id, embedding)`` nearest to ``probe`` whose score exceeds the threshold; null embeddings are skipped.

    ``mode`` index scores (1 + cosine) / 2, exact scores the cosine itself: thresholds differ.
    """
    close = similarity.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in probe]))
    score = F.round((1 + close) / 2 if mode == "index" else close, 6)
    return nodes.where("embedding is not null").select("id", score.alias("score")).where(F.col("score") > threshold).orderBy(F.desc("score"), "id").limit(k)


def confident(score: Column, threshold: float) -> Column:
    """``proceed`` from the threshold on, else ``ask``; nothing known asks."""
    return F.when(F.coalesce(score >= threshold, F.lit(False)), "proceed").otherwise("ask")


def in_blocks(asked: DataFrame, rows: DataFrame, asked_key: str, row_key: str, most: int = SELECTION) -> DataFrame:
    """Every row beside every row of ``asked``, a stated set of queries, in blocks of at most about ``most`` queries.

    A set of at most ``most`` (counted here) is broadcast. Else rows go to each block and are dealt by
    their own hash within it, so that no task gets a whole block's rows.
    """
    n = asked.count()
    block, share = free("_block", asked, rows), free("_share", asked, rows)
    if n <= most:
        zero = F.explode(F.sequence(F.lit(0), F.lit(0)))
        return rows.withColumn(block, zero).join(F.broadcast(asked.withColumn(block, F.lit(0))), block).drop(block)
    blocks, shares = -(-n // most), max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    upto = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = asked.withColumn(block, F.pmod(F.xxhash64(asked_key), F.lit(blocks))).withColumn(share, upto(shares))
    right = rows.withColumn(share, F.pmod(F.xxhash64(row_key), F.lit(shares))).withColumn(block, upto(blocks))
    return right.join(left, [block, share]).drop(block, share)


#: Vectors of one share, queries that a task scores at a time.
SHARE, CHUNK = 8192, 64


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero, as the column function rounds."""
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6


def best_of_row(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores; of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    last = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > last)
    return np.concatenate([over, np.flatnonzero(scores == last)[: k - len(over)]])


def _vectors(lists: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places and vectors of the rows that are neither null nor hold null."""
    every = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    lengths = pc.fill_null(pc.list_value_length(every), 0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == n)
        flat = every.take(pa.array(places)).flatten()
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, n).any(axis=1)
        out[n] = places[whole], flat.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, n)[whole]
    return out


def _reach(scores: np.ndarray, k: int) -> np.ndarray:
    """A bound of each row that its ``k`` greatest scores reach: of the maxima of more than ``k`` runs the k-th."""
    runs = max(64, 4 * k)
    if scores.shape[1] < 4 * runs:
        return np.full(len(scores), -np.inf)
    width = scores.shape[1] // runs
    most = scores[:, : runs * width].reshape(len(scores), runs, width).max(axis=2)
    return np.partition(most, runs - k, axis=1)[:, runs - k]


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def nearest(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending")])
        probes, vectors = _vectors(asked["q"]), _vectors(rows["embedding"])
        asks, ids = asked["query_id"].to_numpy(), rows["vec_id"].to_numpy()
        found: list[list[np.ndarray]] = [[], [], []]
        with np.errstate(all="ignore"):
            pairs = []
            for n in probes.keys() & vectors.keys():
                (at_p, p), (at_v, v) = probes[n], vectors[n]
                of_p, of_v = np.sqrt((p * p).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
                pairs.append((at_p, p, of_p, p / of_p[:, None], at_v, v, of_v, (v / of_v[:, None]).T))
            for lo in range(0, len(asks), CHUNK):
                # unknown scores come last, those that aren't numbers first, as Spark sorts them
                near = np.full((min(CHUNK, len(asks) - lo), len(ids)), -np.inf)
                for at_p, p, of_p, unit_p, at_v, v, of_v, unit_v in pairs:
                    a, b = np.searchsorted(at_p, [lo, lo + CHUNK])
                    cos = unit_p[a:b] @ unit_v
                    if not (np.isfinite(of_p).all() and np.isfinite(of_v).all() and (of_p > 0).all() and (of_v > 0).all()):
                        norm = of_p[a:b, None] * of_v
                        cos = np.where(np.isnan(norm) | (norm > 0), np.where(np.isnan(cos), np.inf, cos), -np.inf)
                    if cos.shape == near.shape:
                        near = cos
                    else:
                        near[np.ix_(at_p[a:b] - lo, at_v)] = cos
                # whatever could be among the first by its rounded score, one more for the query itself
                q, c = np.nonzero(near >= (_reach(near, k + 1) - 2e-6)[:, None])
                score = near[q, c]
                for at_p, p, of_p, _, at_v, v, of_v, _ in pairs:
                    i, j = np.searchsorted(at_p, q + lo), np.searchsorted(at_v, c)
                    here = np.isfinite(score) & (at_p[np.minimum(i, len(at_p) - 1)] == q + lo) & (at_v[np.minimum(j, len(at_v) - 1)] == c)
                    i, j = i[here], j[here]
                    score[here] = rounded((p[i] * v[j]).sum(axis=1) / (of_p[i] * of_v[j]))
                kept = ids[c] != asks[q + lo]
                q, c, score = q[kept], c[kept], score[kept]
                order = np.lexsort((c, -score, q))
                q, c, score = q[order], c[order], score[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                for out, part in zip(found, (q[first] + lo, c[first], score[first]), strict=True):
                    out.append(part)
        q, v, s = (np.concatenate(x) if x else np.array([], "int64") for x in found)
        s = s.astype("float64")
        score = pa.array(np.where(s == np.inf, np.nan, s), pa.float64(), mask=s == -np.inf)
        return pa.table({"query_id": asked["query_id"].take(pa.array(q.astype("int64"))), "vec_id": rows["vec_id"].take(pa.array(v.astype("int64"))), "score": score})

    return nearest


def nearest(asked: DataFrame, rows: DataFrame, k: int, share: int = SHARE, most: int = SELECTION) -> DataFrame:
    """``asked(query_id, q)`` -> the ``k`` of ``rows(vec_id, embedding)`` with the greatest cosine, itself left out: query_id, vec_id, score, rank.

    Exact, in double precision: every pair is scored as ``similarity.cosine`` would, equal scores go by id. Blocks of queries meet
    shares of the rows; a task multiplies two matrices and keeps the ``k`` best of each query, so pairs are never rows.
    """
    on_workers(rows.sparkSession)
    blocks, shares = max(1, -(-asked.count() // most)), max(1, -(-rows.count() // share))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), upto(shares).alias("share"))
    right = rows.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(shares)).alias("share"), upto(blocks).alias("block"))
    out = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, score double"
    pairs = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(_nearest(k), out)
    return top_per_group(pairs, "query_id", k, F.desc("score"), F.asc("vec_id"))


def expand(edges: DataFrame, chosen: DataFrame, hard: DataFrame | None = None) -> DataFrame:
    """Datasets linked to chosen entities, within the hard set: (dataset_id, entity_id, other columns of ``chosen``)."""
    out = edges.join(chosen.withColumnRenamed("id", "entity_id"), "entity_id")
    return out.join(hard, "dataset_id", "left_semi") if hard is not None else out


def expand_formats(has_resource: DataFrame, has_format: DataFrame, chosen: DataFrame, hard: DataFrame | None = None) -> DataFrame:
    """Two hops over resources, each dataset and format once."""
    formats = has_format.join(chosen.withColumnRenamed("id", "entity_id"), "entity_id")
    out = has_resource.join(formats, "resource_id").drop("resource_id").distinct()
    return out.join(hard, "dataset_id", "left_semi") if hard is not None else out


def contribution(links: DataFrame, dim: str, weight: float, missing: float = 0.5) -> DataFrame:
    """Best score of a dataset's entities in a dimension, times its weight; entities without a score count ``missing``."""
    best = F.max(F.coalesce("score", F.lit(missing)))
    return links.groupBy("dataset_id").agg((best * weight).alias("contribution")).select("dataset_id", F.lit(dim).alias("dim"), "contribution")


def total(parts: Sequence[DataFrame]) -> DataFrame:
    """Sum over dimensions, each contribution capped at 1, and the share of the best sum.

    The sums are written once; the best one is read from there.
    """
    rows = reduce(DataFrame.unionByName, parts)
    summed = materialise(rows.groupBy("dataset_id").agg(F.sum(F.least(F.lit(1.0), "contribution")).alias("total")))
    best = summed.agg(F.max("total").alias("best")).first()["best"]
    return summed.withColumn("score", F.col("total") / F.lit(best) if best else F.col("total"))


def raw_scores(contributions: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``raw``, the score before weighting: contribution over the dimension's weight, 1 at most."""
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("dim")]
    return contributions.withColumn("raw", F.least(F.lit(1.0), F.when(weight > 0, F.col("contribution") / weight).otherwise(0.0)))


def space_contribution(space: DataFrame, ids: DataFrame, box: geo.Box, weight: float) -> DataFrame:
    f1 = geo.box_f1(*(F.col(c) for c in ("west", "south", "east", "north")), box)
    return space.join(ids, "dataset_id", "left_semi").select("dataset_id", F.lit("Space").alias("dim"), (f1 * weight).alias("contribution")).where("contribution > 0")


def time_contribution(time: DataFrame, ids: DataFrame, span: tuple[str, str], weight: float) -> DataFrame:
    f1 = times.time_f1(F.col("begin"), F.col("end"), *span)
    return time.join(ids, "dataset_id", "left_semi").select("dataset_id", F.lit("Time").alias("dim"), (f1 * weight).alias("contribution")).where("contribution > 0")


def linked_to_any(*links: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.select("dataset_id") for x in links]).distinct()


def top_with_ties(rows: DataFrame, k: int, key: Column | None = None) -> DataFrame:
    """Rows whose score is at least the k-th best. The k-th score comes from a bounded sort, not a global window."""
    key = F.col("score") if key is None else key
    name = free("_key", rows)
    kept = rows.withColumn(name, key)
    last = kept.select(name).orderBy(F.desc(name)).limit(k).agg(F.min(name).alias("t")).first()["t"]
    return kept.where(F.col(name) >= F.lit(last)).drop(name) if last is not None else kept.drop(name)


def top_unique(rows: DataFrame, k: int) -> DataFrame:
    """Best row of each id, then the k best scores with ties."""
    return top_with_ties(rows.groupBy("id").agg(F.max("score").alias("score")), k)


def top_per_group(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """``k`` first rows of each group; Spark keeps k rows of a group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


#: Spaces of a grid cell that one task joins; a fuller cell is dealt to several.
CELL_ROWS = 50_000


def range_join(boxes: DataFrame, space: DataFrame, cell: float = 10.0, *keep: str) -> DataFrame:
    """Batch of query boxes ``(query_id, qw, qs, qe, qn)`` against all spaces by shared grid cells.

    Both sides are dealt to the cells they cover; a pair that shares several cells is kept in the
    one that holds the corner of its intersection, so no distinct is needed. Cells are counted first (a
    world of them, at most 703 at 10 degrees); the spaces of a crowded one are dealt to several tasks. Columns ``keep`` of
    the spaces stay beside the pair.
    """

    def cover(lo: str, hi: str, name: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))).alias(name)

    q = boxes.select("*", cover("qw", "qe", "cx")).select("*", cover("qs", "qn", "cy"))
    s = space.select("*", cover("west", "east", "cx")).select("*", cover("south", "north", "cy"))
    held = s.groupBy("cx", "cy").count().where(F.col("count") > CELL_ROWS).collect()
    parts = F.lit(1)
    if held:
        table = F.create_map(*[x for r in held for x in (F.lit(f"{r['cx']},{r['cy']}"), F.lit(-(-r["count"] // CELL_ROWS)))])
        parts = F.coalesce(F.try_element_at(table, F.concat_ws(",", "cx", "cy")), F.lit(1))
    s = s.withColumn("share", F.pmod(F.xxhash64("dataset_id"), parts))
    q = q.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    hit = (F.col("west") <= F.col("qe")) & (F.col("east") >= F.col("qw")) & (F.col("south") <= F.col("qn")) & (F.col("north") >= F.col("qs"))
    corner = (F.floor(F.greatest("west", "qw") / cell) == F.col("cx")) & (F.floor(F.greatest("south", "qs") / cell) == F.col("cy"))
    return q.join(s, ["cx", "cy", "share"]).where(hit & corner).select("query_id", "dataset_id", *keep)


def range_counts(boxes: DataFrame, space: DataFrame, cell: float = 10.0) -> DataFrame:
    """``range_join`` counted: (query_id, hits, sum_id) of each query box that meets a space.

    Like spaces are joined once with their number and the sum of their ids, and like query boxes once for all: the pairs are
    those of different boxes. Boxes that all differ are as many pairs as there are.
    """
    sides, asked = ["west", "south", "east", "north"], ["qw", "qs", "qe", "qn"]
    like = materialise(space.groupBy(*sides).agg(F.min("dataset_id").alias("dataset_id"), F.count("*").alias("n"), F.sum("dataset_id").alias("ids")))
    found = range_join(boxes.groupBy(*asked).agg(F.min("query_id").alias("query_id")), like, cell, "n", "ids")
    counts = found.groupBy("query_id").agg(F.sum("n").alias("hits"), F.sum("ids").alias("sum_id")).withColumnRenamed("query_id", "first")
    # a box's first query names its counts
    first = boxes.groupBy(*asked).agg(F.min("query_id").alias("first"))
    return boxes.join(first, asked).join(counts, "first").select("query_id", "hits", "sum_id")
