"""Near copies by the Jaccard similarity of five-word shingle sets.

1. SimHash fingerprints of the shingles within the pigeonhole's radius name candidates. At a similarity
   of 0.8 fingerprints differ in about ten bits, more than can be probed, so bands of minima of the
   hashed shingles name the others; rows that share a band are joined, and the components of all
   these links are the only places where links can be.
2. A component of several tiles may be texts that share no more than a passage, so it is formed anew by a prefix filter:
   rows of similarity 0.8 share one of the fifth of their shingles that comes first in any order, and with
   rare shingles first a common passage comes last. Texts that only share it then have nothing in common.
3. A component goes to cells of bounded size. One of several tiles is dealt to them at random first, twice;
   rows that turn out linked are a class, and classes that fill several tiles need no comparison within.
   Then cells hold each two of a component's other rows together at least once.
4. A cell intersects the whole shingle sets of its rows and returns a spanning forest of the pairs
   whose similarity reaches the threshold, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import forest, runs, starts
from .components import BROADCAST_ROWS, components
from .scratch import Scratch, sized
from .simhash import LOWER, candidates

WORDS, SEED = 5, 42
#: A pair is linked if ``OF * common >= LEAST * all``.
LEAST, OF = 4, 5
#: A pair of similarity s shares no band with probability ``(1 - s**ROWS) ** BANDS``: 7e-6 at 0.8.
BANDS, ROWS = 30, 5
#: Rows of a tile and, of groups of long texts, its characters; a cell holds two tiles.
TILE, TILE_CHARS = 384, 2 << 20
#: Band values that one task groups.
GROUP_ROWS = 500_000
#: Bits of a shingle that name its slot in the table of how common shingles are (a byte a slot, 1 MB). Any table keeps
#: all links; a good one keeps candidates few.
SLOTS = 20
_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted XXH64 of the distinct word shingles; a text of at most five words is one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    flat = b" ".join(found)
    if len(found) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = [0, *(ends[:-WORDS] + 1).tolist()]
    spans = zip(begins, ends[WORDS - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxhash.xxh64_intdigest(flat[i:j], SEED) for i, j in spans], dtype=np.uint64))


def band_values(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(_MUL), np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 256):
        np.minimum(low, (shingles[k : k + 256, None] * _MUL + _ADD).min(0), out=low)
    rows = low.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], dtype=np.uint64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            vals = np.concatenate([band_values(shingle_set(t)) for t in b.column(1).to_pylist()])
            keys = np.repeat(b.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(vals.view(np.int64))], ["key", "val"])


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles one of which any set of similarity ``LEAST / OF`` shares: the first by how common their slots are."""
    n = len(shingles) - -(-LEAST * len(shingles) // OF) + 1
    order = np.argsort(common[(shingles >> np.uint64(64 - SLOTS)).astype(np.int64)], kind="stable")  # ties by hash
    return shingles[order[:n]]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            found = np.concatenate([shingle_set(t) for t in b.column(1).to_pylist()])
            slot, n = np.unique((found >> np.uint64(64 - SLOTS)).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], ["slot", "n"])


def _prefixes(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = [prefix(shingle_set(t), common.value) for t in b.column(1).to_pylist()]
                keys = np.repeat(b.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(found).view(np.int64))], ["key", "val"])

    return run


def sharing(values: DataFrame, scratch: Scratch, tasks: int) -> DataFrame:
    """``values(key, val)`` -> links (a, b) of each row with the first that has the same value."""
    shared = scratch.write(values.repartition(tasks, "val").groupBy("val").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("val", "first"))
    return values.join(small(shared), "val").select(F.col("key").alias("a"), F.col("first").alias("b"))


def refined(rows: DataFrame, held: DataFrame, scratch: Scratch, tile: int, width: int) -> DataFrame:
    """``held(key, root, chars)`` with its components of several tiles formed anew by the prefix filter; rows left alone go."""
    sizes = scratch.write(held.groupBy("root").agg(_tiles(tile, F.lit(True)).alias("tiles")).where("tiles > 1").select("root"))
    if sizes.isEmpty():
        return held
    crowded = scratch.write(held.join(small(sizes), "root", "left_semi"))
    texts = rows.join(small(crowded.select("key")), "key", "left_semi")
    slots = texts.mapInArrow(_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    common = np.zeros(1 << SLOTS, np.uint8)
    for r in slots.select("slot", F.floor(F.log2("n")).cast("int").alias("n")).toLocalIterator():
        common[r["slot"]] = r["n"] + 1
    values = scratch.write(texts.mapInArrow(_prefixes(rows.sparkSession.sparkContext.broadcast(common)), "key long, val long"))
    anew = _with_roots(components(sharing(values, scratch, max(width, values.count() // GROUP_ROWS)), scratch), scratch)
    scratch.drop(values)
    again = crowded.drop("root").join(small(anew), "key").select(*held.columns)
    return scratch.write(held.join(small(sizes), "root", "left_anti").unionByName(again))


def linked_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that reach the threshold."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    who = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    who, column = who[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        has = np.zeros((len(sets), 2048), dtype=np.float32)
        has[who[lo:hi], column[lo:hi] - at] = 1
        rows = np.unique(who[lo:hi])
        common[np.ix_(rows, rows)] += has[rows] @ has[rows].T
    common = common.astype(np.int64)
    near = OF * common >= LEAST * (sizes[:, None] + sizes - common)
    return np.nonzero(np.triu(near, 1))


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, "cell"):
        bounds = starts(table["cell"].to_numpy())
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            keys = table["key"].to_numpy()[lo:hi]
            label = forest(len(keys), *linked_pairs([shingle_set(t) for t in table["text"].slice(lo, hi - lo).to_pylist()]))
            at = np.flatnonzero(label != np.arange(len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(keys[label[at]])], ["a", "b"])


def near_components(rows: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """``rows(key, text)`` with distinct keys -> ``(key, root)`` of each row that is linked to another.

    ``root`` is the least key that links of similarity 0.8 or more reach. Null and blank texts are
    near copies of each other; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    sized(spark)
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = rows.select(F.col("key").cast("long"), F.col("text").cast("string"))
    bands = scratch.write(rows.mapInArrow(_bands, "key long, val long"))
    # almost all values differ, so they are dealt once, to tasks of bounded size, and not counted before
    banded = sharing(bands, scratch, max(width, bands.count() // GROUP_ROWS))
    stars = _with_roots(components(banded.unionByName(candidates(rows, scratch, WORDS)), scratch), scratch)
    scratch.drop(bands)
    held = rows.select("key", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).join(small(stars), "key")
    held = refined(rows, scratch.write(held), scratch, tile, width)
    sizes = small(scratch.write(held.groupBy("root").agg(_tiles(tile, F.lit(True)).alias("tiles"))))
    placed = held.join(sizes, "root")
    first = _cell_links(rows, _two_deals(placed.where("tiles > 1")), scratch)
    classes = _with_roots(components(first, scratch), scratch).withColumnRenamed("root", "class")
    rest = _cell_links(rows, _between_classes(held.join(small(classes), "key", "left"), scratch, tile), scratch)
    return _with_roots(components(first.unionByName(rest), scratch), scratch)


def _tiles(tile: int, of: Column) -> Column:
    """Tiles that hold a group's rows where ``of``, by their number and their characters."""
    n, chars = F.count(F.when(of, 1)), F.coalesce(F.sum(F.when(of, F.col("chars"))), F.lit(0))
    return F.greatest(F.ceil(n / tile), F.ceil(chars / TILE_CHARS))


def _two_deals(placed: DataFrame) -> DataFrame:
    """Each row of a group of several tiles to one of them under two hashes.

    Rows that meet in a tile and are copies become one class, and the second deal mixes the classes of
    the first, so a large group of real copies is nearly one class for two copies a row.
    """
    deal = [F.xxhash64(F.lit(s), "root", F.pmod(F.xxhash64("key", F.lit(s)), F.col("tiles"))) for s in (11, 12)]
    return placed.select("key", F.explode(F.array(*deal)).alias("cell"))


def _between_classes(held: DataFrame, scratch: Scratch, tile: int) -> DataFrame:
    """Cells that hold each two rows of a group, but for two of one class that fills several tiles.

    Such a class is connected already. It has tiles of its own behind those of the other rows, and its
    rows go to all but these; the other rows go to all tiles.
    """
    held = held.withColumn("class", F.coalesce("class", "key"))
    by_class = held.groupBy("root", "class").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), _tiles(tile, F.lit(True)).alias("own"))
    by_class = scratch.write(by_class)
    large = by_class.where("own > 1")
    behind = Window.partitionBy("root").orderBy("class")
    large = large.withColumn("begin", F.sum("own").over(behind) - F.col("own")).select("root", "class", "own", "begin")
    pooled = F.col("own") <= 1
    count = lambda what, by: F.ceil(F.coalesce(F.sum(F.when(pooled, F.col(what))), F.lit(0)) / by)
    groups = by_class.groupBy("root").agg(
        F.greatest(count("n", tile), count("chars", TILE_CHARS)).alias("pool"),
        F.coalesce(F.sum(F.when(~pooled, F.col("own"))), F.lit(0)).alias("behind"),
    )
    at = held.join(small(scratch.write(groups)), "root").join(small(scratch.write(large)), ["root", "class"], "left")
    begin, end, last = F.col("pool") + F.col("begin"), F.col("pool") + F.col("begin") + F.col("own"), F.col("pool") + F.col("behind") - 1
    to = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    others = F.when(F.col("own").isNull(), to(F.lit(0).cast("long"), last)).otherwise(F.concat(to(F.lit(0).cast("long"), begin - 1), to(end, last)))
    mine = F.pmod(F.xxhash64("key", F.lit(7)), F.coalesce("own", "pool")) + F.when(F.col("own").isNull(), 0).otherwise(begin)
    return (
        at.select("key", "root", mine.alias("mine"), F.explode(others).alias("other"))
        .select("key", F.xxhash64(F.lit(13), "root", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    )


def _cell_links(rows: DataFrame, dealt: DataFrame, scratch: Scratch) -> DataFrame:
    """Spanning forests of the links within each cell of ``dealt(key, cell)``."""
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cells = rows.join(small(scratch.write(dealt)), "key").select("cell", "key", "text")
    return scratch.write(cells.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(_link, "a long, b long"))


def small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _with_roots(stars: DataFrame, scratch: Scratch) -> DataFrame:
    roots = stars.select(F.col("root").alias("key"), "root").distinct()
    return scratch.write(stars.select(F.col("node").alias("key"), "root").unionByName(roots))
