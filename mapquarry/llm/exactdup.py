"""Exact duplicates through an extendible-hash index on shared files.

1. Each scan task folds equal texts of a block of its rows into one *entry* (text, count, best
   row), so that a text held by a third of all rows leaves a task once, not once a row.
2. The entries, written to the shared folder, are counted by hash prefix, more bits of it only where a
   prefix is overfull. The directory starts with one slot and doubles while a bucket that uses all
   its bits is overfull.
3. A bucket is a range of hash keys with one owner task. The owner reads its entries in hash
   order, chains entries whose hashes are equal and decides equality by comparing bytes. Texts travel
   to owners only where a bitmap of repeated hashes has their bit; all others are alone in their chain.
4. Rows look up their entry's verdict by an entry number that at most one block of rows shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, sized

WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of distinct text that a scan task holds before it writes its entries.
BLOCK_BYTES = 16 << 20
#: Entries a bucket holds before it splits; beyond BUCKETS times as many entries buckets grow instead, so
#: that the driver's directory doesn't: an owner streams its entries, whatever their number.
CAPACITY, BUCKETS = 2048, 1 << 16
#: Bits that each count of overfull prefixes adds, and the most bits the directory may use.
STEP, MAX_DEPTH = 8, 24
#: Hashes that one task counts.
GROUP_ROWS = 500_000
#: Bits of a hash that address the bitmap of repeated hashes (8 MB). Where its bits run out, texts
#: travel that needn't; no result changes.
BITMAP = 26

_ENTRY = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("entry", T.LongType()),
    T.StructField("h", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("n", T.LongType()),
    T.StructField("best_len", T.LongType()), T.StructField("best_id", T.LongType()), T.StructField("best_row", T.LongType()),
    T.StructField("sha", T.BinaryType()),
])
_CLASS = T.StructType([
    T.StructField("entry", T.LongType()), T.StructField("keep_id", T.LongType()), T.StructField("keep_row", T.LongType()),
    T.StructField("group_size", T.LongType()), T.StructField("text_sha256", T.StringType()),
    T.StructField("bucket", T.IntegerType()),
])


def _rank(length: int, doc_id: int | None, row: int) -> tuple:
    """Greatest wins: most code points, then smallest doc_id (null last), then first row."""
    return (length, doc_id is not None, -(doc_id or 0), -row)


def entries_of(hash_bits: int):
    mask = (1 << 64) - (1 << (64 - hash_bits))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, row, entry = TaskContext.get().partitionId() << 33, 0, 0
        block: dict[bytes, list] = {}
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            first: dict[int, list] = {v[0]: [k, *v] for k, v in block.items()}
            cols: list[list] = [[] for _ in _ENTRY]
            for doc_id, at, e in rows:
                if known := first.pop(e, None):
                    body, _, n, best = known
                    h = xxhash.xxh64_intdigest(body, 42) & mask
                    tail = (h - (1 << 64) if h >> 63 else h, body, n, best[0], best[3], best[4], hashlib.sha256(body).digest())
                else:
                    tail = (None,) * 7
                for c, v in zip(cols, (doc_id, at, e, *tail), strict=True):
                    c.append(v)
            block.clear()
            rows.clear()
            kinds = [pa.binary() if f.name in ("body", "sha") else pa.int64() for f in _ENTRY]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _ENTRY.names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, row = text or "", row + 1
                body = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
                best = (*_rank(len(text), doc_id, base + row)[:3], doc_id, base + row)
                if (known := block.get(body)) is None:
                    entry += 1
                    block[body] = known = [base + entry, 0, best]
                    held += len(body)
                known[1] += 1
                if best[:3] > known[2][:3]:
                    known[2] = best
                rows.append((doc_id, base + row, known[0]))
            if held >= BLOCK_BYTES or len(rows) >= 200_000:
                yield flush()
                held = 0
        yield flush()

    return fold


class Directory:
    """Slots of the leading ``depth`` hash bits; a slot names a bucket, a bucket knows its local depth."""

    def __init__(self) -> None:
        self.depth, self.slots, self.local, self.prefix = 0, np.zeros(1, np.int32), [0], [0]

    def split(self, bucket: int) -> list[int]:
        """Halve ``bucket``'s key range; if it uses all of the directory's bits, double the directory first."""
        if self.local[bucket] == self.depth:
            self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
        depth, prefix, new = self.local[bucket] + 1, 2 * self.prefix[bucket], len(self.local)
        self.local[bucket], self.prefix[bucket] = depth, prefix
        self.local.append(depth)
        self.prefix.append(prefix + 1)
        width = 1 << (self.depth - depth)
        self.slots[(prefix + 1) * width : (prefix + 2) * width] = new
        return [bucket, new]


def directory(count: Callable[[int, list[int]], dict[int, int]], capacity: int, max_depth: int = MAX_DEPTH) -> Directory:
    """Splits overfull buckets until none is left or all of them use ``max_depth`` bits; their owners chain.

    ``count(bits, parents)`` tells the entries of each ``bits``-bit prefix below the overfull prefixes
    ``parents``, which have STEP bits less (at first all, below the empty prefix).
    """
    d, full, bits = Directory(), [0], 0
    while full and bits < max_depth:
        parents, bits = [d.prefix[b] for b in full], min(max_depth, bits + STEP)
        counts = count(bits, parents)
        # sums of all prefixes between the parents' bits and these
        sums = {bits: counts}
        for depth in range(bits - 1, -1, -1):
            sums[depth] = {}
            for p, n in sums[depth + 1].items():
                sums[depth][p >> 1] = sums[depth].get(p >> 1, 0) + n
        open_ = [b for b in full if sums[d.local[b]].get(d.prefix[b], 0) > capacity]
        full = []
        while open_:
            b = open_.pop()
            if d.local[b] == bits:
                full.append(b)
            else:
                open_ += [x for x in d.split(b) if sums[d.local[x]].get(d.prefix[x], 0) > capacity]
    return d


def route(slots: np.ndarray, depth: int, repeated: np.ndarray):
    """Adds each entry's bucket and keeps its body only where its hash may be another entry's too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            bucket = slots[(h >> np.uint64(64 - depth)).astype(np.int64)] if depth else np.zeros(len(h), np.int32)
            bit = (h >> np.uint64(64 - BITMAP)).astype(np.int64)
            shared = (repeated[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            body = pc.if_else(pa.array(shared.astype(bool)), b.column("body"), pa.scalar(None, pa.binary()))
            rest = [b.column(n) for n in ("entry", "h", "n", "best_len", "best_id", "best_row", "sha")]
            yield pa.RecordBatch.from_arrays([*rest, body, pa.array(bucket)], ["entry", "h", "n", "best_len", "best_id", "best_row", "sha", "body", "bucket"])

    return run


def bitmap(heads: DataFrame, tasks: int) -> np.ndarray:
    """Bits of the hashes that more than one entry has, counted by ``tasks`` tasks. At most ``2**BITMAP`` bits reach the driver."""
    bit = F.shiftrightunsigned("h", 64 - BITMAP) + 1
    found = (
        heads.select("h").repartition(tasks, "h").groupBy("h").count().where("count > 1").select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    )
    out = np.zeros(1 << (BITMAP - 3), np.uint8)
    for r in found:
        part = np.frombuffer(r["bits"], np.uint8)
        out[(r["at"] - 1) * len(part) : r["at"] * len(part)] = part
    return out


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in hash order -> their classes. Holds the chain of one hash key at a time.

    An entry without a body is the only one of its hash.
    """
    at, chain, done = None, {}, []

    def close() -> None:
        for members, n, best, bucket, sha in chain.values():
            done.extend((e, best[3], -best[4], n, sha.hex(), bucket) for e in members)
        chain.clear()

    def out() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[]] * 6
        done.clear()
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _CLASS.names)

    for batch in batches:
        for r in batch.to_pylist():
            if r["h"] != at:
                close()
                at = r["h"]
            known = chain.setdefault(r["body"], [[], 0, None, r["bucket"], r["sha"]])
            known[0].append(r["entry"])
            known[1] += r["n"]
            best = (r["best_len"], r["best_id"] is not None, -(r["best_id"] or 0), r["best_id"], -r["best_row"])
            key = lambda b: (*b[:3], b[4])
            if known[2] is None or key(best) > key(known[2]):
                known[2] = best
        if done:
            yield out()
    close()
    yield out()


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """Classes of texts that are equal without the white space ``[\\x20\\x09-\\x0D]``.

    Returns one row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept,
    text_sha256, bucket. Null texts count as empty and equal each other; of equal texts the one with
    the most code points stays, then the smallest doc_id (null ids last), then the first row read,
    so exactly one row of repeated rows is kept. Other columns are ignored; an empty table gives
    an empty result. ``hash_bits`` below 64 only serves tests of collisions.
    """
    spark: SparkSession = docs.sparkSession
    sized(spark)
    scratch = Scratch(spark, "exact")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entries = scratch.write(rows.mapInArrow(entries_of(hash_bits), _ENTRY))
    heads = entries.where("h is not null")

    def count(bits: int, parents: list[int]) -> dict[int, int]:
        slot = heads.select(F.shiftrightunsigned("h", 64 - bits).alias("slot"))
        if bits > STEP:
            below = spark.createDataFrame([(p,) for p in parents], "parent long")
            slot = slot.join(F.broadcast(below), F.shiftright("slot", bits - (bits - 1) // STEP * STEP) == F.col("parent"), "left_semi")
        return {r[0]: r[1] for r in slot.groupBy("slot").count().collect()}

    total = heads.count()
    d = directory(count, max(capacity, total // BUCKETS))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    routed = heads.mapInArrow(
        route(d.slots, d.depth, bitmap(heads, max(parts, total // GROUP_ROWS))),
        "entry long, h long, n long, best_len long, best_id long, best_row long, sha binary, body binary, bucket int",
    )
    classes = scratch.write(routed.repartition(parts, "bucket").sortWithinPartitions("h").mapInArrow(own, _CLASS))
    slim = scratch.write(entries.select("doc_id", "row", "entry"))
    scratch.drop(entries)
    return slim.join(classes, "entry").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "bucket"
    )
