"""SimHash fingerprints and their links within a Hamming radius (generalised pigeonhole).

The 64 bits are grouped into ``m`` partitions of correlated bits. If two fingerprints differ in
at most ``radius`` bits and thresholds ``t_1..t_m`` sum to ``radius - m + 1``, then some partition
``i`` differs in at most ``t_i`` bits (``t_i = -1`` skips a partition). Each fingerprint gets the
thresholds that dynamic programming finds cheapest on its estimated candidate counts, probes the
partitions with them and verifies all 64 bits. Buckets that many fingerprints share are cut into
square cells of bounded size, and a cell returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import forest, runs, starts
from .components import components
from .scratch import Scratch, sized

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints on one side of a cell, and rows a cell task handles as one table.
CELL = 768
BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the XXH64 of all word shingles; 0 for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    flat = b" ".join(found)
    if len(found) <= shingle:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        begins = [0, *(ends[:-shingle] + 1).tolist()]
        hashes = [xxhash.xxh64_intdigest(flat[i:j], SEED) for i, j in zip(begins, ends[shingle - 1 :].tolist(), strict=True)]
    h, ones = np.array(hashes, dtype=">u8"), np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _sign(shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return sign


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp)``; ``fp`` holds the 64 bits in a long."""
    sized(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_sign(shingle), "doc_id long, fp long")


# ---- partitions of correlated bits -------------------------------------------------------------


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((64, 64)), 0
    for b in batches:
        x = b.column(0).to_numpy().view(np.uint64)
        bits = ((x[:, None] >> BITS) & np.uint64(1)).astype(np.float32)
        total, n = total + bits.T @ bits, n + len(x)
    i, j = np.triu_indices(64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(i, 64)), pa.array(np.append(j, 64)), pa.array(np.append(total[i, j], n))], ["i", "j", "s"]
    )


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Count, and for each two bits the fingerprints that have both; 2,081 rows reach the driver."""
    summed = fps.select("fp").mapInArrow(_moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    n, both = 0, np.zeros((64, 64))
    for i, j, s in summed.collect():
        if i == 64:
            n = int(s)
        else:
            both[i, j] = both[j, i] = s
    return n, both


def partition_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Greedy groups: each partition takes the free bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, parts = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        one = [max(free, key=lambda b: (p[b] * (1 - p[b]), -b))]
        free.discard(one[0])
        while len(one) < size:
            best = max(free, key=lambda b: (corr[b, one].mean(), -b))
            one.append(best)
            free.discard(best)
        parts.append(sorted(one))
    return parts


def entropy(p: np.ndarray, part: list[int]) -> float:
    """Bits by which a partition narrows the candidates, were its bits independent."""
    q = p[part]
    return float(-np.log2(np.maximum(q * q + (1 - q) ** 2, 1e-9)).sum())


def choose_parts(n: int, both: np.ndarray, radius: int) -> list[list[int]]:
    """The number of partitions whose cheapest allocation costs least at this table's size."""
    p = np.diag(both) / max(n, 1)
    best = None
    for m in range(max(2, radius - 1), radius + 3):
        parts = partition_bits(n, both, m)
        cost = np.array([[_probes(len(x), t) * (1 + n * 2.0 ** -entropy(p, x)) for t in range(radius + 1)] for x in parts])
        total = allocate(cost[None], radius)[1][0]
        if best is None or total < best[0]:
            best = (total, parts)
    return best[1]


def _probes(width: int, t: int) -> int:
    return sum(len(list(itertools.combinations(range(width), k))) for k in range(t + 1))


def allocate(cost: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Dynamic program over partitions: ``cost[row, part, t]`` -> thresholds ``[row, part]``, totals.

    State: the sum of ``t + 1`` so far; the thresholds must sum to ``radius - m + 1``. A skipped
    partition (-1) costs nothing.
    """
    rows, m, _ = cost.shape
    steps = np.concatenate([np.zeros((rows, m, 1)), cost], axis=2)  # index t + 1
    best = np.full((rows, radius + 2), np.inf)
    best[:, 0] = 0
    took = np.zeros((rows, m, radius + 2), dtype=np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for s in range(radius + 2):
            for t in range(min(s, radius + 1) + 1):
                c = best[:, s - t] + steps[:, i, t]
                better = c < new[:, s]
                new[better, s] = c[better]
                took[better, i, s] = t
        best = new
    s, out, at = np.full(rows, radius + 1), np.zeros((rows, m), dtype=np.int8), np.arange(rows)
    for i in reversed(range(m)):
        out[:, i] = took[at, i, s] - 1
        s = s - took[at, i, s]
    return out, best[:, radius + 1]


def gather(x: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.uint64)
    for k, b in enumerate(part):
        out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def index_rows(parts: list[list[int]]):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for k, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(len(x), k, np.int32)), pa.array(gather(x, part).view(np.int64))],
                    ["fp", "part", "val"],
                )

    return index


def probe_rows(parts: list[list[int]], n: int, ones: np.ndarray, radius: int):
    """Fingerprints with the sizes of their own buckets -> probes under their cheapest thresholds."""
    p = np.clip(ones / max(n, 1), 1e-6, 1 - 1e-6)

    def flips(part: list[int], t: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(range(len(part)), k)], dtype=np.uint64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("fp").to_numpy().view(np.uint64)
            own = np.stack([b.column(f"n{k}").to_numpy() for k in range(len(parts))], axis=1).astype(float)
            cost = np.zeros((len(x), len(parts), radius + 1))
            for k, part in enumerate(parts):
                bit = ((x[:, None] >> np.array(part, dtype=np.uint64)) & np.uint64(1)).astype(bool)
                # a bucket one flip away holds about own * odds rows, were the bits independent
                odds = np.where(bit, (1 - p[part]) / p[part], p[part] / (1 - p[part]))
                s1, s2 = odds.sum(1), (odds**2).sum(1)
                near = [np.ones(len(x)), s1, (s1**2 - s2) / 2]
                for t in range(radius + 1):
                    seen = own[:, k] * sum(near[: t + 1]) if t < 3 else own[:, k] * _probes(len(part), t)
                    cost[:, k, t] = seen + _probes(len(part), t) - (own[:, k] <= 1)
            chosen, _ = allocate(cost, radius)
            for k, part in enumerate(parts):
                vals = gather(x, part)
                for t in range(radius + 1):
                    who = np.flatnonzero(chosen[:, k] == t)
                    f = flips(part, t)
                    for at in range(0, len(who), max(1, 200_000 // len(f))):
                        w = who[at : at + max(1, 200_000 // len(f))]
                        v, fp = (vals[w, None] ^ f).ravel(), np.repeat(x[w], len(f))
                        keep = np.tile(np.arange(len(f)) > 0, len(w)) | np.repeat(own[w, k] > 1, len(f))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(fp[keep].view(np.int64)), pa.array(np.full(int(keep.sum()), k, np.int32)), pa.array(v[keep].view(np.int64))],
                            ["fp", "part", "val"],
                        )

    return probe


def link_cells(radius: int):
    """Cells of index rows (side 0) and probes (side 1) -> edges of a spanning forest of their links."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "cell"):
            cell, fp = table["cell"].to_numpy(), table["fp"].to_numpy()
            side = table["side"].to_numpy().astype(bool)
            a, b = [], []
            bounds = starts(cell)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                index, probes = fp[lo:hi][~side[lo:hi]], fp[lo:hi][side[lo:hi]]
                if not len(index) or not len(probes) or hi - lo == 2 and index[0] == probes[0]:
                    continue
                nodes = np.unique(np.concatenate([index, probes]))
                at, to = np.searchsorted(nodes, index), np.searchsorted(nodes, probes)
                label = np.arange(len(nodes))
                for k in range(0, len(to), 512):
                    near = np.bitwise_count((probes[k : k + 512, None] ^ index).view(np.uint64)) <= radius
                    i, j = np.nonzero(near)
                    left, right = label[to[k : k + 512][i]], label[at[j]]
                    new = left != right
                    if new.any():
                        label = forest(len(nodes), left[new], right[new])[label]
                linked = np.flatnonzero(label != np.arange(len(nodes)))
                a.append(nodes[linked])
                b.append(nodes[label[linked]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return link


def link_fingerprints(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Distinct ``fps(fp)`` -> edges ``(a, b)`` that connect exactly what links within ``radius`` connect."""
    spark = fps.sparkSession
    n, both = bit_moments(fps)
    parts = choose_parts(n, both, radius)
    m, width = len(parts), max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    index = scratch.write(fps.select("fp").mapInArrow(index_rows(parts), "fp long, part int, val long"))
    sizes = scratch.write(index.groupBy("part", "val").agg(F.count("*").alias("n_index")))
    own = index.join(sizes, ["part", "val"]).groupBy("fp").agg(
        *[F.max(F.when(F.col("part") == k, F.col("n_index"))).alias(f"n{k}") for k in range(m)]
    )
    probes = scratch.write(
        own.mapInArrow(probe_rows(parts, n, np.diag(both), radius), "fp long, part int, val long")
    )
    asked = probes.groupBy("part", "val").agg(F.count("*").alias("n_probe"))
    # Only buckets with both an index row and a probe go on; both counts set the cells of a bucket.
    cells = scratch.write(
        sizes.join(asked, ["part", "val"])
        .select("part", "val", F.ceil(F.col("n_index") / cell).alias("rows"), F.ceil(F.col("n_probe") / cell).alias("cols"))
    )
    spread = lambda over: F.explode(F.sequence(F.lit(0).cast("long"), F.col(over) - 1))
    own_tile = lambda over: F.pmod(F.xxhash64("fp", F.lit(7)), F.col(over))
    left = index.join(cells, ["part", "val"]).select("*", own_tile("rows").alias("i"), spread("cols").alias("j"), F.lit(0).alias("side"))
    right = probes.join(cells, ["part", "val"]).select("*", own_tile("cols").alias("j"), spread("rows").alias("i"), F.lit(1).alias("side"))
    dealt = left.unionByName(right).select(F.xxhash64("part", "val", "i", "j").alias("cell"), "side", "fp")
    return dealt.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(link_cells(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the least doc_id reachable over links, itself included. Null and blank
    texts have fingerprint 0 and link like any other; texts of fewer than three words are one
    shingle; rows with a null doc_id take part and get the component of the others (null alone).
    Repeated rows give repeated results; other columns are ignored; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    signed = scratch.write(signatures(docs))
    fps = scratch.write(signed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    stars = components(scratch.write(link_fingerprints(fps, scratch, radius, cell)), scratch)
    rooted = scratch.write(
        fps.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    least = scratch.write(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_fp")))
    named = scratch.write(rooted.join(least, "root").select("fp", "component_id"))
    return signed.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def candidates(rows: DataFrame, scratch: Scratch, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``rows(key, text)`` -> edges ``(a, b)`` of keys that connect exactly what links within ``radius`` connect."""
    signed = scratch.write(signatures(rows.select(F.col("key").alias("doc_id"), "text"), shingle))
    fps = scratch.write(signed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    linked = link_fingerprints(fps, scratch, radius)
    first = lambda name: fps.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_key"))
    between = linked.join(first("a"), "a").join(first("b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    within = signed.join(fps.where("n > 1"), "fp").where("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    return scratch.write(between.unionByName(within))
