"""Exact duplicates, SimHash and embeddings against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mapquarry.llm import embdedup, exactdup, simhash
from mapquarry.llm.blocks import forest
from mapquarry.llm.components import components
from mapquarry.llm.scratch import Scratch

DOCS = "text string, doc_id long, kept string, entry string, fp long"


def docs_of(spark, texts, ids=None):
    rows = [(t, i if ids is None else ids[i], "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def closure(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            if (label[i], label[j]) != (low, low):
                label[i] = label[j] = low
                changed = True
    return label


def test_forest_and_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)]
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    want = closure(len(nodes), [(at[a], at[b]) for a, b in edges])
    got = forest(len(nodes), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    assert got.tolist() == want
    df = spark.createDataFrame(edges + [(5, 5), (None, 3)], "a long, b long")
    stars = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    assert {nodes[i]: nodes[w] for i, w in enumerate(want) if i != w} == stars
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


def exact_want(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i))
    return {(i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


@pytest.mark.parametrize(("bits", "capacity"), [(64, 2048), (3, 4), (64, 1)])
def test_exact_duplicates(spark, bits, capacity):
    """Three hash bits make almost all texts collide; a capacity of 1 splits to the last bit."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(150)] + [None, "", " \n", "é" * 5000, "é " * 5000, "a\x1cb", "a b"]
    got = exactdup.exact_duplicates(docs_of(spark, texts), capacity, bits).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == exact_want(list(enumerate(texts)))
    assert len(got) == len(texts)


def test_exact_repeated_rows_and_null_ids(spark):
    got = exactdup.exact_duplicates(docs_of(spark, ["a", "a", "a b", "c"], [7, 7, None, None])).collect()
    assert sum(r.kept for r in got) == 3 and {r.group_size for r in got} == {1, 2}
    assert exactdup.exact_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


def counter(hashes):
    """Counts of prefixes below their parents, as the operator asks for them."""

    def count(bits, parents):
        out = defaultdict(int)
        for h in hashes:
            if bits <= exactdup.STEP or h >> (64 - (bits - 1) // exactdup.STEP * exactdup.STEP) in parents:
                out[h >> (64 - bits)] += 1
        return out

    return count


def test_directory_doubles():
    assert exactdup.directory(counter([]), 1).local == [0]
    d = exactdup.directory(counter([0, 1 << 60, 2 << 60, 3 << 60, 15 << 60]), 2)
    slots = d.slots.tolist()
    assert d.depth == 3 and slots[0] != slots[1] and slots[2] == slots[3] and len(set(slots[4:])) == 1 and len(set(slots)) == 4
    rng = random.Random(2)
    crowded = [(5 << 58) | rng.getrandbits(44) for _ in range(3000)]  # 20 bits in common, 44 free
    hashes = crowded + [rng.getrandbits(64) for _ in range(40_000)]
    d = exactdup.directory(counter(hashes), 8)
    assert 12 < d.depth <= exactdup.MAX_DEPTH and len(d.slots) == 1 << d.depth
    sizes = defaultdict(int)
    for h in hashes:
        b = int(d.slots[h >> (64 - d.depth)])
        sizes[b] += 1
        assert h >> (64 - d.local[b]) == d.prefix[b] if d.local[b] else True
    assert all(n <= 8 or d.local[b] == exactdup.MAX_DEPTH for b, n in sizes.items()) and max(d.local) > 12


def test_bodies_travel_only_for_repeated_hashes(spark):
    df = spark.createDataFrame([(i, i % 7 if i < 20 else i) for i in range(200)], "e long, k long").select(F.xxhash64("k").alias("h"))
    bits = exactdup.bitmap(df, 3)
    assert int(np.unpackbits(bits).sum()) == 7


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_want(texts):
    fps = [slow_fingerprint(t) for t in texts]
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    return list(zip(fps, closure(len(fps), linked), strict=True))


def test_simhash(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdÉ") for _ in range(4))
    base = [" ".join(word() for _ in range(300)) for _ in range(6)]
    near = []
    for b in base:
        for _ in range(12):
            w = b.split(" ")
            w[rng.randrange(len(w))] = word().upper()
            near.append(" ".join(w))
    texts = base + near + [None, "", " \t", "one", "One", "one two", "A\x0bb\x1cc d E", "x " * 20000]
    for cell in (768, 3):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(spark, texts), cell=cell).collect()}
        assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(simhash_want(texts))}
    assert simhash.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_links_of_crowded_fingerprints(spark):
    """A ball of fingerprints around one centre fills buckets; the links must survive the cells."""
    rng = np.random.default_rng(2)
    centre = np.uint64(0x0123456789ABCDEF)
    flips = [sum(1 << int(b) for b in rng.choice(20, size=rng.integers(0, 5), replace=False)) for _ in range(250)]
    far = rng.integers(0, 2**63, 100, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre ^ np.array(flips, dtype=np.uint64), far])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    order = sorted(fps.tolist())
    linked = [(i, j) for i in range(len(order)) for j in range(i) if ((order[i] ^ order[j]) & (2**64 - 1)).bit_count() <= 2]
    want = closure(len(order), linked)
    for cell in (768, 16):
        s = Scratch(spark, "t")
        stars = {r.node: r.root for r in components(simhash.link_fingerprints(df, s, 2, cell), s).collect()}
        assert stars == {order[i]: order[w] for i, w in enumerate(want) if i != w}


def test_allocation_is_cheapest_and_general():
    cost = np.array([[[1.0, 5.0, 9.0], [100.0, 200.0, 300.0], [2.0, 3.0, 50.0]]])
    chosen, total = simhash.allocate(cost, 2)
    assert chosen.tolist() == [[0, -1, 1]] and total.tolist() == [4.0]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "z", 0) for i, v in rows], "vec_id long, embedding array<float>, id string, n_links long").repartition(3)


@pytest.mark.parametrize("tile", [None, 16])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 24))
    x = np.concatenate([c + rng.normal(size=(20, 24)) * s for c, s in zip(centres, np.linspace(0.02, 0.35, 8), strict=True)] + [rng.normal(size=(60, 24)), centres[:3] * 3, centres[:3] * 3])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [None] + [1.0] * 23), (904, [float("nan")] * 24), (905, [float("inf")] + [0.0] * 23), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(vectors(spark, rows + odd), tile=tile).collect()}
    f = np.array([v for _, v in rows])
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    label = closure(len(u), list(zip(*np.nonzero(near), strict=True)))
    want = {i: (int(near[i].sum()), label[i], label[i] == i) for i in range(len(u))}
    want |= {i: (0, i, True) for i in range(900, 906)} | {906: (1, 906, True), 907: (1, 906, False)}
    assert got == want


def test_embeddings_empty_and_null_ids(spark):
    assert embdedup.near_duplicates(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0
    got = embdedup.near_duplicates(vectors(spark, [(None, [1.0]), (2, [1.0]), (2, [1.0])])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in got) == [(-1, 0, False), (2, 1, True), (2, 1, True)]
