"""The pipeline's near stage against brute-force five-word Jaccard similarities."""

from __future__ import annotations

import random

from mapquarry.llm import shingles
from mapquarry.llm.scratch import Scratch
from tests.llm.test_pairs import closure

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def jaccard(a, b):
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in ((a or "").lower().split(), (b or "").lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def near_pairs(seed, n):
    """Texts and copies with a few words changed; similarities from 0.7 to 1."""
    rng = random.Random(seed)
    for length, changed in ((100, 1), (100, 2), (300, 2), (300, 5), (300, 9), (1000, 5), (1000, 20), (1000, 30), (12, 0), (3, 0)):
        for _ in range(n):
            one = words(rng, length)
            two = list(one)
            for i in rng.sample(range(length), changed):
                two[i] = "changed"
            yield " ".join(one), " ".join(two).upper()


def test_near_stage_finds_copies_of_similarity_from_0_8(spark):
    import corpus_pipeline as cp

    pairs = list(near_pairs(3, 12))
    rows = [(2 * i + k, t, "en", "s", len(t)) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r.doc_id for r in cp.near(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), "").collect()}
    want = {2 * i for i in range(len(pairs))} | {2 * i + 1 for i, p in enumerate(pairs) if jaccard(*p) < 0.8}
    assert got == want and len(pairs) < len(want) < 2 * len(pairs)


def test_components_in_small_cells_equal_brute_force(spark):
    rng = random.Random(5)
    base, texts = words(rng, 120), [None, "", " \n", "a b", "A  b", "a b c"]
    for _ in range(60):
        t = list(base)
        for i in rng.sample(range(120), rng.randrange(6)):
            t[i] = rng.choice("xyz")
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    n = len(texts)
    label = closure(n, [(i, j) for i in range(n) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8])
    for tile in (7, 384):
        got = shingles.near_components(df, Scratch(spark, "test"), tile).collect()
        assert {(r.key, r.root) for r in got} == {(i, x) for i, x in enumerate(label) if list(label).count(x) > 1}
    assert shingles.near_components(df.limit(0), Scratch(spark, "test")).count() == 0


def test_large_classes_are_not_dealt_to_their_own_tiles(spark):
    """Two large classes, one of them in one tile less, and single rows: all pairs but those within a large class meet."""
    kind = [0] * 400 + [1] * 90 + [None] * 45
    rows = [(i, 10, 0, k) for i, k in enumerate(kind)] + [(600 + i, 10, 1, 600) for i in range(60)]
    held = spark.createDataFrame(rows, "key long, chars int, root long, class long")
    dealt = shingles._between_classes(held, Scratch(spark, "test"), 20).collect()
    cells = {}
    for r in dealt:
        cells.setdefault(r.cell, set()).add(r.key)
    met = {(a, b) for keys in cells.values() for a in keys for b in keys if a < b}
    wanted = {(a, b) for a in range(535) for b in range(a + 1, 535) if kind[a] is None or kind[a] != kind[b]}
    assert wanted <= met
    assert not any(r.key >= 600 for r in dealt)
    tiles = 20 + 5 + 3
    assert len(dealt) == 400 * (tiles - 20) + 90 * (tiles - 5) + 45 * tiles


def test_a_group_of_copies_costs_a_few_cells_a_row(spark):
    rng = random.Random(8)
    base, texts = words(rng, 100), []
    for i in range(600):
        t = list(base)
        t[i % 100] = rng.choice("xyz")
        texts.append(" ".join(t))
    scratch = Scratch(spark, "test")
    sent = []
    deal, shingles._cell_links = shingles._cell_links, lambda rows, dealt, s: (sent.append(dealt.count()), deal(rows, dealt, s))[1]
    try:
        got = shingles.near_components(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), scratch, 20).collect()
    finally:
        shingles._cell_links = deal
    assert len(got) == 600 and {r.root for r in got} == {0}
    assert sent[0] == 1200 and sent[1] < 4 * 600


def test_texts_with_one_passage_in_common_are_not_compared(spark):
    """1,200 texts, half of each the same passage and none a near copy, next to two pairs of copies: hardly a cell is dealt."""
    rng = random.Random(11)
    passage = words(rng, 100)
    texts = [" ".join(words(rng, 25) + passage + words(rng, 65)) for _ in range(1200)]
    texts[700], texts[900] = texts[3] + " more", texts[4] + " more"
    sent = []
    deal, shingles._cell_links = shingles._cell_links, lambda rows, dealt, s: (sent.append(dealt.count()), deal(rows, dealt, s))[1]
    try:
        got = shingles.near_components(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), Scratch(spark, "test"), 20).collect()
    finally:
        shingles._cell_links = deal
    assert {(r.key, r.root) for r in got} == {(3, 3), (700, 3), (4, 4), (900, 4)}
    assert sum(sent) < 100


def test_any_two_sets_of_similarity_0_8_share_a_prefix():
    import numpy as np

    rng = np.random.default_rng(2)
    for size in [*range(1, 30), 100, 301]:
        common = rng.integers(0, 5, 1 << shingles.SLOTS).astype(np.uint8)
        one = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        for keep in range(len(one) + 1):
            for more in {0, 1, len(one) // 8}:
                two = np.unique(np.concatenate([one[:keep], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
                shared = len(np.intersect1d(one, two))
                if len(two) and 5 * shared >= 4 * (len(one) + len(two) - shared):
                    assert len(np.intersect1d(shingles.prefix(one, common), shingles.prefix(two, common)))
