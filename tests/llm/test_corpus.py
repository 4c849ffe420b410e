"""Mixing, packing, the pipeline and the SQL of the training-data queries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from mapquarry.llm import mixing, packing, queries
from tests.oracle import assert_same

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, "/root/testdata/sf0.01", queries.QUERIES[name], queries.SQL[name])


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left = {}, share * sum(sizes.values())
    open_ = set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(60))) if i % 9 else None, rng.choice(["b", "a", "a", "a", "é", None, "tiny"] if i > 5 else ["tiny"]), 1.0) for i in range(600)]
    rows += [(None, "x y", "a", 1.0), (5000, "", "void", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double")
    got = mixing.mix(df).collect()
    size = lambda t: len((t or "").split(" ")) if t else 0
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = slow_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 0.35 * want[s] + 60 for s in sizes)
    assert sorted(map(str, mixing.mix(df.repartition(5)).collect())) == sorted(map(str, got))
    emitted = mixing.mixed(df)
    assert emitted.columns == df.columns and emitted.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_words_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(PATH), packing.Words(PATH)
    odd = ["", "The END. of\x0bthings,\x1cand\x85more", "ÀÉ Straße Å İstanbul ΑΣ don't it's 12 3a a1", "x <|endoftext|> y.<|startoftext|>", "a...b!! %%% $$$.", "日本語 テスト\u3000x", "o'clock, he'll 'tis", "é," * 50, "A\u030a b\u0301."]
    odd += ["".join(random.Random(i).choice("ab .,!?'&éß日\n\t1İ") for _ in range(300)) for i in range(60)]
    assert [x.tolist() for x in w.ids(odd)] == [t.encode(s, add_special_tokens=False).ids for s in odd]


def slow_cost(at, pen, most):
    best = {0: 0.0}
    for j in range(1, len(at)):
        best[j] = min((best[i] + packing.padding(at[j] - at[i], most) + pen[j] for i in range(j) if at[j] - at[i] <= most), default=float("inf"))
    return best[len(at) - 1]


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 90, 25)
    ends = rng.random(lengths.sum()) < 0.1
    at, pen = packing.cut_places(lengths, ends, stride=20)
    cuts = packing.choose_cuts(at, pen, 64, (1, 2, 4, 8, 16, 32))
    where = {p: k for k, p in enumerate(at.tolist())}
    assert cuts[0] == 0 and cuts[-1] == lengths.sum() and max(np.diff(cuts)) <= 64
    cost = sum(packing.padding(b - a, 64) + pen[where[b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    assert cost == slow_cost(at.tolist(), pen.tolist(), 64)


def test_halved_tails():
    for n in (1, 5, 1024, 3000, 3999, 4000, 4096):
        parts = packing.halve_tail(n)
        assert sum(parts) == n and sum(map(packing.padding, parts)) <= packing.padding(n)


def test_pack(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    docs = [tuple(d) for d in docs] + [(900_001, None), (900_002, ""), (900_003, "word " * 30_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length long").repartition(3)
    got = packing.pack(df, PATH).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in docs}
    by_doc, by_seq = {}, {}
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len(x)
    pad = 0
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= 4096
        pad += packing.padding(at)
    assert pad < 0.03 * sum(map(len, ids.values()))
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline as cp
    from tests.llm.test_pairs import closure

    def shingle_set(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\r", " ").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        words = [w for w in words if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["language", "exact", "near", "mix", "pack"]
    one = stages["language"](spark, docs, sf)
    assert one.columns == docs.columns and one.count() >= 0.99 * docs.count()
    rows = sorted(one.collect())
    seen, two = {}, []
    for r in sorted(rows, key=lambda r: (-len(r.text), r.doc_id)):
        if seen.setdefault(r.text.translate({ord(c): None for c in " \t\n\x0b\x0c\r"}), r.doc_id) == r.doc_id:
            two.append(r)
    two.sort()
    sets = [shingle_set(r.text) for r in two]
    links = []
    for i in range(len(two)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                links.append((i, j))
    label = closure(len(two), links)
    three = [r for i, r in enumerate(two) if label[i] == i]
    assert sorted(stages["near"](spark, stages["exact"](spark, one, sf), sf).collect()) == three
    mixed = stages["mix"](spark, spark.createDataFrame(three, docs.schema), sf).collect()
    total = sum(len(r.text.split()) for r in three)
    assert 1.3 * total < sum(len(r.text.split()) for r in mixed) < 1.7 * total
    packed = cp.run(spark, sf)
    tokens = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    words = packing.Words(PATH)
    assert sum(r[1] for r in tokens) == sum(len(x) + 1 for x in words.ids([r.text for r in mixed]))


def test_the_rest_stands_without_the_subpackage():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for p in (root / "mapquarry").rglob("*.py"):
        if "llm" not in p.parts:
            names = [n.module or "" for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n for n in names), p
