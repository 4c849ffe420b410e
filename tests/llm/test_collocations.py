"""Phrase mining against counting every phrase of every piece."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from mapquarry.llm import collocations as C
from mapquarry.llm import queries
from tests.oracle import assert_same

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plainly(rows: list[tuple], least: int, most: int, top: int) -> list[tuple]:
    f: Counter = Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            f.update((lang or "und", tuple(w[i : i + n])) for n in range(1, most + 1) for i in range(len(w) - n + 1))
    n: Counter = Counter()
    for (lang, w), c in f.items():
        n[lang] += c if len(w) == 1 else 0
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang, w] = (score, a, f[lang, w[:k]], f[lang, w[k:]])
    inner = {(lang, w[i : i + m]) for (lang, w), x in found.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if x[1] >= found[lang, w[i : i + m]][1]}
    out = []
    for lang in n:
        mine = sorted((-s, -a, " ".join(w).encode(), l_, r) for (g, w), (s, a, l_, r) in found.items() if g == lang and (g, w) not in inner)
        out += [(lang, i + 1, p.decode(), -a, l_, r, n[lang], -s) for i, (s, a, p, l_, r) in enumerate(mine[:top])]
    return sorted(out)


def mined(spark, rows, **how):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", C.F.lit(1)).repartition(3)
    return sorted(map(tuple, C.mine(docs, **how).select(*COLUMNS).collect()))


def texts(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    vocabulary = ["a", "B", "ab", "ça", "𝒳", "c d", "new york city", "new york", "x x x x x x", "of the"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ! "]
    return [(rnd.choice(["en", "fr", None]), "".join(rnd.choice(vocabulary) + rnd.choice(marks[:3] * 4 + marks) for _ in range(rnd.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("shard", [40, 1 << 21])
def test_equals_counting_every_phrase(spark, shard):
    rows = texts(1, 300) + [("en", None), (None, ""), ("en", "! ,.;"), ("de", "a b " * 4000)] + [("fr", "same words again")] * 50
    want = plainly(rows, 20, 5, 30)
    assert len(want) > 60
    assert mined(spark, rows, least=20, top=30, shard_words=shard) == want


def test_other_lengths_and_no_rows(spark):
    rows = texts(2, 100)
    for most in (2, 3):
        assert mined(spark, rows, least=5, most=most) == plainly(rows, 5, most, 2000)
    assert mined(spark, []) == [] == mined(spark, [("en", None), (None, " . ")])


def test_scores_beyond_64_bits(spark):
    rows = [("en", "p q", 4 * 10**9), ("en", "p", 5 * 10**9), ("en", "q", 6 * 10**9)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, f long").withColumn("words", C.F.size(C.F.split("phrase", " ")))
    n = spark.createDataFrame([("en", 9 * 10**12 + 7)], "lang string, n long")
    row = C.scored(phrases, n).first()
    assert row["score"] == 1000 * 4 * 10**9 * (9 * 10**12 + 7) // (30 * 10**18) and row["l"] == 5 * 10**9


def test_suffix_array_and_lcp():
    rnd = np.random.default_rng(3)
    for size in (1, 2, 7, 300):
        for top in (1, 2, 5):
            ids = rnd.integers(0, top, size)
            order, lcp = C.suffixes(ids, 5)
            heads = [tuple(ids[i : i + 5]) for i in order]
            assert sorted(order.tolist()) == list(range(size)) and heads == sorted(heads)
            want = [0] + [next((k for k in range(5) if k >= min(len(a), len(b)) or a[k] != b[k]), 5) for a, b in zip(heads, heads[1:])]
            assert lcp.tolist() == want


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    rows = texts(4, 120)
    monkeypatch.setattr(C, "bitmap", lambda h: np.full(1 << (C.BITMAP - 3), 255, np.uint8))
    assert mined(spark, rows, least=8) == plainly(rows, 8, 5, 2000)


def test_query_equals_sql(spark):
    assert assert_same(spark, "/root/testdata/sf0.01", queries.op11_suffix_collocations, queries.SQL["op11_suffix_collocations"]) > 50
