"""Ordered merges against a replay one decision after the other."""

from __future__ import annotations

import random

import pytest

from mapquarry.operators import merges, topics


def replay(rows, hops=20):
    redirect, place, out = {}, {}, []

    def resolve(x):
        for _ in range(hops):
            if x not in redirect:
                break
            x = redirect[x]
        return x

    for seq, a, b, conf in sorted(rows, key=lambda r: r[0]):
        if conf is None or conf < 0.85:
            out.append((seq, "low", None, None))
            continue
        if not (a or "").strip() or not (b or "").strip():
            out.append((seq, "missing", None, None))
            continue
        x, y = resolve(a), resolve(b)
        for z in (a, b):
            place.setdefault(z, z)
        if x == y:
            out.append((seq, "same", None, None))
            continue
        for t, p in place.items():
            if p == x:
                place[t] = y
        redirect[x] = y
        out.append((seq, "merged", x, y))
    return out, sorted((t, p) for t, p in place.items() if t != p)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "seq long, src string, dst string, confidence double").repartition(3)
    told, ends = merges.ordered(df, **how)
    return sorted(map(tuple, told.collect())), sorted(map(tuple, ends.collect()))


def decisions(seed, n, names):
    rnd = random.Random(seed)
    rows = []
    for k in rnd.sample(range(10 * n), n):
        a, b = (f"t{rnd.randrange(names):03d}" for _ in range(2))
        rows.append((k, rnd.choice([a] * 30 + [None, " "]), b, rnd.choice([0.9, 1.0, 0.85, 0.95, 0.9, 0.84, None])))
    return rows


@pytest.mark.parametrize(("n", "names", "block"), [(60, 40, 10**6), (120, 60, 10)])
def test_equals_a_replay(spark, n, names, block):
    rows = decisions(n, n, names)
    told, ends = replay(rows)
    assert sum(x[1] == "merged" for x in told) > 20
    assert run(spark, rows, block=block) == (told, ends)


def test_named_cases(spark):
    rows = [(1, "a", "b", 0.9), (2, "a", "c", 0.9), (3, "p", "q", 0.9), (4, "q", "p", 0.9), (5, "b", "c", 0.9), (6, "z", "z", 1.0)]
    told, ends = run(spark, rows)
    assert told == [(1, "merged", "a", "b"), (2, "merged", "b", "c"), (3, "merged", "p", "q"), (4, "same", None, None), (5, "same", None, None), (6, "same", None, None)]
    assert ends == [("a", "c"), ("b", "c"), ("p", "q")]
    assert run(spark, []) == ([], [])


@pytest.mark.parametrize("block", [10**6, 16])
def test_twenty_hops(spark, block):
    """A chain n00 <- n01 <- ... longer than 20 redirects, asked from its far end, beside a short group."""
    rows = [(k, f"n{k:02d}", f"n{k + 1:02d}", 0.9) for k in range(30)] + [(40, "n00", "x", 0.9), (41, "n05", "n30", 0.9), (50, "a", "b", 0.9)]
    told, ends = replay(rows)
    assert ("merged", "n20", "x") in [x[1:] for x in told]
    assert run(spark, rows, block=block) == (told, ends)


def test_plain_redirects_stop_after_twenty(spark):
    chain = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}") for k in range(40)], "src string, dst string")
    got = {r["src"]: r["dst"] for r in topics.redirects(chain).collect()}
    assert got["n00"] == "n20" and got["n15"] == "n35" and got["n30"] == "n40"


def test_places_on_the_graph(spark, sf):
    from mapquarry.plans import queries
    from mapquarry.plans.catalog import Catalog

    c = Catalog(spark, sf)
    place = dict(replay([tuple(r) for r in queries.decisions(c).select("seq", "src", "dst", "confidence").collect()])[1])
    want = {(d, place.get(t, t)) for d, t in c.has_topic.select("dataset_id", "entity_id").collect()}
    assert set(map(tuple, queries.QUERIES["topic_merge_places"](spark, sf).collect())) == want
