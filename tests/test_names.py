from __future__ import annotations

import random

import pytest

from mapquarry.functions.similarity import jaro_winkler_of
from mapquarry.operators import names


def words(seed, n):
    rnd = random.Random(seed)
    base = ["cold anvil", "old anvil", "river basin", "rivers", "flood zone", "aaaa", "aab", "x", "été", "hydrography"]
    out = {None, "", "  ", "a"}
    while len(out) < n:
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w) + 1)
            w[k:k + rnd.randrange(2)] = rnd.choice(["", "a", "s", "old", " "])
        out.add("".join(w))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0.7, 0.8, 0.9, 0.97, 1.0])
def test_equals_comparing_all_pairs(spark, least):
    one, two = words(1, 120), words(2, 150)
    got = names.alike(spark.createDataFrame([(x,) for x in one * 2], "a string"), spark.createDataFrame([(x,) for x in two], "b string"), least)
    want = {(a, b, round(jaro_winkler_of(a, b), 6)) for a in one for b in two if a and a.strip() and b and b.strip() and round(jaro_winkler_of(a, b), 6) >= least}
    assert len(want) > 3
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_few_pairs_are_verified(spark):
    rnd = random.Random(3)
    rows = sorted({"".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(8, 14))) for _ in range(600)})
    df = spark.createDataFrame([(x,) for x in rows], "a string")
    pairs = names.candidates(df, df.withColumnRenamed("a", "b"), 0.9).where("a < b")
    assert pairs.count() < 0.02 * len(rows) * (len(rows) - 1) / 2
    plan = names.candidates(df, df.withColumnRenamed("a", "b"), 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_low_scores_are_refused_and_no_names(spark):
    none = spark.createDataFrame([], "a string")
    with pytest.raises(ValueError):
        names.candidates(none, none.withColumnRenamed("a", "b"), 0.6)
    assert names.alike(none, none.withColumnRenamed("a", "b")).count() == 0
