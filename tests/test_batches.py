"""Many queries at once: searches by classes of like rows, nearest vectors by shares, against plain scores."""

from __future__ import annotations

import math

import numpy as np
import pytest

from mapquarry.operators import batchsearch as BS
from mapquarry.operators import retrieve as R
from tests.test_searchindex import FIELDS, plain


@pytest.fixture(scope="module")
def rows():
    nouns = ["road", "river", "lake", "parcel", "soil"]
    return [
        (d, f"The {nouns[d % 5]} map {d}", None if d % 11 == 0 else f"{nouns[d % 3]} " * (d % 4) + "common text", [nouns[d % 5], None, f"t{d % 3}"] if d % 4 else None) for d in range(300)
    ] + [(1000, None, None, None), (1001, "", "...", [])]


@pytest.mark.parametrize("pushed", [500, 1])
def test_search_equals_plain_scores(spark, rows, monkeypatch, pushed):
    monkeypatch.setattr(BS, "PUSHED", pushed)
    queries = [(1, "Road map"), (2, "common text the"), (3, "lake t2 common"), (4, "nothing known"), (5, ""), (6, None), (7, "map 17 17"), (8, "map road"), (9, "road road map")]
    df = spark.createDataFrame(rows, "id long, title string, body string, tags array<string>")
    got = BS.search(df, "id", FIELDS, spark.createDataFrame(queries, "query_id long, text string"), 5, share=20, most=2)
    assert sorted((r["query_id"], r["key"], r["score"]) for r in got.collect()) == plain(rows, queries, 5)


def test_like_rows_are_one_class(spark):
    """Rows grow, what is scored doesn't."""
    vocabulary = spark.createDataFrame([("road",)], "term string")
    counts = []
    for n in (100, 1000):
        df = spark.range(n).selectExpr("id", "concat('map ', id, ' road') AS title")
        found = BS.classes(df, "id", {"title": 1.0}, vocabulary, 3)
        assert [list(r["keys"]) for r in found.collect()] == [[0, 1, 2]] and found.first()["count"] == n
        counts.append(found.count())
    assert counts == [1, 1]


def test_nearest_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 2)
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(3000, 4)).round(2).tolist()
    base[5:900:7] = [base[5]] * len(base[5:900:7])  # many copies, which tie
    odd = [None, [0.0] * 4, [1.0, None, 2.0, 3.0], [1.0, 2.0], [], [float("nan"), 1.0, 1.0, 1.0]]
    rows = list(enumerate(base + odd))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 500 = 5 OR vec_id IN (3000, 3003)").selectExpr("vec_id AS query_id", "embedding AS q")
    got = {}
    for r in R.nearest(asked, df, 4, share=1000, most=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])

    def cos(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return None
        return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))

    order = lambda s: -math.inf if s is not None and math.isnan(s) else math.inf if s is None else -s
    by_id = dict(rows)
    for q in [5, 505, 1005, 1505, 2005, 2505, 3000, 3003]:
        scores = [(v, s if s is None or math.isnan(s) else round(s, 6)) for v, e in rows if v != q for s in [cos(by_id[q], e)]]
        want = sorted(scores, key=lambda x: (order(x[1]), x[0]))[:4]
        assert [got[q][k][0] for k in (1, 2, 3, 4)] == [v for v, _ in want]
        assert str([got[q][k][1] for k in (1, 2, 3, 4)]) == str([s for _, s in want])


def test_like_boxes_are_joined_once(spark, monkeypatch):
    """Counts equal those of all pairs, and the pairs of the join don't grow with copies."""
    spaces = [(i, float(i % 4), 0.0, float(i % 4 + 1), 1.0) for i in range(200)] + [(900, None, 0.0, 1.0, 1.0)]
    space = spark.createDataFrame(spaces, "dataset_id long, west double, south double, east double, north double")
    boxes = spark.createDataFrame([(i, float(i % 2), 0.5, float(i % 2) + 0.5, 0.7) for i in range(40)] + [(50, 80.0, 0.0, 81.0, 1.0)], "query_id long, qw double, qs double, qe double, qn double")
    join, seen = R.range_join, []

    def counted(*args):
        out = join(*args)
        seen.append(out.count())
        return out

    want = sorted((r["query_id"], r["hits"], r["s"]) for r in join(boxes, space).groupBy("query_id").agg(R.F.count("*").alias("hits"), R.F.sum("dataset_id").alias("s")).collect())
    monkeypatch.setattr(R, "range_join", counted)
    assert sorted(map(tuple, R.range_counts(boxes, space).collect())) == want and len(want) == 40
    assert seen == [3]  # pairs of different boxes
