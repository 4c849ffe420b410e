"""The search index against plain scores, and what a search reads."""

from __future__ import annotations

import glob
import math
import re
import uuid
from collections import Counter

import pyarrow.parquet as pq
import pytest

from mapquarry.operators import searchindex as S

FIELDS = {"title": 2.0, "body": 1.0, "tags": 1.5}


def plain(rows, queries, k):
    words = lambda t: re.findall("[a-z0-9]+", (" ".join(x or "" for x in t) if isinstance(t, list) else t or "").lower())
    score = {}
    for f, weight in enumerate(FIELDS.values()):
        docs = {r[0]: words(r[f + 1]) for r in rows}
        docs = {d: w for d, w in docs.items() if w}
        mean = sum(map(len, docs.values())) / max(1, len(docs))
        df = Counter(t for w in docs.values() for t in set(w))
        for d, w in docs.items():
            for t, tf in Counter(w).items():
                idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                score[d, t] = score.get((d, t), 0) + weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    out = []
    for q, text in queries:
        total = Counter()
        for t in set(words(text)):
            for d in {r[0] for r in rows}:
                if (d, t) in score:
                    total[d] += score[d, t]
        out += [(q, d, round(s, 6)) for d, s in sorted(total.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]
    return sorted(out)


def index(spark, rows, tmp, **how):
    df = spark.createDataFrame(rows, "id long, title string, body string, tags array<string>").withColumn("key", S.F.lit("x")).withColumn("no", S.F.lit(0))
    return S.build(df, "id", FIELDS, f"{tmp}/{uuid.uuid4().hex}", **how)


@pytest.fixture(scope="module")
def rows():
    nouns = ["road", "river", "lake", "parcel", "soil", "flood", "zone"]
    return [
        (d, f"The {nouns[d % 7]} map {d}", None if d % 11 == 0 else f"{nouns[d % 3]} " * (d % 5) + f"common text c{d // 40}", [nouns[d % 5], None, f"t{d % 13}"] if d % 4 else None)
        for d in range(600)
    ] + [(1000, None, None, None), (1001, "", "...", [])]


@pytest.mark.parametrize("block", [4, 128])
def test_equals_plain_scores(spark, rows, tmp_path, block):
    queries = [(1, "Road map"), (2, "common text the"), (3, "lake t3 c7 common"), (4, "nothing known"), (5, ""), (6, None), (7, "map 17 17"), (8, "the map common text")]
    made = index(spark, rows, tmp_path, block=block)
    for k in (1, 5):
        got = made.search(spark.createDataFrame(queries, "query_id long, text string"), k)
        assert sorted((r["query_id"], r["key"], r["score"]) for r in got.collect()) == plain(rows, queries, k)


def test_many_terms_are_joined(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PUSHED", 1)
    queries = [(1, "road map c3"), (2, "river soil")]
    got = index(spark, rows, tmp_path, block=8).search(spark.createDataFrame(queries, "query_id long, text string"), 4)
    assert sorted((r["query_id"], r["key"], r["score"]) for r in got.collect()) == plain(rows, queries, 4)


def test_empty(spark, rows, tmp_path):
    queries = spark.createDataFrame([(1, "road")], "query_id long, text string")
    assert index(spark, rows, tmp_path).search(queries.limit(0), 3).count() == 0
    assert index(spark, [], tmp_path).search(queries, 3).count() == 0


def test_a_search_reads_a_part(spark, sf, tmp_path, monkeypatch):
    """Of an index over whole texts a search for rare words reads few row groups and opens the postings of few blocks."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    path = f"{tmp_path}/whole"
    monkeypatch.setattr(S, "ROW_GROUP", 1 << 15)
    made = S.build(docs, "doc_id", {"text": 1.0}, path, block=8)
    groups = [(g.column(0).statistics, g.total_byte_size) for f in glob.glob(f"{path}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    term = made.spark.read.parquet(path).where("size(postings) = 1").select("term").orderBy("term").limit(500).collect()[-1]["term"]
    read = sum(n for s, n in groups if s.min <= term <= s.max)
    assert read < 0.34 * sum(n for _, n in groups)
    asked = spark.createDataFrame([(1, term)], "query_id long, text string")
    assert made.search(asked, 3).count() >= 1
    heads = made.rows(spark.createDataFrame([(term,)], "term string"))
    assert "In(term" in heads._jdf.queryExecution().executedPlan().toString() or "EqualTo(term" in heads._jdf.queryExecution().executedPlan().toString()
