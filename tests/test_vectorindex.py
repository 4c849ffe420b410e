from __future__ import annotations

import uuid

import numpy as np
import pytest

from mapquarry.operators import vectorindex as V

SCHEMA = "id long, embedding array<float>"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in r]) for k, r in enumerate(x)], SCHEMA).repartition(4)


def asked(rows, step):
    return rows.where(f"id % {step} = 0").select(V.F.col("id").alias("query_id"), "embedding")


def test_recall_on_vectors_that_lie_evenly(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(V.F.col("vec_id").alias("id"), "embedding")
    index = V.build(rows, f"{tmp_path}/even")
    q = asked(rows, 5)
    true = V.exact(q, rows, 10)
    found = index.search(q, rows, 10)
    assert V.recall(found, true) >= 0.9
    assert found.count() == 10 * q.count()


def test_clusters_need_few_lists_and_every_list_gives_all(spark, tmp_path):
    rnd = np.random.default_rng(1)
    x = np.repeat(rnd.normal(size=(40, 16)), 50, axis=0) + 0.1 * rnd.normal(size=(2000, 16))
    rows = table(spark, x)
    index = V.build(rows, f"{tmp_path}/clusters")
    q, lists = asked(rows, 40), len(index.model.means)
    true = V.exact(q, rows, 10)
    assert index.model.probes <= lists // 4
    assert V.recall(index.search(q, rows, 10), true) >= 0.9
    assert V.recall(index.search(q, rows, 10, probes=lists, again=2000), true) == 1
    again = V.VectorIndex(spark, f"{tmp_path}/clusters")  # read back from its files
    assert (again.model.means == index.model.means).all() and again.model.probes == index.model.probes


def test_a_third_in_one_list_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "CELL_ROWS", 64)
    monkeypatch.setattr(V, "CELL_QUERIES", 16)
    rnd = np.random.default_rng(2)
    x = np.concatenate([np.ones((300, 8)) + 1e-3 * rnd.normal(size=(300, 8)), rnd.normal(size=(600, 8))])
    rows = table(spark, x)
    index = V.build(rows, f"{tmp_path}/hot")
    q = asked(rows, 6)
    found = index.search(q, rows, 5, probes=len(index.model.means), again=200)
    assert sorted(map(tuple, found.select("query_id", "id", "score").collect())) == sorted(map(tuple, V.exact(q, rows, 5).select("query_id", "id", "score").collect()))


def test_vectors_without_a_cosine_and_no_vectors(spark, tmp_path):
    odd = [(100, None), (101, [0.0] * 4), (102, [float("nan"), 0.0, 0.0, 1.0]), (103, [1.0]), (104, [None, 1.0, 1.0, 1.0])]
    rnd = np.random.default_rng(3)
    rows = table(spark, rnd.normal(size=(60, 4))).unionByName(spark.createDataFrame(odd, SCHEMA))
    index = V.build(rows, f"{tmp_path}/odd")
    assert spark.read.parquet(f"{tmp_path}/odd/codes").count() == 60
    q = rows.select(V.F.col("id").alias("query_id"), "embedding")
    found = {r["query_id"] for r in index.search(q, rows, 3).collect()}
    assert found == set(range(60))
    none = rows.limit(0)
    assert V.build(none, f"{tmp_path}/{uuid.uuid4().hex}").search(q, none, 3).count() == 0
    assert V.recall(none.select("id", V.F.col("id").alias("query_id")), none.select("id", V.F.col("id").alias("query_id"))) is None


@pytest.mark.parametrize("size", [1, 3, 300])
def test_a_sample_smaller_than_its_codes(size):
    rnd = np.random.default_rng(4)
    model = V.fit(V.unit(rnd.normal(size=(size, 20))), size)
    assert 1 <= model.probes <= len(model.means) and len(model.books) == V.SLICES
