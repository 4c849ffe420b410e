from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mapquarry.operators import evaluate, lexical, providers, sessions, tables, topics
from mapquarry.operators import retrieve as R
from mapquarry.operators.components import components
from mapquarry.plans import discover as D
from mapquarry.plans.catalog import Catalog
from mapquarry.streaming import durations


def test_ties_and_ranges(spark):
    rows = spark.createDataFrame([(i, float(i // 2)) for i in range(10)], "id long, score double")
    assert R.top_with_ties(rows, 3).count() == 4 and R.top_with_ties(rows, 50).count() == 10 and R.top_with_ties(rows.limit(0), 3).count() == 0
    space = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 30.0), (2, 30.0, 0.0, 40.0, 5.0), (3, -9.0, -9.0, -8.0, -8.0)], "dataset_id long, west double, south double, east double, north double")
    boxes = spark.createDataFrame([(7, 10.0, 1.0, 30.0, 50.0)], "query_id long, qw double, qs double, qe double, qn double")
    assert {r.dataset_id for r in R.range_join(boxes, space, 7.0).collect()} == {1, 2}


def test_portals_and_parameters():
    ids = {"a": "1", "b": "2"}
    assert R.portal_sources(None) is None and R.portal_sources({"a": True, "b": True}, ids) is None and R.portal_sources({"a": True, "b": False}, ids) == ["1"] and R.portal_sources({"a": True, "z": True}, ids) == ["1"]
    with pytest.raises(ValueError):
        R.portal_sources({"a": False})
    with pytest.raises(ValueError):
        D.Parameters(similarity=0.1).check()
    assert D.Parameters(weights={"Topic": 0.0}).normalised() == D.WEIGHTS


def test_discover_variants(spark, sf):
    c = Catalog(spark, sf)
    got = D.discover(c, D.Intent({"Topic": "red", "License": "urgent", "Format": "r-f", "Organization": "supplier"}, sources=["ASIA", "EUROPE"]), top=5)
    assert got.count() >= 5 and got.agg({"score": "max"}).first()[0] <= 1.0
    assert D.discover(c, D.Intent()).count() == 0
    assert D.discover(c, D.Intent(box=(-80.0, 20.0, 40.0, 60.0))).count() >= 20


def test_groups_don_t_depend_on_order(spark):
    rows = [(f"t{i}", f"k{j}") for i in range(12) for j in (i // 3, i // 4 + 100)]
    a = topics.groups(spark.createDataFrame(rows, "id string, key string"))
    b = topics.groups(spark.createDataFrame(rows[::-1], "id string, key string"))
    assert sorted(a.collect()) == sorted(b.collect()) and {r.group for r in a.collect()} == {"t0"}


def test_redirects_and_merges(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x"), ("p", "q"), ("q", "p")], "src string, dst string")
    got = {r.src: r.dst for r in topics.redirects(m).collect()}
    assert got["a"] == "c" and got["b"] == "c" and "x" not in got
    once = topics.apply_merges(spark.createDataFrame([(1, "a"), (1, "c")], "dataset_id long, entity_id string"), topics.redirects(m))
    assert [tuple(r) for r in once.collect()] == [(1, "c")]


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id long, v string")
    assert {tuple(r) for r in tables.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, None), (3, "c")}
    assert {tuple(r) for r in tables.upsert(old, new, ["id"], ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in tables.insert_missing(old, new, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in tables.changed(old, new, "id", "v").collect()} == {(1, "a"), (2, None)}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 1)], "query_id long, rank int, rel int")
    pool = spark.createDataFrame([(1, 1, 1), (1, 0, 9), (2, 2, 1), (2, 1, 3), (3, 1, 2), (4, 0, 5)], "query_id long, rel int, n long")
    got = {r.query_id: r.ndcg for r in evaluate.ndcg(ranked, pool, 3).collect()}
    assert got == {1: pytest.approx(0.63093, abs=1e-5), 2: pytest.approx(1 / (3 + 0.63093 + 0.5), abs=1e-5), 3: 0.0, 4: 0.0}
    total = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "query_id long, total long")
    assert {r.query_id: r.recall for r in evaluate.recall(ranked, total).collect()} == {1: 0.5, 2: 1.0, 3: 0.0}
    res = spark.createDataFrame([(1, "Topic", "a", "a"), (1, "Time", None, None), (2, "Topic", "a", "b")], "query_id long, dim string, got string, want string")
    assert evaluate.exact_intent_match(res).first().eimr == 0.5


def test_providers(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, text string")

    def odd(texts):
        if "t3" in texts:
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    got = {r.id: r.a for r in providers.answer(rows.coalesce(1), "text", "a", odd, batch=2).collect()}
    assert got == {0: "T0", 1: "T1", 2: None, 3: None, 4: "T4"}
    st = providers.embedding_states(spark.createDataFrame([(1, "x"), (2, " "), (3, "y")], "id long, text string"), "text", spark.createDataFrame([(1,)], "id long"))
    assert {r.id: r.embedding_status for r in st.collect()} == {1: "DONE", 2: "SKIPPED", 3: "FAILED"}


def test_visible(spark):
    rows = spark.createDataFrame([(1, "me", False, False), (2, "you", True, False), (3, "me", True, True)], "id long, api_key string, shareable boolean, deleted boolean")
    assert {r.id for r in sessions.visible(rows, "me").collect()} == {1, 2}


def test_stream_over_several_batches_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    rows = e.collect()
    for k in range(0, len(rows), 300):
        spark.createDataFrame(rows[k : k + 300], e.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:06d}"))
    source = spark.readStream.schema(durations.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = durations.stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(durations.OUT).parquet(str(tmp_path / "out"))
    want = sessions.durations(sessions.status_feed(e))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_turn_index_of_a_conversation_without_turns(spark):
    turns = spark.createDataFrame([(1, 0), (1, 1), (2, 4)], "conv_id long, turn long")
    known = spark.createDataFrame([(1,), (2,), (3,)], "conv_id long")
    assert {tuple(r) for r in sessions.next_index(turns, known).collect()} == {(1, 2), (2, 5), (3, 0)}


def test_components(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "x"), ("a", "b"), (None, "q")], "a string, b string")
    got = {tuple(r) for r in components(edges).collect()}
    assert got == {(f"n{i:03}", "n000") for i in range(1, 61)} | {("b", "a")} and components(edges.limit(0)).count() == 0


def test_similar_names_equal_brute_force(spark):
    rng = random.Random(1)
    name = lambda: " ".join(sorted({rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))}))
    left, right = sorted({name() for _ in range(80)}), sorted({name() for _ in range(80)})
    want = {(a, b) for a in left for b in right if 5 * len(set(a.split()) & set(b.split())) >= 3 * len(set(a.split()) | set(b.split()))}
    got = topics.similar(spark.createDataFrame([(x,) for x in left], "canonical string"), spark.createDataFrame([(x,) for x in right], "topic string"))
    assert {(r.canonical, r.topic) for r in got.collect()} == want and len(want) > 20


def test_blocks_of_queries_meet_every_row(spark):
    asked, rows = spark.range(25).withColumnRenamed("id", "q"), spark.range(40).withColumnRenamed("id", "r")
    for most in (100, 7):
        got = [tuple(r) for r in R.in_blocks(asked, rows, "q", "r", most).select("q", "r").collect()]
        assert len(got) == len(set(got)) == 1000


def test_range_join_of_crowded_cells(spark, monkeypatch):
    rng = random.Random(3)
    box = lambda i: (i, rng.uniform(-180, 170), rng.uniform(-90, 80))
    spaces = [(i, w, s, w + rng.uniform(0, 10), s + rng.uniform(0, 10)) for i, w, s in map(box, range(300))] + [(300 + i, 5.0, 5.0, 6.0, 6.0) for i in range(50)]
    asked = [(i, w, s, w + 15, s + 15) for i, w, s in map(box, range(40))] + [(99, 0.0, 0.0, 20.0, 20.0)]
    want = {(q, d) for q, a, b, x, y in asked for d, w, s, e, n in spaces if w <= x and e >= a and s <= y and n >= b}
    monkeypatch.setattr(R, "CELL_ROWS", 8)
    got = R.range_join(spark.createDataFrame(asked, "query_id long, qw double, qs double, qe double, qn double"), spark.createDataFrame(spaces, "dataset_id long, west double, south double, east double, north double"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_pruned_search_equals_plain_scores(spark):
    """Stop words in every text: pruning never changes the best documents."""
    rng = random.Random(9)
    vocabulary = ["the", "of", "and"] * 30 + [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(400)] + [(900, None), (901, "!?")]
    asked = [(i, "The of, and " + " ".join(rng.choice(vocabulary) for _ in range(8))) for i in range(30)] + [(77, "unknownword"), (78, "the")]
    tf = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in docs}
    tf = {i: c for i, c in tf.items() if c}
    mean, df = sum(c.total() for c in tf.values()) / len(tf), Counter(t for c in tf.values() for t in c)
    got = lexical.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"), 5).collect()
    for q, text in asked:
        scores = {}
        for t in set(re.findall("[a-z0-9]+", text.lower())) & set(df):
            for i, c in tf.items():
                if c[t]:
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(tf) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean))
        want = sorted(((-round(v, 6), i) for i, v in scores.items()))[:5]
        assert sorted((-r.score, r.doc_id) for r in got if r.query_id == q) == [(pytest.approx(s), i) for s, i in want]


@pytest.mark.parametrize("most", [200_000, 0])
def test_tokens_are_counted_where_they_are_read(spark, monkeypatch, most):
    """Few asked terms need no shuffle to count a text's tokens; many are joined and find the same."""
    plans, write = [], lexical.materialise
    monkeypatch.setattr(lexical, "materialise", lambda df: plans.append(df) or write(df))
    monkeypatch.setattr(lexical, "VOCABULARY", most)
    docs = spark.createDataFrame([("a", "x x y"), ("b", "y z z z"), ("c", ""), ("d", None), ("e", "q q")], "doc_id string, text string")
    got = lexical.bm25(docs, spark.createDataFrame([(1, "x, y!"), (2, "z")], "query_id long, text string"), 5).collect()
    assert [(r.query_id, r.doc_id) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(1, "a"), (1, "b"), (2, "b")]
    counted = next(df for df in plans if "tf" in df.columns)
    assert {(r.doc_id, r.term, r.tf, r.n) for r in counted.collect()} == {("a", "x", 2, 3), ("a", "y", 1, 3), ("b", "y", 1, 4), ("b", "z", 3, 4)}
    assert not most or "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_embedded_candidates_and_fallbacks(spark, sf):
    nodes = spark.createDataFrame([("a", "red", [1.0, 0.0]), ("b", "blue", [0.9, 0.1]), ("c", "green", [-1.0, 0.0]), ("d", "none", None)], "id string, name string, embedding array<double>")
    assert {r.id for r in D.candidates(nodes, "red", 0.5).collect()} == {"a"}
    assert {r.id for r in D.candidates(nodes, "red", 0.5, "Topic", [1.0, 0.0]).collect()} == {"a", "b"}
    assert {r.id for r in R.vector_candidates(nodes, [1.0, 0.0], 9, -1.5, "exact").collect()} == {"a", "b", "c"}
    c = Catalog(spark, sf)
    assert D.discover(c, D.Intent({"Topic": "no such text"})).count() == 0


def test_one_execution_of_the_expansions(spark, sf):
    """The ranked plan reads written sums, not the graph again."""
    plan = D.discover(Catalog(spark, sf), D.FLAGSHIP)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_custkey" not in plan


def test_rows_per_group_are_cut_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as g", "id")
    plan = R.top_per_group(df, "g", 2, F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") >= 0 and "Partial" in plan


def test_helper_columns_keep_clear_of_like_named_ones(spark):
    rows = spark.createDataFrame([(1, 3.0, "a", "b", "c", "d", "e"), (2, 1.0, "f", "g", "h", "i", "j")], "id long, score double, _key string, _BLOCK string, _to string, _share string, _new string")
    from mapquarry.operators import retrieve, tables

    assert [tuple(r) for r in retrieve.top_with_ties(rows, 1).collect()] == [tuple(rows.where("id = 1").first())]
    asked = spark.createDataFrame([(7, "x")], "q long, _block_ string")
    got = retrieve.in_blocks(asked, rows, "q", "id")
    assert got.count() == 2 and set(got.columns) == set(rows.columns) | {"q", "_block_"}
    done = tables.changed(rows, spark.createDataFrame([(1, "z")], "id long, _to string"), "id", "_to")
    assert sorted((r["id"], r["_to"]) for r in done.collect()) == [(1, "z"), (2, "h")] and done.columns == rows.columns
    up = tables.upsert(rows.select("id", "_new"), spark.createDataFrame([(2, "new")], "id long, _new string"), ["id"])
    assert sorted(map(tuple, up.collect())) == [(1, "e"), (2, "new")]
