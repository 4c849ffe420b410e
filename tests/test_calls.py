from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from mapquarry.operators import answers, calls


def test_retries_pauses_and_halves():
    told, waits = [], []

    def flaky(texts):
        told.append(list(texts))
        if len(told) < 3 or "bad" in texts:
            raise OSError("busy " * 1000)
        return [t.upper() for t in texts]

    assert calls.tried(flaky, ["a", "b"], 6, waits.append) == [("A", 3, None), ("B", 3, None)]
    assert waits == [0.8, 0.8 * 1.8]
    waits.clear()
    got = calls.tried(flaky, ["a", "bad", "c"], 6, waits.append)
    assert [x[0] for x in got] == ["A", None, "C"] and got[0][1] == 7 and len(got[1][2]) == calls.ERROR
    assert len(waits) == 5 and max(waits) <= calls.LONGEST
    assert calls.tried(lambda t: [1], ["a", "b"], 1, waits.append)[0][:1] == (1,)  # too few answers to two, one to one


def provider(texts):
    import threading

    if any("bad" in t for t in texts):
        raise ValueError("poison")
    return [f"{len(texts)} {t} {threading.current_thread().name[:4] != 'Main'}" for t in texts]


@pytest.mark.parametrize("in_flight", [1, 4])
def test_rows_keep_their_order_and_only_bad_ones_fail(spark, in_flight):
    rows = [(k, None if k % 10 == 0 else " " if k % 10 == 1 else f"bad {k}" if k % 17 == 0 else f"t{k}", "x") for k in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, status string").coalesce(2)
    got = calls.ask(df, "text", provider, batch=8, in_flight=in_flight, attempts=2, pause=lambda s: None).collect()
    assert [r["id"] for r in got] == [r[0] for r in rows]
    for (_, text, _), r in zip(rows, got, strict=True):
        want = "SKIPPED" if not (text or "").strip() else "FAILED" if "bad" in text else "DONE"
        assert r["status"] == want and (r["error"] is not None) == (want == "FAILED")
        assert r["answer"].split()[1:] == [text, "True"] if want == "DONE" else r["answer"] is None
    assert calls.ask(df.limit(0), "text", provider).count() == 0


def test_embedding_states_settle(spark):
    cols = "id long, text string, embedding array<double>, embedding_status string, embedding_at string, embedding_error string"
    rows = [(1, "a", None, None, None, None), (2, " ", None, None, None, None), (3, "bad", None, None, None, "old"), (4, "stuck", None, "IN_PROGRESS", "then", None), (5, "done", [1.0], "DONE", "then", None), (6, "no", None, "FAILED", "then", "before")]
    embed = lambda texts: provider(texts) and calls.digest_embedding(3)(texts)
    nodes = spark.createDataFrame(rows, cols)
    once = calls.embedded(nodes, embed, F.lit("now"), attempts=1, pause=lambda s: None)
    got = {r["id"]: r for r in once.collect()}
    assert {k: (r["embedding_status"], r["embedding_at"]) for k, r in got.items()} == {1: ("DONE", "now"), 2: ("SKIPPED", "now"), 3: ("FAILED", "now"), 4: ("DONE", "now"), 5: ("DONE", "then"), 6: ("FAILED", "then")}
    assert "poison" in got[3]["embedding_error"] and got[6]["embedding_error"] == "before" and len(got[1]["embedding"]) == 3
    twice = calls.embedded(once, embed, F.lit("later"), attempts=1)
    assert sorted(map(str, twice.collect())) == sorted(map(str, got.values()))


def test_defaults_are_json():
    for call in calls.DEFAULTS:
        assert [json.loads(x) for x in calls.default(call)(["a", "b"])] == [calls.DEFAULTS[call]] * 2


def test_answers(spark):
    known = [("i1", "Roads"), ("i2", "Rivers and lakes"), ("i3", None), ("i4", "rivers")]
    cases = [
        ("continue", ["i1", "i2", "i3", "i4"], "Roads", False, 0.8), ("  ", ["i1", "i2", "i3", "i4"], "Roads", False, 0.8), ("3, 1 and 3", ["i3", "i1"], None, False, 1.0),
        ("HITL selection: item 2 of 9", ["i2"], "Rivers and lakes", False, 1.0), ("rivers", ["i4"], "rivers", False, 1.0), ("the ROADS please", ["i1"], "Roads", False, 1.0),
        ("lakes", ["i2"], "Rivers and lakes", False, 1.0), ("9", None, "9", True, 0.3), ("Format = GeoJSON ", None, "GeoJSON", False, 0.95), ("quite other", None, "quite other", True, 0.3),
        (None, ["i1", "i2", "i3", "i4"], "Roads", False, 0.8), ("1234", None, "1234", True, 0.3),
    ]
    schema = "answer string, candidates array<struct<id:string,name:string>>, confidence double"
    got = answers.resolved(spark.createDataFrame([(a, known, 0.3) for a, *_ in cases], schema)).collect()
    assert [(r["answer"], r["ids"], r["value"], r["needs_clarification"], r["new_confidence"]) for r in got] == cases
    none = answers.resolved(spark.createDataFrame([("continue", None, 0.3), ("1", [], 0.3), ("topic=x", None, 0.99)], schema)).collect()
    assert [(r["ids"], r["value"], r["needs_clarification"], r["new_confidence"]) for r in none] == [(None, "continue", True, 0.3), (None, "1", True, 0.3), (None, "x", False, 0.99)]
