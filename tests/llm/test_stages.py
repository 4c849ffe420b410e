"""The pipeline's stages on empty tables, null ids and texts, repeated rows and extra columns; a slow scorer for quality."""

from __future__ import annotations

import math

import numpy as np
import pytest

import corpus_pipeline as cp
from mapquarry.llm import langid, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text_ string, row_key long"
EN = "the story of the town and of the river is that it was there for all who came to it"
DE = "die geschichte der stadt und des flusses ist dass er für alle da war die zu ihm kamen"


def table(spark, rows):
    return spark.createDataFrame([(d, t, g, s, len(t or ""), "x", 7) for d, t, g, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    out = [(k, f"{(EN, DE)[k % 2]} {'abcdefghij'[k % 10]}{k}", ("en", "de")[k % 2], ("a", "b", None)[k % 3]) for k in range(120)]
    return [*out, (None, EN + " null id", "en", "a"), (None, None, None, None), (5, None, "en", None), (6, "", "en", "a"), (7, "1234 ...", "de", "b"), (3, out[3][1], "de", "a")]


def test_language(spark, rows):
    got = cp.language(spark, table(spark, rows), "")
    assert got.columns == cp.COLUMNS
    kept = [tuple(r)[:2] for r in got.collect()]
    assert (None, EN + " null id") in kept and kept.count((3, rows[3][1])) == 2
    assert not {t for _, t in kept} & {None, "", "1234 ..."}
    none = table(spark, rows).limit(0)
    assert cp.language(spark, none, "").count() == 0
    model = langid.train(none, cp.residue(4) != 2)
    odd = table(spark, rows).limit(3).withColumn("LANG_PRED", cp.F.lit("x")).withColumn("Lang_Score", cp.F.lit(1))
    assert langid.identify(odd.limit(0), model).count() == 0
    assert [c for c in langid.identify(odd, model).select("lang_pred", "lang_score").columns] == ["lang_pred", "lang_score"]


def test_mix(spark, rows):
    got = cp.mix(spark, table(spark, rows), "")
    assert got.columns == cp.COLUMNS
    texts = {t for _, t, _, _ in rows}
    assert {r["text"] for r in got.collect()} <= texts and got.count() > 60
    assert cp.mix(spark, table(spark, rows).limit(0), "").count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, cp.mix(spark, table(spark, rows[::-1]), "").collect()))


def test_pack(spark, rows):
    got = cp.pack(spark, table(spark, rows), "").collect()
    assert sum(r["start"] == 0 for r in got) == len(rows)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert cp.pack(spark, table(spark, rows).limit(0), "").count() == 0


def test_quality_scores_equal_a_slow_scorer(spark, rows):
    """Each text by itself: its features' standardised values, weighed and summed one by one, through the logistic function."""
    docs = table(spark, rows)
    labels = docs.where("doc_id is not null").select("doc_id", (cp.F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    model = quality.train(docs, labels, cp.F.col("doc_id") % 5 != 0)
    got = sorted((str(r["doc_id"]), round(r["score"], 5), r["predicted"]) for r in quality.score(docs, model).collect())

    def slow(text):
        z = float(model.bias)
        for x, m, s, w in zip(quality.features(text).tolist(), model.mean.tolist(), model.scale.tolist(), model.weights.tolist(), strict=True):
            z += w * ((x - m) / s)
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    want = sorted((str(d), slow(t), int(slow(t) >= quality.THRESHOLD)) for d, t, _, _ in rows)
    assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want]
    assert all(abs(g[1] - w[1]) < 1e-3 for g, w in zip(got, want, strict=True))
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_training_equals_a_slow_trainer():
    """The same batches and steps, row by row and weight by weight."""
    rnd = np.random.default_rng(1)
    p, u, prior, epochs, seed = rnd.normal(0.5, 1, (25, 4)).astype(np.float32), rnd.normal(0, 1, (40, 4)).astype(np.float32), 0.4, 6, 5
    model = quality.fit(p, u, prior, epochs, seed)
    n, size = len(p) + len(u), p.shape[1]
    every = [*p.tolist(), *u.tolist()]
    mean = [sum(r[j] for r in every) / n for j in range(size)]
    scale = [math.sqrt(sum((r[j] - mean[j]) ** 2 for r in every) / n) + 0.02 for j in range(size)]
    std = lambda rows: [[(r[j] - mean[j]) / scale[j] for j in range(size)] for r in rows]
    ps, us = std(p.tolist()), std(u.tolist())
    rng, w, m, v, step = np.random.default_rng(seed), [0.0] * (size + 1), [0.0] * (size + 1), [0.0] * (size + 1), 0
    for epoch in range(epochs):
        order = rng.permutation(len(us))
        for k in range(0, len(us), 512):
            xu = [us[i] for i in order[k : k + 512]]
            xp = [ps[i] for i in rng.integers(len(ps), size=max(1, min(len(ps), 512)))]
            z = lambda r: sum(a * b for a, b in zip(r, w[:-1], strict=True)) + w[-1]  # noqa: B023, E731
            sig = lambda r: 1 / (1 + math.exp(-z(r)))  # noqa: B023, E731
            loss = lambda r: math.log1p(math.exp(z(r)))  # noqa: B023, E731
            negative = sum(map(loss, xu)) / len(xu) - prior * sum(map(loss, xp)) / len(xp)
            g = []
            for j in range(size + 1):
                x = lambda r: r[j] if j < size else 1.0  # noqa: B023, E731
                d_neg = sum(x(r) * sig(r) for r in xu) / len(xu) - prior * sum(x(r) * sig(r) for r in xp) / len(xp)
                d_pos = prior * sum(x(r) * (sig(r) - 1) for r in xp) / len(xp)
                g.append((d_pos + d_neg if negative >= 0 else -d_neg) + (1e-5 * w[j] if j < size else 0))
            step += 1
            for j in range(size + 1):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g[j], 0.999 * v[j] + 0.001 * g[j] ** 2
                w[j] -= 0.05 * (1 - epoch / epochs) * (m[j] / (1 - 0.9**step)) / (math.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(model.weights, w[:-1], atol=1e-3) and abs(model.bias - w[-1]) < 1e-3
