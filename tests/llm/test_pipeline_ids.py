"""Null and repeated doc_ids in the pipeline's exact and near stages."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text):
    return (i, text, "en", "s", len(text))


@pytest.mark.parametrize("scan", [False, True])
def test_exact_keeps_one_row_of_each_group(spark, scan, tmp_path):
    import corpus_pipeline as cp

    rows = [row(None, "only here"), row(None, "another text"), row(1, "same text"), row(1, "same text"), row(2, "kept by itself"), row(2, "sametext")]
    rows += [row(None, "twice without id"), row(None, "twice without id"), row(3, "with id"), row(None, "with id"), row(4, "a b"), row(3, "ab ")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    if scan:
        df.write.parquet(str(tmp_path / "docs"))
        df = spark.read.parquet(str(tmp_path / "docs"))
    got = sorted((r.doc_id or 0, r.text) for r in cp.exact(spark, df, "").collect())
    want = [(0, "another text"), (0, "only here"), (0, "twice without id"), (1, "same text"), (2, "kept by itself"), (3, "ab "), (3, "with id")]
    assert got == want
    assert cp.exact(spark, df.limit(0), "").count() == 0


def test_near_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as cp

    one, two, three = (" ".join(f"{k}{i}" for i in range(90)) for k in "abc")
    rows = [row(None, one), row(None, one + " end"), row(7, two), row(7, two + " end"), row(8, three), row(7, three + " end"), row(None, three), row(None, "lone words")]
    got = sorted((r.doc_id or 0, r.text) for r in cp.near(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect())
    assert len(got) == 4 and got[0][0] == 0 and got[0][1] in (one, one + " end")
    assert got[1] == (0, "lone words") and got[2][0] == 7 and got[2][1] in (two, two + " end") and got[3] == (7, three + " end")
    assert cp.near(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
