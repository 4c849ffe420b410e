"""Runs a query and its SQL in both engines and compares rows, whatever their order."""

from __future__ import annotations

import glob
import os

import duckdb


def _row(r):
    return tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)


def assert_same(spark, sf_dir: str, run, sql: str) -> int:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(map(_row, df.select(*cols).collect()))
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(_row([r[i] for i in at]) for r in cur.fetchall())
    return len(got)
