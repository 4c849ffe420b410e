from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mapquarry.functions import geo
from mapquarry.operators import clustered


def groups(path, box):
    """Row groups whose statistics let the box in, and all."""
    w, s, e, n = box
    hit = every = 0
    for f in glob.glob(f"{path}/*.parquet"):
        m = pq.ParquetFile(f).metadata
        at = {m.schema.column(i).name: i for i in range(m.num_columns)}
        for g in map(m.row_group, range(m.num_row_groups)):
            low = lambda c: g.column(at[c]).statistics.min  # noqa: B023, E731
            high = lambda c: g.column(at[c]).statistics.max  # noqa: B023, E731
            every += 1
            hit += low("west") <= e and high("east") >= w and low("south") <= n and high("north") >= s
    return hit, every


@pytest.fixture(scope="module")
def boxes(spark):
    k = F.col("id")
    w, s = F.pmod(F.xxhash64(k), F.lit(3500)) / 10 - 180, F.pmod(F.xxhash64(k, F.lit(1)), F.lit(1700)) / 10 - 90
    return spark.range(60_000).select(k.alias("dataset_id"), w.alias("west"), s.alias("south"), (w + k % 5).alias("east"), (s + k % 3).alias("north"))


def test_same_rows_and_fewer_row_groups(spark, boxes, tmp_path):
    near, plain = str(tmp_path / "curve"), str(tmp_path / "plain")
    clustered.write(boxes, near, 8, 1 << 15)
    boxes.repartition(8).write.option("parquet.block.size", 1 << 15).parquet(plain)
    for box, share in (((10.0, 45.0, 14.0, 48.0), 0.1), ((-80.0, 20.0, 40.0, 60.0), 0.6), ((-180.0, -90.0, 180.0, 90.0), 1)):
        want = boxes.where(geo.overlaps(*(F.col(c) for c in clustered.SIDES), box))
        got = clustered.overlapping(spark, near, box)
        assert sorted(r[0] for r in got.select("dataset_id").collect()) == sorted(r[0] for r in want.select("dataset_id").collect())
        hit, every = groups(near, box)
        assert every > 60 and hit <= share * every
        assert groups(plain, box)[0] == groups(plain, box)[1]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = clustered.overlapping(spark, near, (10.0, 45.0, 14.0, 48.0))._jdf.queryExecution().executedPlan().toString()
    assert all(f"{op}({side}," in plan for op, side in (("LessThanOrEqual", "west"), ("GreaterThanOrEqual", "east"), ("LessThanOrEqual", "south"), ("GreaterThanOrEqual", "north")))


def test_missing_sides_empty_tables_and_edges(spark, boxes, tmp_path):
    odd = spark.createDataFrame([(1, None, 0.0, 1.0, 1.0), (2, -500.0, -500.0, 500.0, 500.0), (3, 180.0, 90.0, 180.0, 90.0)], "dataset_id long, west double, south double, east double, north double")
    clustered.write(odd, str(tmp_path / "odd"))
    assert sorted(r[0] for r in clustered.overlapping(spark, str(tmp_path / "odd"), (0.0, 0.0, 180.0, 90.0)).collect()) == [2, 3]
    clustered.write(odd.limit(0), str(tmp_path / "none"))
    assert clustered.overlapping(spark, str(tmp_path / "none"), (0.0, 0.0, 1.0, 1.0)).count() == 0
    keys = odd.select("dataset_id", clustered.curve({s: F.col(s) for s in clustered.SIDES}).alias("k")).orderBy("dataset_id").collect()
    assert keys[0]["k"] is None and 0 <= keys[1]["k"] < keys[2]["k"] < 1 << 48
