from __future__ import annotations

import pytest

from mapquarry.sources import sinks

SCHEMA = "id long, text string, at int"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("update", [False, True])
def test_a_replayed_batch_changes_nothing(spark, tmp_path, update):
    sink = sinks.KeyedSink(spark, str(tmp_path / "t"), SCHEMA, ["id"], ["at", "text"], update)
    assert sink.read().count() == 0
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "x", 1)], SCHEMA)
    two = spark.createDataFrame([(1, "d", 0), (3, None, 5)], SCHEMA)
    want = [(1, "d", 0), (2, "c", 1), (3, None, 5)] if update else [(1, "a", 1), (2, "c", 1), (3, None, 5)]
    sink.write(one, 0)
    sink.write(two, 1)
    assert rows(sink.read()) == want
    for _ in range(2):
        sink.write(one, 0)
        sink.write(two.limit(0).unionByName(two), 1)
        assert rows(sink.read()) == want
    (tmp_path / "t" / "batch=0000000001" / "_SUCCESS").unlink()  # as if its writer had died
    assert rows(sink.read()) == rows(sink._wins(one.dropna(subset=["id"])))


def test_a_stream_that_restarts_writes_each_row_once(spark, tmp_path):
    path, check = str(tmp_path / "in"), str(tmp_path / "check")
    sink = sinks.turn_sink(spark, str(tmp_path / "turns"))

    def drain(fail=False):
        def each(batch, number):
            sink.write(sinks.turns(batch), number)
            if fail:
                raise OSError("died behind the write")

        q = spark.readStream.schema(sinks.TURNS).option("maxFilesPerTrigger", 1).parquet(path).writeStream.foreachBatch(each).option("checkpointLocation", check).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:
            assert fail and "died behind" in str(e)

    def land(*turns):
        spark.createDataFrame(turns, sinks.TURNS).coalesce(1).write.mode("append").parquet(path)

    land((7, 1, 1, "user", "first"), (7, 1, 0, "user", "no such turn"), (None, 1, 1, "user", "nobody"))
    drain(fail=True)
    drain()
    land((7, 1, 1, "user", "again"), (7, 1, 2, None, None))
    drain()
    assert rows(sink.read()) == [(7, 1, 1, "user", "first"), (7, 1, 2, "", "")]
