"""File streams over several runs: late rows, repeated events, and state that outlives a run."""

import datetime as dt

from pyspark.sql import types as T

from cytoframe.streaming import windows as W

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])


def at(hour, minute=0):
    return dt.datetime(2026, 1, 2, hour, minute)


def test_late_rows_are_dropped_and_counted_and_state_is_kept(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    run = lambda: W.run_windows(spark, path, SCHEMA, out, f"{out}-checkpoint", time="ts", keys=["k"], value="v")
    read = lambda: sorted((r.window_start.hour, r.k, r.n, r.total) for r in spark.read.parquet(out).collect())
    put([(1, at(1, 5), "a", 1.0), (2, at(1, 50), "a", 2.0), (3, at(3, 10), "a", 4.0), (4, at(3, 20), "b", 8.0)])
    first = run()
    # The watermark is at 3:10: the hour from 1 is complete, that from 3 is open and waits in the state.
    assert first == {"read": 4, "written": 1, "late": 0, "repeated": 0} and read() == [(1, "a", 2, 3.0)]
    assert run() == {"read": 0, "written": 0, "late": 0, "repeated": 0}
    put([(5, at(1, 30), "a", 100.0), (6, at(3, 40), "a", 16.0), (7, at(6, 0), "a", 32.0)])
    second = run()
    # What came for the hour from 1 is late; the hour from 3 closes with rows of both runs.
    assert second == {"read": 3, "written": 2, "late": 1, "repeated": 0}
    assert read() == [(1, "a", 2, 3.0), (3, "a", 2, 20.0), (3, "b", 1, 8.0)]


def test_events_delivered_again_count_once(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    run = lambda: W.run_windows(spark, path, SCHEMA, out, f"{out}-checkpoint", time="ts", keys=["k"], value="v", late="3 hours", once_by=["id"])
    put([(1, at(1), "a", 1.0), (2, at(1, 10), "a", 1.0), (2, at(1, 10), "a", 1.0)])
    run()
    put([(1, at(1), "a", 1.0), (3, at(2), "a", 1.0), (4, at(9), "a", 1.0)])
    assert run()["late"] == 0
    assert sorted((r.window_start.hour, r.n) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 1)]
