import json
import os

import pytest
from pyspark.sql import functions as F

from pathlume.operators import dataprep
from pathlume.operators.sessions import SessionTable
from pathlume.stats import completions, job_statistics, metrics_table, timing_summary
from pathlume.streaming.live import running_funnel, session_sink, windowed_counts


def test_repartitioning_keeps_groups_together(spark, tmp_path):
    df = spark.createDataFrame([(i % 17 - 5, i, "x") for i in range(400)], "g long, t long, s string")
    path = str(tmp_path / "out")
    dataprep.repartition_to(df, path, "g", 4, sort_by=["g", "t"], max_rows_per_file=30)
    out = spark.read.parquet(path)
    assert out.count() == 400 and out.groupBy("g").agg(F.count_distinct("part").alias("n")).filter("n > 1").count() == 0
    assert out.filter("part != pmod(g, 4)").count() == 0
    assert out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 30
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        dataprep.repartition_to(df, path, "g", 4)
    dataprep.repartition_to(df.limit(5), path, "s", 2, force=True)
    assert spark.read.parquet(path).count() == 5


def test_pivot_combine_and_enrich(spark):
    long = spark.createDataFrame([(1, "p", "n5.000", 2), (1, "p", "n4.000", 1), (1, "q", None, 1), (1, "q", "7", 3), (2, "z", "1", 1), (None, "p", "1", 1)], "k long, name string, v string, o int")
    wide = dataprep.pivot_first(long, "k", "name", "v", "o", ["p", "q"])
    assert [tuple(r) for r in wide.collect()] == [(1, "n4.000", "7")]
    left = spark.createDataFrame([(1, "a", None), (2, None, "x"), (None, "n", "n")], "k long, s string, t string")
    right = spark.createDataFrame([(2, "b", 5), (3, "c", 6)], "k long, s string, u int")
    assert sorted(tuple(r) for r in dataprep.combine_first(left, right, "k").collect()) == [(1, "a", None, None), (2, "b", "x", 5), (3, "c", None, 6)]
    events = spark.createDataFrame([(10, 1), (11, 9), (12, None), (10, 1)], "e long, k long")
    got = dataprep.enrich(events, wide, "k", {"price": dataprep.price_of(F.col("p")), "flag": dataprep.flag_of(F.col("q"))})
    assert [tuple(r) for r in got.collect()] == [(10, 1, 0.004, True)] * 2
    with pytest.raises(ValueError):
        dataprep.enrich(events, wide, "k", {"e": F.col("p")})
    odd = spark.createDataFrame([("nx",), ("",), (None,)], "s string").select(dataprep.price_of(F.col("s")), dataprep.flag_of(F.col("s")))
    assert odd.collect() == [(None, None)] * 3
    assert dataprep.union_of([left, right]).columns == ["k", "s", "t", "u"]


def test_statistics(spark):
    few = timing_summary(spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(float("nan"),), (None,)], "x double"), "x").first()
    assert (few["n"], few["p50"], few["p95"], few["p99"]) == (5, 3.0, None, None)
    many = timing_summary(spark.range(0, 101).select(F.col("id").cast("double").alias("x")), "x").first()
    assert (many["p95"], many["p99"], many["mean"]) == (95.0, 99.0, 50.0)
    assert timing_summary(spark.createDataFrame([], "x double"), "x").first()["n"] == 0
    slots = completions(spark.createDataFrame([(0.25,), (0.26,), (0.5,), (None,)], "x double"), "x")
    assert sorted(tuple(r) for r in slots.collect()) == [(0.25, 1), (0.5, 2)]
    m = metrics_table(spark, [("t1", "scanned_rows", 5.0), ("t2", "scanned_rows", 7.0), ("t1", "scanned_groups", 2.0), ("t2", "failed", 1.0), ("t1", "from_cache", 1.0), ("t2", "from_cache", 0.0), ("t1", "load_seconds", 2.0)])
    got = job_statistics(m)
    assert (got["scannedRows"], got["scannedGroups"], got["totalTasks"], got["failedTasks"], got["cache"]) == (12, 2, 2, 1, {"diskCache": 1, "source": 1})
    assert got["timingSeconds"]["load_seconds"]["p50"] == 2.0


def stream_of(spark, tmp_path, batches, schema):
    """A stream that takes one file a batch."""
    source = tmp_path / "in"
    source.mkdir()
    names = [column.split()[0] for column in schema.split(", ")]
    for i, rows in enumerate(batches):
        file = source / f"{i}.json"
        file.write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in order of time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(source))


def ran(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_running_funnel(spark, tmp_path):
    events = stream_of(spark, tmp_path, [[("a", 1, "v"), ("b", 2, "v"), ("a", 1, "c"), (None, 1, "v"), ("b", None, "c")], [("a", 5, "c"), ("b", 3, "x")], [("a", 9, "p"), ("b", 4, "c")]], "g string, t long, k string")
    steps = [F.col("k") == k for k in "vcp"]
    ran(running_funnel(events, F.col("g"), F.col("t"), steps).writeStream.format("memory").queryName("funnel").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start())
    assert sorted(tuple(r) for r in spark.table("funnel").collect()) == [("a", 0, 1), ("a", 1, 5), ("a", 2, 9), ("b", 0, 2), ("b", 1, 4)]


def test_sessions_of_a_stream(spark, tmp_path):
    events = stream_of(spark, tmp_path, [[("a", 10), ("a", 500)], [("a", 100), ("b", 7)], [("a", 190)]], "g string, t long")
    table = SessionTable(spark, f"file://{tmp_path}/table", 100)
    ran(events.writeStream.foreachBatch(session_sink(table, "d", F.col("g"), F.col("t"))).option("checkpointLocation", str(tmp_path / "cp")).start())
    assert sorted(tuple(r)[1:] for r in table.read().collect()) == [("a", 10, 190, 3), ("a", 500, 500, 1), ("b", 7, 7, 1)]


def test_windowed_counts_drop_what_is_too_late(spark, tmp_path):
    batches = [[("2024-01-01T00:00:10", "x")], [("2024-01-01T01:00:00", "x")], [("2024-01-01T01:00:01", "x")], [("2024-01-01T00:00:20", "x")], [("2024-01-01T03:00:00", "x")], [("2024-01-01T03:00:01", "x")]]
    events = stream_of(spark, tmp_path, batches, "at timestamp, k string")
    ran(windowed_counts(events, "at", ["k"]).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start())
    assert {r["window_start"].isoformat(): r["n"] for r in spark.table("counts").collect()}["2024-01-01T00:00:00"] == 1
