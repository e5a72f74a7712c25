import pytest
from pyspark.sql import functions as F

from pathlume.operators.hot_keys import Measure, heavy_keys, salted_aggregate

def measures():
    return [Measure("n", "count"), Measure("some", "count", F.col("v")), Measure("big", "count_if", F.col("v") > 5), Measure("total", "sum", F.col("v")), Measure("low", "min", F.col("v")), Measure("high", "max", F.col("v"))]


def expected(rows):
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        v = [r[1] for r in rows if r[0] == k and r[1] is not None]
        out[k] = (sum(r[0] == k for r in rows), len(v), sum(x > 5 for x in v), sum(v) if v else None, min(v, default=None), max(v, default=None))
    return out


ROWS = [("hot", i % 11) for i in range(300)] + [(f"k{i % 20}", i % 7) for i in range(100)] + [("none", None)] * 3 + [(None, 1)] * 50 + [("", 4), ("", 4)]


@pytest.mark.parametrize("salts", [1, 8])
def test_results_are_those_of_a_plain_grouping(spark, salts):
    df = spark.createDataFrame(ROWS, "k string, v long").withColumn("__salt", F.lit(1)).withColumn("n_other", F.lit("x"))
    assert heavy_keys(df, ["k"], 0.3) == [("hot",)]
    got = {r["k"]: tuple(r)[1:] for r in salted_aggregate(df, ["k"], measures(), heavy_share=0.3, salts=salts).collect()}
    assert got == expected(ROWS)


def test_hot_key_is_spread_before_it_is_merged(spark):
    df = spark.createDataFrame([("hot", i) for i in range(1000)], "k string, v long")
    plan = salted_aggregate(df, ["k"], [Measure("n", "count")], salts=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and plan.count("Aggregate") == 2


def test_several_keys(spark):
    df = spark.createDataFrame([("a", 1, i) for i in range(100)] + [("a", 2, 5), ("b", None, 5), ("b", 1, 7)], "x string, y int, v long")
    got = {tuple(r) for r in salted_aggregate(df, ["x", "y"], [Measure("total", "sum", F.col("v"))], heavy_share=0.5).collect()}
    assert got == {("a", 1, 4950), ("a", 2, 5), ("b", 1, 7)}


def test_empty_tables_and_wrong_arguments(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert salted_aggregate(df, ["k"], measures()).collect() == []
    for wrong in ({"heavy_share": 0}, {"salts": 0}):
        with pytest.raises(ValueError):
            salted_aggregate(df, ["k"], measures(), **wrong)
    with pytest.raises(ValueError):
        salted_aggregate(df, ["k"], [Measure("k", "count")])
