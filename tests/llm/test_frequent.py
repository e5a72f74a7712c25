import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathlume.llm.frequent import buckets_for, candidate_bound, frequent_items, top_items


@pytest.mark.parametrize(("hashes", "buckets"), [(3, 4096), (1, 7), (2, 1)])
def test_frequent_values_are_exact_whatever_collides(spark, hashes, buckets):
    rng = random.Random(1)
    rows = [("c", f"v{int(rng.paretovariate(0.7))}") for _ in range(4000)] + [("d", "x")] * 99 + [("d", "y")] + [("c", None), (None, "z")]
    df = spark.createDataFrame(rows, "column_name string, item string").withColumn("n", F.lit(1))
    got = {(r["column_name"], r["item"]): (r["n_rows"], r["n_total"]) for r in frequent_items(df, 0.01, hashes, buckets).collect()}
    counts = Counter(r for r in rows if None not in r)
    totals = Counter(r[0] for r in rows if None not in r)
    assert got == {k: (n, totals[k[0]]) for k, n in counts.items() if n >= 0.01 * totals[k[0]]}
    assert ("d", "y") in got and got["d", "y"] == (1, 100)  # exactly at the threshold


def test_empty_and_null_columns_give_nothing(spark):
    df = spark.createDataFrame([("c", None)], "column_name string, item string")
    assert frequent_items(df).collect() == [] and frequent_items(df.limit(0)).collect() == []
    assert candidate_bound(0.01) == 100
    with pytest.raises(ValueError):
        frequent_items(df, 0)


def test_buckets_follow_the_share(spark):
    assert buckets_for(0.01) >= 64 / 0.01 and buckets_for(1e-4) >= 64 / 1e-4 and buckets_for(1e-12) == buckets_for(1e-13)
    df = spark.range(200_000).selectExpr("'c' as column_name", "cast(if(id < 1000, id % 20, id) as string) as item")
    got = {r["item"]: r["n_rows"] for r in frequent_items(df, 1e-4).collect()}  # 20 rows of 200,000: far more distinct values than buckets had before
    assert got == {str(i): 50 for i in range(20)}


def test_top_values_whatever_their_share(spark):
    rng = random.Random(2)
    rows = [("c", f"v{rng.randint(1, 3000)}") for _ in range(5000)] + [("few", x) for x in "aab"] + [("c", None), (None, "z"), ("none", None)]
    df = spark.createDataFrame(rows, "column_name string, item string")
    got = sorted((r["column_name"], r["rank"], r["item"], r["n_rows"]) for r in top_items(df, 7).collect())
    counts = Counter(i for c, i in rows if c == "c" and i)
    best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:7]
    assert got == [("c", i + 1, *x) for i, x in enumerate(best)] + [("few", 1, "a", 2), ("few", 2, "b", 1)]
    assert top_items(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        top_items(df, 0)


def test_other_names_and_extra_columns(spark):
    df = spark.createDataFrame([("c", "x", 1)] * 3, "`a b` string, `__h` string, n_rows int")
    assert [tuple(r) for r in frequent_items(df, 0.5, column="a b", item="__h").collect()] == [("c", "x", 3, 3, 1.0)]
    with pytest.raises(ValueError):
        frequent_items(df, 0.5, column="a b", item="n_rows")
