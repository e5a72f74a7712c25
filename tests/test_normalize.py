from pyspark.sql import functions as F

from pathlume.functions.normalize import blank_free


def test_blanks_and_case(spark):
    df = spark.createDataFrame([(" \tAb C\t ",), ("",), ("  ",), (None,), (" x",)], "s string")
    assert [r[0] for r in df.select(blank_free(F.col("s"))).collect()] == ["ab c", None, None, None, " x"]
