"""Column statistics of a dataset at registration: logical types, numeric ranges, and of text columns distinct ratio and top values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pathlume.functions.normalize import col, nan_to_null
from pathlume.plans.validate import logical_type

CATEGORICAL_RATIO = 0.1
TOP_VALUES = 20
LEAST_TOP_SHARE = 0.01


def column_kinds(df: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """(logical type by queryable column, Spark type by other column). Names that the engine uses itself are not queryable."""
    kinds, others = {}, {}
    for f in df.schema.fields:
        kind = None if f.name.startswith("__") else logical_type(f.dataType)
        (kinds if kind else others)[f.name] = kind or f.dataType.simpleString()
    return kinds, others


def numeric_ranges(df: DataFrame) -> DataFrame:
    """``column_name, numeric_min, numeric_max`` of INT and FLOAT columns in one pass; NaN and null count for nothing."""
    names = [n for n, k in column_kinds(df)[0].items() if k in ("INT", "FLOAT")]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, numeric_min double, numeric_max double")
    ends = nan_to_null(df.select(*(col(n) for n in names))).agg(*(x for i, n in enumerate(names) for x in (F.min(col(n)).cast("double").alias(f"lo{i}"), F.max(col(n)).cast("double").alias(f"hi{i}"))))
    rows = F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"lo{i}").alias("numeric_min"), F.col(f"hi{i}").alias("numeric_max")) for i, n in enumerate(names)))
    return ends.select(F.explode(rows).alias("x")).select("x.*")


def value_counts(df: DataFrame) -> DataFrame:
    """``column_name, value, n`` of all text columns, nulls included: one shuffle of partial counts for all of them."""
    names = [n for n, k in column_kinds(df)[0].items() if k == "STRING"]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n bigint")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), col(n).cast("string").alias("value")) for n in names)))
    return df.select(pairs.alias("x")).select("x.*").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def text_profile(counts: DataFrame) -> DataFrame:
    """``column_name, n_rows, n_distinct, cat_unique_ratio, categorical`` from ``value_counts``. Categorical: at least one value and at most
    a tenth as many distinct values as rows."""
    per_column = counts.groupBy("column_name").agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"))
    ratio = F.col("n_distinct") / F.col("n_rows")
    return per_column.withColumn("cat_unique_ratio", ratio).withColumn("categorical", (F.col("n_distinct") > 0) & (ratio <= CATEGORICAL_RATIO))


def top_values(counts: DataFrame, top: int = TOP_VALUES, least_share: float = LEAST_TOP_SHARE) -> DataFrame:
    """``column_name, value, share``: the commonest values of each column, as shares of its non-null values; ties by value."""
    some = counts.filter(F.col("value").isNotNull())
    totals = some.groupBy("column_name").agg(F.sum("n").alias("total"))
    best = W.partitionBy("column_name").orderBy(F.col("n").desc(), "value")
    ranked = some.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "column_name").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= least_share).select("column_name", "value", "share")


def groups_in_many_parts(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that occur in more than one part, with the number of parts. Null groups are none."""
    pairs = df.filter(col(group).isNotNull()).select(col(group), col(part).alias("__part")).groupBy(col(group), "__part").agg(F.lit(1).alias("__one"))
    return pairs.groupBy(col(group)).agg(F.count(F.lit(1)).alias("n_parts")).filter(F.col("n_parts") > 1)
