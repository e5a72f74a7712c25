"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table_path(data_dir: str, name: str) -> str:
    return f"{data_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One named table; a single Parquet file and a folder of files are read alike."""
    return spark.read.parquet(table_path(data_dir, name))


def latest_registrations(dataset_info: DataFrame) -> DataFrame:
    """The registration with the latest time of each dataset; repeated rows count once."""
    latest = W.partitionBy("dataset_name").orderBy(F.col("registered_at").desc_nulls_last(), F.col("basepath").desc_nulls_last())
    return (
        dataset_info.filter(F.col("dataset_name").isNotNull())
        .withColumn("_nth", F.row_number().over(latest))
        .filter("_nth = 1")
        .drop("_nth")
    )


def registered_keys(spark: SparkSession, data_dir: str, names: tuple[str, ...]) -> dict[str, tuple[str, str]]:
    """(group id column, timestamp column) of each named dataset. At most one row a name reaches the driver."""
    rows = (
        latest_registrations(read_table(spark, data_dir, "dataset_info"))
        .filter(F.col("dataset_name").isin(*names))
        .select("dataset_name", "group_id_column", "timestamp_column")
        .collect()
    )
    found = {r[0]: (r[1], r[2]) for r in rows}
    if missing := [n for n in names if n not in found]:
        raise ValueError(f"not registered: {', '.join(missing)}")
    return found
