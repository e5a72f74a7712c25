"""Queries of problem 4 over the two activity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlume.functions.normalize import blank_free
from pathlume.llm.frequent import frequent_items, top_items
from pathlume.sources.tables import read_table

TOP = 20


def counted_values(spark: SparkSession, data_dir: str) -> DataFrame:
    """``column_name`` (table and column) and ``item`` of the columns of problem 4."""
    shop, app = read_table(spark, data_dir, "shop_activity"), read_table(spark, data_dir, "app_activity")
    pair = lambda name, value: F.struct(F.lit(name).alias("column_name"), value.alias("item"))
    both = F.explode(F.array(pair("shop_activity.itemid", F.col("itemid").cast("string")), pair("shop_activity.searchterm", blank_free(F.col("searchterm")))))
    return shop.select(both.alias("c")).select("c.*").unionByName(app.select(pair("app_activity.crashcode", blank_free(F.col("crashcode"))).alias("c")).select("c.*"))


def _named(found: DataFrame) -> DataFrame:
    name = F.split("column_name", r"\.")
    others = [c for c in found.columns if c not in ("column_name", "share")]
    return found.select(name[0].alias("dataset_name"), name[1].alias("column_name"), *others, F.round("share", 9).alias("share"))


def p4_top(spark: SparkSession, data_dir: str) -> DataFrame:
    """Values with at least 1 % of their column's counting rows, with their counts."""
    return _named(frequent_items(counted_values(spark, data_dir), 0.01))


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return p4_top(spark, data_dir).select("dataset_name", "column_name", "item")


def p4_top_k(spark: SparkSession, data_dir: str) -> DataFrame:
    """The most frequent values of each column whatever their share."""
    return _named(top_items(counted_values(spark, data_dir), TOP))


_COUNTS = """
with v as (
  select 'shop_activity' as dataset_name, 'itemid' as column_name, cast(itemid as varchar) as item from shop_activity
  union all select 'shop_activity', 'searchterm', nullif(lower(trim(searchterm, ' \t')), '') from shop_activity
  union all select 'app_activity', 'crashcode', nullif(lower(trim(crashcode, ' \t')), '') from app_activity),
n as (select dataset_name, column_name, item, count(*) as n_rows, cast(sum(count(*)) over (partition by dataset_name, column_name) as bigint) as n_total from v where item is not null group by 1, 2, 3)
"""

QUERIES = {"p4_found": p4_found, "p4_top": p4_top, "p4_top_k": p4_top_k}
SQL = {
    "p4_found": f"{_COUNTS} select dataset_name, column_name, item from n where n_rows >= 0.01 * n_total",
    "p4_top": f"{_COUNTS} select *, round(n_rows / n_total, 9) as share from n where n_rows >= 0.01 * n_total",
    "p4_top_k": f"{_COUNTS} select *, round(n_rows / n_total, 9) as share, cast(row_number() over (partition by dataset_name, column_name order by n_rows desc, item) as int) as rank from n qualify rank <= {TOP}",
}
