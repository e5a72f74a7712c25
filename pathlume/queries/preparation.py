"""Queries of registration statistics, data preparation and job statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlume.operators import dataprep, table_profile
from pathlume.sources.tables import read_table
from pathlume.stats import completions, timing_summary

KINDS = ["click", "error", "purchase", "signup", "view"]
TEXTS = ["rowtype", "eventtype", "appversion", "crashcode"]


def profile_numeric_min_max(spark: SparkSession, data_dir: str) -> DataFrame:
    return table_profile.numeric_ranges(read_table(spark, data_dir, "app_activity"))


def _texts(spark: SparkSession, data_dir: str) -> DataFrame:
    return table_profile.value_counts(read_table(spark, data_dir, "app_activity").select(*TEXTS))


def profile_categorical(spark: SparkSession, data_dir: str) -> DataFrame:
    return table_profile.text_profile(_texts(spark, data_dir)).withColumn("cat_unique_ratio", F.round("cat_unique_ratio", 9))


def profile_top_values(spark: SparkSession, data_dir: str) -> DataFrame:
    return table_profile.top_values(_texts(spark, data_dir)).withColumn("share", F.round("share", 9))


def group_uniqueness(spark: SparkSession, data_dir: str) -> DataFrame:
    return table_profile.groups_in_many_parts(read_table(spark, data_dir, "shop_activity"), "visitorid", "filename")


def prep_repartition_assignment(spark: SparkSession, data_dir: str) -> DataFrame:
    rows = read_table(spark, data_dir, "shop_activity").filter("visitorid is not null")
    return rows.groupBy(dataprep.part_of(F.col("visitorid"), 8).alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))


def prep_pivot_first(spark: SparkSession, data_dir: str) -> DataFrame:
    return dataprep.pivot_first(read_table(spark, data_dir, "events"), "user_id", "event_type", "props", "event_id", KINDS)


def prep_enrich_join(spark: SparkSession, data_dir: str) -> DataFrame:
    items = read_table(spark, data_dir, "item_catalog")
    added = {"brand": F.col("brand"), "base_price": F.col("base_price")}
    return dataprep.enrich(read_table(spark, data_dir, "shop_activity").select("eventid", "itemid", "price", "load_no"), items, "itemid", added)


def prep_combine_first(spark: SparkSession, data_dir: str) -> DataFrame:
    seen = read_table(spark, data_dir, "shop_activity").filter("itemid is not null").groupBy("itemid").agg(F.min("categoryid").alias("categoryid"), F.count(F.lit(1)).alias("n_rows"))
    return dataprep.combine_first(read_table(spark, data_dir, "item_catalog").select("itemid", "categoryid", "brand"), seen, "itemid")


def prep_typed_columns(spark: SparkSession, data_dir: str) -> DataFrame:
    rows = read_table(spark, data_dir, "item_catalog").select("itemid", F.concat(F.lit("n"), F.col("base_price").cast("string")).alias("raw"), (F.col("itemid") % 2).cast("string").alias("flag"))
    return rows.select("itemid", F.round(dataprep.price_of(F.col("raw")), 9).alias("price"), dataprep.flag_of(F.col("flag")).alias("available"))


def stats_timing(spark: SparkSession, data_dir: str) -> DataFrame:
    found = timing_summary(read_table(spark, data_dir, "events"), "value", ["event_type"])
    return found.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("min", "mean", "max", "p25", "p50", "p75", "p95", "p99")))


def stats_completions(spark: SparkSession, data_dir: str) -> DataFrame:
    return completions(read_table(spark, data_dir, "events"), "value", 0.25)


QUERIES = {
    f.__name__: f
    for f in (
        profile_numeric_min_max,
        profile_categorical,
        profile_top_values,
        group_uniqueness,
        prep_repartition_assignment,
        prep_pivot_first,
        prep_enrich_join,
        prep_combine_first,
        prep_typed_columns,
        stats_timing,
        stats_completions,
    )
}

_NUMBERS = {"eventid": "eventid", "ts_sec": "case when not isnan(ts_sec) then ts_sec end", "eventvalue": "case when not isnan(eventvalue) then eventvalue end", "goalvalue": "case when not isnan(goalvalue) then goalvalue end", "goalid": "goalid", "load_no": "load_no"}
_COUNTS = " union all ".join(f"select '{c}' as column_name, {c} as value, count(*) as n from app_activity group by {c}" for c in TEXTS)

SQL = {
    "profile_numeric_min_max": " union all ".join(f"select '{n}' as column_name, cast(min({x}) as double) as numeric_min, cast(max({x}) as double) as numeric_max from app_activity" for n, x in _NUMBERS.items()),
    "profile_categorical": f"""select column_name, cast(sum(n) as bigint) as n_rows, count(value) as n_distinct, round(count(value) / sum(n), 9) as cat_unique_ratio,
        count(value) > 0 and count(value) / sum(n) <= 0.1 as categorical from ({_COUNTS}) group by column_name""",
    "profile_top_values": f"""with v as (select *, sum(n) over (partition by column_name) as total, row_number() over (partition by column_name order by n desc, value) as rank from ({_COUNTS}) where value is not null)
        select column_name, value, round(n / total, 9) as share from v where rank <= 20 and n / total >= 0.01""",
    "group_uniqueness": "select visitorid, count(distinct filename) as n_parts from shop_activity where visitorid is not null group by 1 having count(distinct filename) > 1",
    "prep_repartition_assignment": "select ((visitorid % 8) + 8) % 8 as part, count(*) as n_rows from shop_activity where visitorid is not null group by 1",
    "prep_pivot_first": "select user_id, " + ", ".join(f"arg_min(props, event_id) filter (where event_type = '{k}') as {k}" for k in KINDS) + " from events group by user_id",
    "prep_enrich_join": "select s.eventid, s.itemid, s.price, s.load_no, c.brand, c.base_price from shop_activity s join item_catalog c using (itemid)",
    "prep_combine_first": """select coalesce(c.itemid, s.itemid) as itemid, coalesce(c.categoryid, s.categoryid) as categoryid, c.brand, s.n_rows from item_catalog c
        full join (select itemid, min(categoryid) as categoryid, count(*) as n_rows from shop_activity where itemid is not null group by 1) s on c.itemid = s.itemid""",
    "prep_typed_columns": "select itemid, round(base_price / 1000, 9) as price, itemid % 2 = 1 as available from item_catalog",
    "stats_timing": "select event_type, count(value) as n, round(min(value), 6) as min, round(avg(value), 6) as mean, round(max(value), 6) as max, "
    + ", ".join(f"round({f'case when count(value) >= {least} then quantile_cont(value, {p}) end' if least else f'quantile_cont(value, {p})'}, 6) as {n}" for p, n, least in ((0.25, "p25", 20), (0.5, "p50", 0), (0.75, "p75", 20), (0.95, "p95", 20), (0.99, "p99", 100)))
    + " from events group by event_type",
    "stats_completions": "select ceil(value / 0.25) * 0.25 as until, count(*) as n from events where value is not null group by 1",
}
