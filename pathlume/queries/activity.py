"""Queries of problems 2 and 3 over the two activity tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlume.functions.normalize import col, epoch_ms, without_nan
from pathlume.operators.hot_keys import Measure, salted_aggregate
from pathlume.operators.sessions import SessionTable, local_sessions
from pathlume.sources.tables import read_table, registered_keys
from pathlume.sources.workspace import written

#: Activity tables: what brings their time to milliseconds, and the column whose total each group gets.
ACTIVITY = {"shop_activity": (1.0, "price"), "app_activity": (1000.0, "eventvalue")}
FOUND_SHARE = 0.02


def _activity(spark: SparkSession, data_dir: str) -> list[tuple[str, DataFrame, Column, Column, Column]]:
    """Name, rows, group id as text, time in milliseconds and measured value of each table."""
    keys = registered_keys(spark, data_dir, tuple(ACTIVITY))
    found = []
    for name, (scale, measured) in ACTIVITY.items():
        rows, (group, time) = read_table(spark, data_dir, name), keys[name]
        found.append((name, rows, col(group).cast("string"), epoch_ms(col(time), rows.schema[time].dataType, scale), without_nan(col(measured), rows.schema[measured].dataType)))
    return found


def groups(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per-group results of both tables: rows, rows with a valid time, first and last time, number and total of the measured values.

    All stored rows count, repeated ones too. Times below 1 are placeholders and give no first or last time.
    """
    parts = [
        rows.select(
            F.lit(name).alias("dataset_name"),
            group.alias("group_id"),
            F.when(time >= 1, time).alias("time_ms"),
            value.alias("value"),
            F.col("eventid"),
        )
        for name, rows, group, time, value in _activity(spark, data_dir)
    ]
    return salted_aggregate(
        reduce(DataFrame.unionByName, parts),
        ["dataset_name", "group_id"],
        [
            Measure("n_rows", "count"),
            Measure("n_timed", "count", F.col("time_ms")),
            Measure("first_ms", "min", F.col("time_ms")),
            Measure("last_ms", "max", F.col("time_ms")),
            Measure("n_values", "count", F.col("value")),
            Measure("total", "sum", F.col("value").cast("decimal(28,6)")),
        ],
        salt_from=["eventid", "time_ms", "value"],
    ).withColumn("total", F.round(F.col("total").cast("double"), 4))


def p2_groups(spark: SparkSession, data_dir: str) -> DataFrame:
    return groups(spark, data_dir)


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Groups with at least 2 % of their table's rows with a group id."""
    per_group = written(groups(spark, data_dir).select("dataset_name", "group_id", "n_rows"), "group-rows")
    totals = per_group.groupBy("dataset_name").agg(F.sum("n_rows").alias("total"))  # a row a table
    return per_group.join(F.broadcast(totals), "dataset_name").filter(F.col("n_rows") >= F.lit(FOUND_SHARE) * F.col("total")).select("dataset_name", "group_id")


def sessions(spark: SparkSession, data_dir: str, batches: int = 3) -> SessionTable:
    """A session table of both activity tables, fed in ``batches`` batches of successive loads; every load is in one of them."""
    tables = _activity(spark, data_dir)
    top = max((rows.agg(F.max("load_no")).first()[0] or 0) for _, rows, *_ in tables)
    bounds = [round((top + 1) * (i + 1) / batches) for i in range(batches)]
    table = SessionTable(spark)
    for i, high in enumerate(bounds):
        low = bounds[i - 1] if i else None
        chosen = (F.col("load_no") < high) if i < batches - 1 else F.lit(True)
        if low is not None:
            chosen = chosen & (F.col("load_no") >= low)
        else:
            chosen = chosen | F.col("load_no").isNull()
        table.apply(reduce(DataFrame.unionByName, [local_sessions(rows.filter(chosen), name, group, time, table.pause_ms) for name, rows, group, time, _ in tables]))
    return table


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return sessions(spark, data_dir).read().select("dataset_name", "group_id", "start_ms", "end_ms")


def p3_sessions(spark: SparkSession, data_dir: str) -> DataFrame:
    return sessions(spark, data_dir).read().withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_sessions": p3_sessions}

_KEYED = """
keyed as (
  select 'shop_activity' as dataset_name, cast(visitorid as varchar) as group_id, ts as time_ms, price as value from shop_activity
  union all
  select 'app_activity', deviceid, cast(round(case when not isnan(ts_sec) then ts_sec end * 1000) as bigint), case when not isnan(eventvalue) then eventvalue end from app_activity)
"""

_SESSIONS = f"""
with {_KEYED},
timed as (select *, lag(time_ms) over (partition by dataset_name, group_id order by time_ms) as before_ms from keyed where group_id is not null and time_ms >= 1),
cut as (select *, sum(case when before_ms is null or time_ms - before_ms > 1800000 then 1 else 0 end) over (partition by dataset_name, group_id order by time_ms rows unbounded preceding) as nth from timed)
"""

SQL = {
    "p2_found": f"with {_KEYED} select dataset_name, group_id from (select dataset_name, group_id, count(*) as n, sum(count(*)) over (partition by dataset_name) as total from keyed where group_id is not null group by 1, 2) where n >= 0.02 * total",
    "p2_groups": f"""with {_KEYED} select dataset_name, group_id, count(*) as n_rows, count(*) filter (where time_ms >= 1) as n_timed,
      min(time_ms) filter (where time_ms >= 1) as first_ms, max(time_ms) filter (where time_ms >= 1) as last_ms, count(value) as n_values,
      round(cast(sum(cast(value as decimal(28,6))) as double), 4) as total from keyed where group_id is not null group by 1, 2""",
    "p3_found": f"{_SESSIONS} select dataset_name, group_id, min(time_ms) as start_ms, max(time_ms) as end_ms from cut group by dataset_name, group_id, nth",
    "p3_sessions": f"{_SESSIONS} select dataset_name, group_id, min(time_ms) as start_ms, max(time_ms) as end_ms, count(*) as n_events, max(time_ms) - min(time_ms) as duration_ms from cut group by dataset_name, group_id, nth",
}
