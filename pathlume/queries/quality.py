"""Queries of problem 1 over the loads of the activity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlume.operators.column_profile import TableProfiles, disagreeing_records
from pathlume.sources.tables import read_table

JUDGED = {
    "shop_activity": ["eventtype", "itemid", "transactionid", "categoryid", "available", "price", "searchterm", "device"],
    "app_activity": ["rowtype", "eventtype", "eventvalue", "goalvalue", "goalid", "iscool", "appversion", "crashcode"],
}


def profiles(spark: SparkSession, data_dir: str) -> TableProfiles:
    return TableProfiles({t: read_table(spark, data_dir, t) for t in JUDGED}, JUDGED)


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Loads and columns that depart from the other loads (``data``), and recorded attributes that do not agree (``record``).

    Rows without a load number belong to no load and are no case.
    """
    of = profiles(spark, data_dir)
    keys = ["dataset_name", "load_no", "column_name"]
    data = of.departures().select(*keys).distinct().withColumn("kind", F.lit("data"))
    record = disagreeing_records(of.profiles(), read_table(spark, data_dir, "column_attributes")).withColumn("kind", F.lit("record"))
    return data.unionByName(record).filter("load_no is not null")


def p1_records(spark: SparkSession, data_dir: str) -> DataFrame:
    """The recorded attributes that do not agree with the stored rows: the cases of kind ``record``."""
    return disagreeing_records(profiles(spark, data_dir).profiles(), read_table(spark, data_dir, "column_attributes"))


def p1_profile(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows, null rate, distinct values, unique ratio and range of every judged column in every load."""
    return (
        profiles(spark, data_dir)
        .profiles()
        .filter("load_no is not null")
        .select(
            "dataset_name",
            "load_no",
            "column_name",
            "n_rows",
            "n_null",
            "n_distinct",
            F.round(F.col("n_null") / F.col("n_rows"), 9).alias("null_rate"),
            F.round(F.col("n_distinct") / F.col("n_rows"), 9).alias("unique_ratio"),
            "numeric_min",
            "numeric_max",
        )
    )


def _profile_sql() -> str:
    floats = {"transactionid", "price", "eventvalue", "goalvalue"}
    numbers = floats | {"itemid", "goalid"}
    parts = []
    for table, columns in JUDGED.items():
        for c in columns:
            value = f"case when not isnan({c}) then {c} end" if c in floats else c
            ends = f"cast(min({value}) as double) as numeric_min, cast(max({value}) as double) as numeric_max" if c in numbers else "cast(null as double) as numeric_min, cast(null as double) as numeric_max"
            parts.append(
                f"select '{table}' as dataset_name, load_no, '{c}' as column_name, count(*) as n_rows, count(*) - count({value}) as n_null, count(distinct {value}) as n_distinct,"
                f" round((count(*) - count({value})) / count(*), 9) as null_rate, round(count(distinct {value}) / count(*), 9) as unique_ratio, {ends} from {table} where load_no is not null group by load_no"
            )
    return " union all ".join(parts)


def _records_sql() -> str:
    no_nan = lambda c: f"case when not isnan({c}) then {c} end"
    kinds = ", ".join(f"('{c}', '{'INT' if c in ('itemid', 'goalid') else 'FLOAT' if c in ('transactionid', 'price', 'eventvalue', 'goalvalue') else 'BOOL' if c in ('available', 'iscool') else 'STRING'}')" for c in dict.fromkeys(c for names in JUDGED.values() for c in names))
    far = lambda a, b: f"case when {a} is null or {b} is null then ({a} is null) <> ({b} is null) else abs({a} - {b}) > 1e-6 * greatest(abs({a}), abs({b})) end"
    return f"""
with actual as ({_profile_sql()}),
exact as (select *, n_distinct / n_rows as ratio from actual),
ranked as (select *, row_number() over (partition by dataset_name, load_no, column_name order by registered_at desc nulls last) as nth from column_attributes where dataset_name is not null and load_no is not null and column_name is not null),
latest as (select dataset_name, load_no, column_name, {no_nan('numeric_min')} as lo, {no_nan('numeric_max')} as hi, {no_nan('cat_unique_ratio')} as unique_of from ranked where nth = 1),
kinds(column_name, kind) as (values {kinds})
select e.dataset_name, e.load_no, e.column_name from exact e join latest l using (dataset_name, load_no, column_name) join kinds k using (column_name)
where (kind in ('INT', 'FLOAT') and ({far('lo', 'numeric_min')} or {far('hi', 'numeric_max')})) or (kind = 'STRING' and {far('unique_of', 'ratio')})"""


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p1_profile": p1_profile}
SQL = {"p1_profile": _profile_sql(), "p1_records": _records_sql()}
