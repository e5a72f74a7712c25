"""Queries of problem 5 over the feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlume.operators.schema_drift import SchemaDrift
from pathlume.sources.tables import read_table


def drift(spark: SparkSession, data_dir: str) -> SchemaDrift:
    return SchemaDrift(*(read_table(spark, data_dir, t) for t in ("part_files", "part_columns", "part_rows")))


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every change of every file against the file before it."""
    return drift(spark, data_dir).steps().select("dataset_name", "filename", "change", "old_name", "new_name")


def p5_versions(spark: SparkSession, data_dir: str) -> DataFrame:
    """Schema version and fingerprint of every file."""
    return drift(spark, data_dir).versions.select("dataset_name", "part_idx", "filename", "version", "fingerprint", F.size("columns").alias("n_columns"))


def p5_rules(spark: SparkSession, data_dir: str) -> DataFrame:
    """Where each column of each schema version goes: the column of the feed's table and the type it is cast to."""
    rules = drift(spark, data_dir).rules()
    return rules.select("dataset_name", "version", F.explode("rules").alias("r")).select("dataset_name", "version", F.col("r.source").alias("column_name"), F.col("r.target").alias("table_column"), F.col("r.logical").alias("logical"))


def p5_table(spark: SparkSession, data_dir: str) -> DataFrame:
    """All rows of all feeds, each under the columns of its feed's one table."""
    return drift(spark, data_dir).table()


def p5_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows of the one table by file, and those whose payload was whole."""
    return p5_table(spark, data_dir).groupBy("dataset_name", "filename").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("whole").alias("n_whole"))


def p5_cells(spark: SparkSession, data_dir: str) -> DataFrame:
    """The one table in long form, every value under its type."""
    return drift(spark, data_dir).cells()


def p5_failed_casts(spark: SparkSession, data_dir: str) -> DataFrame:
    """By file and column, how many values have no form under the column's type and are null for that."""
    return p5_table(spark, data_dir).select("dataset_name", "filename", F.explode("failed").alias("column_name")).groupBy("dataset_name", "filename", "column_name").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p5_found": p5_found, "p5_versions": p5_versions, "p5_rules": p5_rules, "p5_table": p5_table, "p5_rows": p5_rows, "p5_cells": p5_cells, "p5_failed_casts": p5_failed_casts}

_LOGICAL = """case when d like 'bool%' then 'BOOL' when d like 'int%' or d like 'uint%' then 'INT' when d like 'float%' or d like 'double%' then 'FLOAT'
  when d like 'object%' or d like 'str%' or d like 'category%' then 'STRING' else 'OTHER' end"""
#: Files: once each, at their least index. Columns: as recorded, and of files without records those of their whole payloads.
_FILES = "files as (select dataset_name, filename, min(part_idx) as part_idx from part_files where dataset_name is not null and filename is not null and part_idx is not null group by 1, 2)"
_VERSIONS = f"""
with {_FILES},
recorded as (select dataset_name, filename, column_name, min({_LOGICAL}) as logical from (select *, coalesce(lower(trim(dtype_name)), '') as d from part_columns
  where dataset_name is not null and filename is not null and column_name is not null) group by 1, 2, 3),
payloads as (select dataset_name, filename, payload from part_rows where dataset_name is not null and filename is not null and json_valid(payload) and json_type(payload) = 'OBJECT'),
keyed as (select dataset_name, filename, unnest(json_keys(payload)) as column_name, payload from payloads),
typed as (select dataset_name, filename, column_name, json_type(payload, '$."' || column_name || '"') as t from keyed),
kinds as (select dataset_name, filename, column_name, case when t in ('BIGINT', 'UBIGINT', 'HUGEINT') then 'INT' when t = 'DOUBLE' then 'FLOAT' when t = 'BOOLEAN' then 'BOOL' when t = 'VARCHAR' then 'STRING' else 'OTHER' end as kind, count(*) as n
  from typed where t <> 'NULL' group by 1, 2, 3, 4),
seen as (select dataset_name, filename, column_name, case when bool_and(kind in ('INT', 'FLOAT')) then case when bool_or(kind = 'FLOAT') then 'FLOAT' else 'INT' end else arg_max(kind, (n, kind)) end as logical
  from kinds where (dataset_name, filename) not in (select dataset_name, filename from recorded) group by 1, 2, 3),
per_file as (select dataset_name, part_idx, filename, list({{'column_name': column_name, 'logical': logical}} order by column_name, logical) as columns
  from (select * from recorded union all select * from seen) join files using (dataset_name, filename) group by 1, 2, 3),
opened as (select *, columns is distinct from lag(columns) over (partition by dataset_name order by part_idx, filename) as opens from per_file)
select dataset_name, part_idx, filename, cast(sum(cast(opens as int)) over (partition by dataset_name order by part_idx, filename rows unbounded preceding) as int) as version,
  sha256(cast(to_json(columns) as varchar)) as fingerprint, cast(len(columns) as int) as n_columns from opened
"""

SQL = {
    "p5_versions": _VERSIONS,
    "p5_rows": f"""with {_FILES}, rows as (select distinct dataset_name, filename, row_no, payload from part_rows),
      listed as (select r.* from rows r join files f on r.dataset_name = f.dataset_name and r.filename = f.filename)
      select dataset_name, filename, count(*) as n_rows, count(*) filter (where coalesce(json_valid(payload), false) and json_type(case when json_valid(payload) then payload end) = 'OBJECT') as n_whole from listed group by 1, 2""",
}
