"""Preparing raw activity for querying: repartitioning by group, long to wide, filling in, enriching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlume.functions.normalize import col


def part_of(column: Column, parts: int) -> Column:
    """The part a numeric group id belongs to: its remainder, never negative; null ids belong to none."""
    if parts < 1:
        raise ValueError("parts must be at least 1")
    return F.pmod(column, F.lit(parts))


def repartition_to(df: DataFrame, path: str, group: str, parts: int, sort_by: list[str] | None = None, max_rows_per_file: int = 0, force: bool = False) -> None:
    """Write ``df`` so that all rows of a group are in one part: files named by Spark in folders ``part=0`` ... .

    Rows within a file are sorted by ``sort_by``; parts are split into files of at most ``max_rows_per_file``. An existing target is
    an error unless ``force``. Text ids are placed by their hash.
    """
    numeric = df.schema[group].dataType.typeName() in ("byte", "short", "integer", "long")
    part = part_of(col(group) if numeric else F.xxhash64(col(group)), parts)
    placed = df.withColumn("part", part).repartition(parts, "part")
    if sort_by:
        placed = placed.sortWithinPartitions("part", *(col(c) for c in sort_by))
    writer = placed.write.mode("overwrite" if force else "errorifexists").partitionBy("part")
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(path)


def pivot_first(df: DataFrame, key: str, name: str, value: str, order: str, names: list[str]) -> DataFrame:
    """Long to wide: per key, the value of each name that comes first by ``order``. Names not listed are left out, null keys too."""
    firsts = [F.min_by(F.when(col(name) == n, col(value)), F.when((col(name) == n) & col(value).isNotNull(), col(order))).alias(n) for n in names]
    return df.filter(col(key).isNotNull() & col(name).isin(names)).groupBy(col(key)).agg(*firsts)


def combine_first(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All keys of both sides; every column from ``left`` where it has a value, else from ``right``. Keys must be unique on each side; null
    keys are left out. Columns keep the order of ``left``, then those of ``right`` alone."""
    a, b = left.filter(col(key).isNotNull()).alias("a"), right.filter(col(key).isNotNull()).alias("b")
    both = a.join(b, F.col(f"a.`{key}`") == F.col(f"b.`{key}`"), "full")
    names = [*left.columns, *(c for c in right.columns if c not in left.columns)]
    side = lambda c: [F.col(f"{s}.`{c}`") for s, d in (("a", left), ("b", right)) if c in d.columns]
    return both.select(*(F.coalesce(*side(c)).alias(c) for c in names))


def enrich(events: DataFrame, items: DataFrame, key: str, added: dict[str, Column]) -> DataFrame:
    """Events with columns computed from their item; events whose item is unknown are left out. ``added`` must not name event columns."""
    if clash := set(added) & set(events.columns):
        raise ValueError(f"events have columns {', '.join(sorted(clash))} already")
    chosen = items.select(col(key).alias("__key"), *(c.alias(n) for n, c in added.items()))
    return events.join(chosen, col(key) == F.col("__key"), "inner").drop("__key")


def price_of(text: Column) -> Column:
    """A price written as a letter and thousandths (``n552.000``), in units; null where it is not one."""
    return F.substring(text, 2, 100).try_cast("double") / F.lit(1000)


def flag_of(text: Column) -> Column:
    """A flag written as a whole number."""
    return text.try_cast("int").cast("boolean")


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
