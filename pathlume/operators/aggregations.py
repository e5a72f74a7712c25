"""Column aggregations over all rows of chosen groups.

Rows are first folded to one per group and value (with map-side combination), so that neither a group nor a value with very many rows
reaches one task whole; the folded rows are joined with the chosen groups and folded again by value. Counting groups per value is then
counting rows: no distinct count is needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pathlume.functions.normalize import col

DEFAULT_TOP = 10
RESULT = "scope string, step int, position int, column string, type string, name string, top int, key string, value double"


@dataclass(frozen=True)
class Aggregation:
    """One requested aggregation: where it applies (``scope`` query, step or end; ``step`` for funnels) and what it computes."""

    scope: str
    step: int | None
    position: int
    column: str
    type: str
    other: str | None = None
    name: str | None = None
    top: int = DEFAULT_TOP

    @property
    def per_value(self) -> bool:
        return self.type != "count"


def requested(specs: list[dict], scope: str, step: int | None = None) -> list[Aggregation]:
    """From expanded specifications."""
    return [Aggregation(scope, step, i, a["column"], a["type"], a.get("otherColumn"), a.get("name"), a.get("top", DEFAULT_TOP)) for i, a in enumerate(specs)]


def key_text(value: Column, kind: T.DataType) -> Column:
    """A value as the key of a result: True and False with capitals, whole floats with one decimal, large ones without an exponent."""
    if isinstance(kind, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        plain = F.abs(value) < 1e16
        number = value.cast("double")
        whole = F.concat(number.cast("decimal(20,0)").cast("string"), F.lit(".0"))
        fraction = F.regexp_replace(number.cast("decimal(32,10)").cast("string"), "0+$", "")
        return F.when(plain & (number == F.floor(number)), whole).when(plain & (F.abs(value) >= 1e7), fraction).otherwise(value.cast("string"))
    return value.cast("string")


def aggregate_columns(base: DataFrame, groups: DataFrame | None, group: str, wanted: list[Aggregation], holds: dict[tuple[str, int | None], Column]) -> DataFrame:
    """Results (``RESULT``) of all aggregations, from one reading of the rows.

    ``groups`` has one row per chosen group, None where all are chosen; ``holds`` tells for each (scope, step) whether a group belongs to
    it. ``base`` must have no NaN. Null values are no keys and count nothing. Of equal values the keys first in order stay within ``top``.

    A row gives one cell for each of its columns that has a value; cells are folded by group, column and key before anything is joined.
    """
    columns = list(dict.fromkeys(a.column for a in wanted))
    others = list(dict.fromkeys(a.other for a in wanted if a.other))
    cells = F.array_compact(F.array(*(F.when(col(c).isNotNull(), F.struct(F.lit(i).alias("c"), key_text(col(c), base.schema[c].dataType).alias("k"))) for i, c in enumerate(columns))))
    folded = (
        base.filter(col(group).isNotNull())
        .select(col(group).alias("__group"), *(col(o).alias(f"__o{j}") for j, o in enumerate(others)), F.explode(cells).alias("__cell"))
        .groupBy("__group", F.col("__cell.c").alias("__c"), F.col("__cell.k").alias("__k"))
        .agg(F.count(F.lit(1)).alias("__n"), *(x for j in range(len(others)) for x in (F.sum(f"__o{j}").alias(f"__sum{j}"), F.count(f"__o{j}").alias(f"__cnt{j}"))))
    )
    scopes = list(dict.fromkeys((a.scope, a.step) for a in wanted))
    if groups is None:
        joined = folded.withColumns({f"__in{i}": F.lit(True) for i in range(len(scopes))})
    else:
        joined = folded.join(groups.select(col(group).alias("__group"), *(holds[s].alias(f"__in{i}") for i, s in enumerate(scopes))), "__group")
    measures = []
    for i in range(len(scopes)):
        inside = col(f"__in{i}")
        measures += [F.sum(F.when(inside, col("__n"))).alias(f"rows{i}"), F.count_if(inside).alias(f"groups{i}")]
        for j in range(len(others)):
            measures += [F.sum(F.when(inside, col(f"__sum{j}"))).alias(f"sum{i}_{j}"), F.sum(F.when(inside, col(f"__cnt{j}"))).alias(f"cnt{i}_{j}")]
    per_value = joined.groupBy("__c", "__k").agg(*measures)
    parts = []
    if keyed := [a for a in wanted if a.per_value]:
        parts.append(_keyed(per_value, columns, keyed, scopes, others))
    if plain := [a for a in wanted if not a.per_value]:
        of = lambda a: F.coalesce(F.sum(F.when(F.col("__c") == columns.index(a.column), col(f"rows{scopes.index((a.scope, a.step))}"))), F.lit(0))
        sums = per_value.agg(*(of(a).cast("double").alias(f"v{n}") for n, a in enumerate(plain)))
        parts.append(sums.select(F.explode(F.array(*(_row(a, F.lit(None).cast("string"), col(f"v{n}"), None) for n, a in enumerate(plain)))).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def _row(a: Aggregation, key: Column, value: Column, top: int | None) -> Column:
    return F.struct(
        F.lit(a.scope).alias("scope"),
        F.lit(a.step).cast("int").alias("step"),
        F.lit(a.position).alias("position"),
        F.lit(a.column).alias("column"),
        F.lit(a.type).alias("type"),
        F.lit(a.name).cast("string").alias("name"),
        F.lit(top).cast("int").alias("top"),
        key.alias("key"),
        value.alias("value"),
    )


def _keyed(per_value: DataFrame, columns: list[str], wanted: list[Aggregation], scopes: list, others: list[str]) -> DataFrame:
    rows = []
    for a in wanted:
        i = scopes.index((a.scope, a.step))
        j = others.index(a.other) if a.other else None
        total = col(f"sum{i}_{j}").cast("double")
        value = {
            "countPerValue": lambda: col(f"rows{i}").cast("double"),  # noqa: B023
            "groupsPerValue": lambda: col(f"groups{i}").cast("double"),  # noqa: B023
            "sumPerValue": lambda: F.coalesce(total, F.lit(0.0)),  # noqa: B023
            "meanPerValue": lambda: F.when(col(f"cnt{i}_{j}") > 0, total / col(f"cnt{i}_{j}")),  # noqa: B023
        }[a.type]()
        row = _row(a, col("__k"), value, a.top)
        rows.append(F.when((col("__c") == columns.index(a.column)) & (col(f"groups{i}") > 0), row))
    long = per_value.select(F.explode(F.array(*rows)).alias("r")).filter(F.col("r").isNotNull()).select("r.*")
    best = W.partitionBy("scope", "step", "position").orderBy(F.col("value").desc_nulls_last(), F.col("key"))
    # limits come before the shuffle (window group limit): a task sees the best of each other task, not all values
    most = max(a.top for a in wanted)
    return long.withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") <= most).filter(F.col("__rank") <= F.col("top")).drop("__rank")
