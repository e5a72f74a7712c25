"""Running a query over a table of activity.

1. The columns used are scanned once, NaN becomes null and the timeframe filters rows (and nothing else does: aggregations see every row of
   a matching group).
2. One aggregation by group gives every measure the relation needs - row counts and sums by condition, steps reached by sequence - for all
   conditions that the relation refers to. The relation is then a column over one row per group.
3. Summary and funnel are sums over those rows. Aggregations fold rows by group and value and join them with the matching groups.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlume.functions.normalize import EPOCH, col, nan_to_null
from pathlume.functions.predicates import COMPARISONS, NEGATED, row_predicate
from pathlume.operators.aggregations import RESULT, Aggregation, aggregate_columns, requested
from pathlume.operators.hot_keys import Measure
from pathlume.operators.sequences import DEFAULT_HEAVY_ROWS, sequence_reach
from pathlume.plans.errors import QueryProblem
from pathlume.plans.relation import fold
from pathlume.plans.validate import Checked, QueryContext, check

ROWS, STEP, MATCHES = "__rows", "__step", "__matches"


def within_timeframe(df: DataFrame, time: str, frame: dict) -> DataFrame:
    """Rows from ``from`` (included) to ``to`` (excluded). Bounds are numbers in the unit of the time column; for timestamps, text like
    ``2024-01-02 03:04:05`` or whole microseconds since 1970."""
    stamped = df.schema[time].dataType.typeName().startswith("timestamp")

    def bound(value) -> Column:
        if not stamped:
            return F.lit(value)
        if isinstance(value, str):
            return F.lit(value).cast("timestamp_ntz")
        return F.timestamp_add("MICROSECOND", F.lit(int(value)), F.lit(EPOCH))

    if frame.get("from") is not None:
        df = df.filter(col(time) >= bound(frame["from"]))
    if frame.get("to") is not None:
        df = df.filter(col(time) < bound(frame["to"]))
    return df


def _holds(measure: Column, op: str, value: object) -> Column:
    found = COMPARISONS[NEGATED.get(op, op)](measure, F.lit(value))
    return ~found if op in NEGATED else found


class CohortResult:
    """A query's results as lazy DataFrames. ``to_dict`` runs them."""

    def __init__(self, df: DataFrame, group: str, time: str, checked: Checked, heavy_rows: int | None):
        self.group, self.time, self.checked, self.heavy_rows = group, time, checked, heavy_rows
        self.query = checked.expanded.get("query", {})
        self.funnel_spec = checked.expanded.get("funnel")
        frame = checked.expanded.get("timeframe") or {}
        self.base = nan_to_null(within_timeframe(df, time, frame).select(*(col(c) for c in checked.used_columns)))

    # --- groups

    @cached_property
    def groups(self) -> DataFrame:
        """One row per group: the group id, ``__rows``, ``__matches`` and, with a funnel, ``__step`` (funnel steps reached)."""
        conditions = self.query.get("conditions", [])
        measures, sequences = [Measure(ROWS, "count")], {}
        for i in self.checked.used_conditions:
            c = conditions[i]
            if "sequence" in c:
                sequences[f"__q{i}"] = c["sequence"]
                continue
            holds = row_predicate(c)
            measures.append(Measure(f"__n{i}", "count_if", holds))
            if c["target"]["type"] == "sum":
                measures.append(Measure(f"__t{i}", "sum", F.when(holds, col(c["target"]["column"]))))
        if self.funnel_spec:
            sequences[STEP] = self.funnel_spec["sequence"]
        if sequences:
            found = sequence_reach(self.base, self.group, self.time, sequences, measures, self.heavy_rows)
        else:
            found = self.base.filter(col(self.group).isNotNull()).groupBy(col(self.group)).agg(*(m.partial() for m in measures))
        matches = F.lit(True)
        if self.checked.relation is not None:
            matches = fold(self.checked.relation, lambda i: self._matches(i, conditions[i]), Column.__and__, Column.__or__)
        kept = [col(self.group), col(ROWS), matches.alias(MATCHES)]
        return found.select(*kept, *([col(STEP)] if self.funnel_spec else []))

    def _matches(self, i: int, c: dict) -> Column:
        if "sequence" in c:
            return col(f"__q{i}") == len(c["sequence"])
        target, n = c["target"], col(f"__n{i}")
        if target["type"] == "sum":
            return (n >= 1) & _holds(F.coalesce(col(f"__t{i}"), F.lit(0)), target["op"], target["value"])
        some = (n >= 1) & _holds(n, target["op"], target["value"])
        return some | (n == 0) if c.get("includeZero") else some

    @property
    def matching(self) -> DataFrame:
        return self.groups.filter(col(MATCHES))

    def matching_groups(self) -> DataFrame:
        """Ids of the matching groups with the number of their rows as ``group_rows``."""
        return self.matching.select(col(self.group), col(ROWS).alias("group_rows"))

    def matching_rows(self) -> DataFrame:
        """All rows (columns used) of the matching groups. Where the groups are too many to broadcast, a hot group's rows are split over tasks
        by the adaptive skew join (its other side is one row)."""
        return self.base.join(self.matching.select(col(self.group)), self.group, "left_semi")

    def summary(self) -> DataFrame:
        return self.matching.agg(F.count(F.lit(1)).alias("matching_groups"), F.coalesce(F.sum(ROWS), F.lit(0)).alias("matching_group_rows"))

    # --- funnel

    def _steps(self) -> int:
        return len(self.funnel_spec["sequence"]) if self.funnel_spec else 0

    def funnel(self) -> DataFrame:
        """Per step: the groups that reached it and all their rows."""
        if not self.funnel_spec:
            raise ValueError("the query has no funnel")
        steps = range(self._steps())
        sums = self.matching.agg(
            *(F.count_if(col(STEP) > i).alias(f"g{i}") for i in steps),
            *(F.coalesce(F.sum(F.when(col(STEP) > i, col(ROWS))), F.lit(0)).alias(f"r{i}") for i in steps),
        )
        rows = F.array(*(F.struct(F.lit(i).alias("step"), col(f"g{i}").alias("matching_groups"), col(f"r{i}").alias("matching_group_rows")) for i in steps))
        return sums.select(F.explode(rows).alias("x")).select("x.*")

    # --- aggregations

    def requested(self) -> list[Aggregation]:
        wanted = requested(self.query.get("aggregations", []), "query")
        if self.funnel_spec:
            for i in range(self._steps()):
                wanted += requested(self.funnel_spec.get("stepAggregations", []), "step", i)
            wanted += requested(self.funnel_spec.get("endAggregations", []), "end")
        return wanted

    def aggregations(self) -> DataFrame:
        """All aggregations in long form: ``scope, step, position, column, type, name, top, key, value``."""
        wanted = self.requested()
        if not wanted:
            return self.base.sparkSession.createDataFrame([], RESULT)
        holds: dict[tuple[str, int | None], Column] = {("query", None): F.lit(True), ("end", None): col(STEP) == self._steps()}
        holds |= {("step", i): col(STEP) > i for i in range(self._steps())}
        everyone = self.checked.relation is None and not self.funnel_spec
        return aggregate_columns(self.base, None if everyone else self.matching, self.group, wanted, holds)

    def scanned(self) -> DataFrame:
        """One row: ``scanned_rows`` within the timeframe and ``scanned_groups`` they belong to, matching or not."""
        rows = self.base.groupBy(col(self.group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned_rows"), F.count("g").alias("scanned_groups"))

    # --- results

    @contextmanager
    def kept(self):
        """Keep the per-group rows while several results are taken from them."""
        self.groups.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield self
        finally:
            self.groups.unpersist()

    def to_dict(self) -> dict:
        """The result document: counts, aggregations and the funnel's steps. Its size is bounded by steps, aggregations and their top."""
        wanted = self.requested()
        with self.kept():
            summary = self.summary().first()
            steps = {r["step"]: r for r in self.funnel().collect()} if self.funnel_spec else {}
            values = self.aggregations().collect() if wanted else []

        def found(a: Aggregation) -> dict:
            mine = [r for r in values if (r["scope"], r["step"], r["position"]) == (a.scope, a.step, a.position)]
            exact = a.type in ("count", "countPerValue", "groupsPerValue")
            of = lambda v: int(v) if exact and v is not None else v
            out = {"column": a.column, "type": a.type}
            if a.per_value:
                ordered = sorted(mine, key=lambda r: (r["value"] is None, -(r["value"] or 0), r["key"]))
                out |= {"value": {r["key"]: of(r["value"]) for r in ordered}, "top": a.top}
            else:
                out["value"] = of(mine[0]["value"]) if mine else 0
            return out | ({"name": a.name} if a.name else {})

        def block(groups: int, rows: int, scope: str, step: int | None) -> dict:
            own = [found(a) for a in wanted if (a.scope, a.step) == (scope, step)]
            return {"matchingGroups": groups, "matchingGroupRows": rows} | ({"aggregations": own} if own else {})

        out = {"query": block(summary["matching_groups"], summary["matching_group_rows"], "query", None)}
        if self.funnel_spec:
            out["funnel"] = {"sequence": [block(steps[i]["matching_groups"], steps[i]["matching_group_rows"], "step", i) for i in range(self._steps())]}
            if end := [found(a) for a in wanted if a.scope == "end"]:
                out["funnel"]["endAggregations"] = end
        return out


class CohortEngine:
    """Runs queries over any DataFrame with a group id and a time column (numeric or timestamp)."""

    def __init__(self, group_id_column: str, timestamp_column: str, heavy_rows: int | None = DEFAULT_HEAVY_ROWS):
        self.group_id_column, self.timestamp_column, self.heavy_rows = group_id_column, timestamp_column, heavy_rows

    def run(self, df: DataFrame, query: dict, context: QueryContext | None = None) -> CohortResult:
        """Raises ``QueryProblem`` for a query that does not fit the table."""
        checked = check(query, context or QueryContext.of(df.schema, self.group_id_column, self.timestamp_column))
        if not checked.success:
            raise checked.problem
        return CohortResult(df, self.group_id_column, self.timestamp_column, checked, self.heavy_rows)


__all__ = ["CohortEngine", "CohortResult", "QueryProblem"]
