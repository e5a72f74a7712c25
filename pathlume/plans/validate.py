"""From a query document to a checked and fully expanded one."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.sql import types as T

from pathlume.plans import paths
from pathlume.plans.errors import ProblemKind, QueryProblem, schema_problem
from pathlume.plans.relation import Relation, conditions_in, parse_relation, simple_relation
from pathlume.plans.shape import BOOLEAN_OPERATORS, DEFAULT_AGGREGATIONS, IDENTIFIER, NUMERIC_OPERATORS, RELATION_WORDS, STRING_OPERATORS, TYPES_OF_OTHER_COLUMN, check_query, is_int, is_number

AGGREGATION_PATHS = ("query.aggregations", "funnel.stepAggregations", "funnel.endAggregations")
FILTER_PATHS = ("query.conditions.filter", "query.conditions.sequence.filter", "funnel.sequence.filter")
FILTERS_PATHS = ("query.conditions.filters", "query.conditions.sequence.filters", "funnel.sequence.filters")
IGNORED_PATHS = ("query.conditions.maxDuration", "query.conditions.sequence.rowFound", "funnel.maxDuration", "funnel.sequence.rowFound")
DEFAULT_TARGET = {"type": "count", "op": ">=", "value": 1}
DEFAULT_RELATION = "and"

OPERATORS_OF = {"INT": NUMERIC_OPERATORS, "FLOAT": NUMERIC_OPERATORS, "BOOL": BOOLEAN_OPERATORS, "STRING": STRING_OPERATORS}


@dataclass(frozen=True)
class QueryContext:
    """What a query is checked against: logical types by column, the key columns, and the span of times where known."""

    columns: dict[str, str]
    group_id_column: str
    timestamp_column: str
    min_timestamp: float | None = None
    max_timestamp: float | None = None

    @staticmethod
    def of(schema: T.StructType, group_id_column: str, timestamp_column: str, **span) -> QueryContext:
        return QueryContext({f.name: k for f in schema.fields if (k := logical_type(f.dataType))}, group_id_column, timestamp_column, **span)


def logical_type(kind: T.DataType) -> str | None:
    """INT, FLOAT, BOOL or STRING; None for types that cannot be queried."""
    if isinstance(kind, T.BooleanType):
        return "BOOL"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    return "STRING" if isinstance(kind, (T.StringType, T.NullType)) else None


@dataclass
class Checked:
    """The outcome: the expanded query with what it uses, or the problem found."""

    success: bool
    source: object
    expanded: dict | None = None
    problem: QueryProblem | None = None
    used_columns: list[str] = field(default_factory=list)
    used_conditions: list[int] = field(default_factory=list)
    condition_names: dict[str, int] = field(default_factory=dict)
    relation: Relation | None = None
    warnings: list[str] = field(default_factory=list)

    @property
    def error_kind(self) -> ProblemKind | None:
        return self.problem.kind if self.problem else None

    @property
    def error_message(self) -> str | None:
        return self.problem.message if self.problem else None

    def differences(self) -> list[tuple[str, object, object]]:
        """Where the expanded query is not the one given."""
        return paths.differences(self.source, self.expanded)


def _long_filter(f):
    return dict(zip(("column", "op", "value"), f)) if isinstance(f, list) else f


def _long_target(t):
    if not isinstance(t, list):
        return t
    return dict(zip(("type", "op", "value") if t[0] == "count" else ("type", "column", "op", "value"), t))


def expand(query: dict) -> dict:
    """All shorthands written out and defaults put in, on a copy. Expanding an expanded query changes nothing."""
    full = copy.deepcopy(query)
    for p in FILTER_PATHS:
        paths.change(full, p, _long_filter, each=False)
    paths.change(full, "query.conditions.target", _long_target, each=False)
    for c in paths.values(full, "query.conditions"):
        if "sequence" not in c:
            c.setdefault("target", dict(DEFAULT_TARGET))
            _include_zero(c)
    for p in AGGREGATION_PATHS:
        paths.change(full, p, lambda a: _full_aggregations(p, a), each=False)  # noqa: B023
    conditions = paths.values(full, "query.conditions")
    if conditions:
        relation = full["query"].get("relation", DEFAULT_RELATION)
        word = relation.strip().lower()
        full["query"]["relation"] = simple_relation(word, len(conditions)) if word in RELATION_WORDS else relation
    return full


def _include_zero(condition: dict) -> None:
    """``includeZero`` lets groups without a matching row pass; it must fit the target, and a count of 0 implies it."""
    target, given = condition["target"], condition.get("includeZero")
    problem = lambda why: QueryProblem(ProblemKind.TYPE_MISMATCH, f"includeZero: {why}")
    if target["type"] == "sum":
        if given:
            raise problem("is for count targets only")
        return
    op, value = target["op"], target["value"]
    zero_passes = {"==": value == 0, "!=": value != 0, ">": False, ">=": value == 0, "<": value > 0, "<=": True}[op]
    if (op, value) == ("==", 0):
        if given is False:
            raise problem("a count of 0 is about groups without matching rows")
        condition["includeZero"] = True
    elif given and not zero_passes:
        raise problem(f"no group without matching rows has a count {op} {value}")


def _full_aggregations(where: str, given) -> list[dict]:
    found = []
    for a in given["columns"] if isinstance(given, dict) else given:
        if "type" not in a:
            if "name" in a:
                raise schema_problem(where, "an aggregation needs a type to have a name")
            found += [{**a, "type": t} for t in DEFAULT_AGGREGATIONS]
        else:
            found.append(a)
    for a in found:
        if (a["type"] in TYPES_OF_OTHER_COLUMN) != ("otherColumn" in a):
            raise schema_problem(where, f"otherColumn goes with {' and '.join(TYPES_OF_OTHER_COLUMN)}, and only with them")
    return found


def _names(full: dict) -> dict[str, int]:
    for p in ("query.conditions", *AGGREGATION_PATHS):
        names = [x["name"] for x in paths.values(full, p) if "name" in x]
        for n in names:
            if not IDENTIFIER.fullmatch(n):
                raise schema_problem(p, f"{n!r} is no name: letters, digits and underscores, a letter first")
        lowered = [n.lower() for n in names] if p == "query.conditions" else names
        if len(set(lowered)) < len(lowered):
            raise schema_problem(p, "names must differ")
    found = {c["name"].lower(): i for i, c in enumerate(paths.values(full, "query.conditions")) if "name" in c}
    if bad := [n for n in found if n in RELATION_WORDS]:
        raise schema_problem("query.conditions", f"{bad[0]!r} is an operator of relations")
    return found


def _filters(full: dict) -> list[dict]:
    return [f for p in FILTER_PATHS for f in paths.values(full, p, each=False)] + [f for p in FILTERS_PATHS for f in paths.values(full, p)]


def _check_timeframe(full: dict, context: QueryContext | None) -> None:
    frame = full.get("timeframe") or {}
    low, high = frame.get("from"), frame.get("to")
    if low is not None and high is not None:
        if type(low) is not type(high) or high <= low:
            raise schema_problem("timeframe", "to must be after from")
    if context is None or context.min_timestamp is None or context.max_timestamp is None:
        return
    digits = {len(str(int(t))) for t in (context.min_timestamp, context.max_timestamp)}
    for bound in (low, high):
        if is_int(bound) and len(str(bound)) not in digits:
            raise QueryProblem(ProblemKind.TYPE_MISMATCH, f"timeframe: {bound} has another number of digits than the dataset's times")


def _check_columns(full: dict, context: QueryContext) -> None:
    def kind_of(column: str) -> str:
        if column not in context.columns:
            raise QueryProblem(ProblemKind.DATASET_MISMATCH, f"there is no column {column}")
        return context.columns[column]

    mismatch = lambda why: QueryProblem(ProblemKind.TYPE_MISMATCH, why)
    for f in _filters(full):
        kind, value = kind_of(f["column"]), f["value"]
        if f["op"] not in OPERATORS_OF[kind]:
            raise mismatch(f"{f['column']} is {kind}, which has no operator {f['op']}")
        fits = {"INT": is_int(value), "FLOAT": is_number(value), "BOOL": type(value) is bool, "STRING": type(value) is str}[kind]
        if not fits:
            raise mismatch(f"{f['column']} is {kind} and cannot be compared with {value!r}")
    numeric = [t["column"] for t in paths.values(full, "query.conditions.target") if t["type"] == "sum"]
    for p in AGGREGATION_PATHS:
        for a in paths.values(full, p):
            kind_of(a["column"])
            numeric += [a["otherColumn"]] if "otherColumn" in a else []
    for column in numeric:
        if kind_of(column) not in ("INT", "FLOAT"):
            raise mismatch(f"{column} is not numeric")


def _used_columns(full: dict, context: QueryContext | None) -> list[str]:
    found = [context.group_id_column, context.timestamp_column] if context else []
    found += [f["column"] for f in _filters(full)] + [t["column"] for t in paths.values(full, "query.conditions.target") if "column" in t]
    for p in AGGREGATION_PATHS:
        found += [x for a in paths.values(full, p) for x in (a["column"], a.get("otherColumn")) if x]
    return list(dict.fromkeys(found))


def check(query: object, context: QueryContext | None = None, schema_only: bool = False) -> Checked:
    """Check and expand. Without a context only what needs no dataset can be checked, which must be asked for by ``schema_only``."""
    found = Checked(False, query)
    try:
        if context is None and not schema_only:
            raise QueryProblem(ProblemKind.INVALID_ARGUMENTS, "a dataset is needed unless only the schema is checked")
        check_query(query)
        full = expand(query)
        check_query(full)  # what was expanded must be a query too
        found.condition_names = _names(full)
        conditions = paths.values(full, "query.conditions")
        if "relation" in full.get("query", {}):
            found.relation = parse_relation(full["query"]["relation"], found.condition_names, len(conditions))
            found.used_conditions = conditions_in(found.relation)
        _check_timeframe(full, None if schema_only else context)
        if not schema_only:
            _check_columns(full, context)
        found.used_columns = _used_columns(full, context)
        found.warnings = [f"{p} has no effect" for p in IGNORED_PATHS if any(True for _ in paths.places(full, p))]
        found.expanded, found.success = full, True
    except QueryProblem as problem:
        found.problem = problem
    return found
