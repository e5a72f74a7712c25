"""The shape of a query document, before it is expanded and after.

Checkers are small functions of (place, value); an object's checker is built from the checkers of its keys. Types are exact: True is no
integer.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pathlume.plans.errors import QueryProblem, schema_problem

Check = Callable[[str, object], None]

NUMERIC_OPERATORS = ("==", "!=", ">", ">=", "<", "<=")
STRING_OPERATORS = ("==", "!=", "contains", "not contains")
BOOLEAN_OPERATORS = ("==", "!=")
OPERATORS = tuple(dict.fromkeys((*NUMERIC_OPERATORS, *STRING_OPERATORS)))
AGGREGATION_TYPES = ("count", "countPerValue", "groupsPerValue", "sumPerValue", "meanPerValue")
TYPES_OF_OTHER_COLUMN = ("sumPerValue", "meanPerValue")
DEFAULT_AGGREGATIONS = ("count", "countPerValue", "groupsPerValue")
RELATION_WORDS = ("and", "or", "&&", "||")
IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z_0-9]*")


def is_int(value: object) -> bool:
    return type(value) is int


def is_number(value: object) -> bool:
    return type(value) in (int, float)


def text(where: str, value: object) -> None:
    if type(value) is not str:
        raise schema_problem(where, "must be a text")


def flag(where: str, value: object) -> None:
    if type(value) is not bool:
        raise schema_problem(where, "must be true or false")


def whole(where: str, value: object) -> None:
    if not is_int(value) or value < 0:
        raise schema_problem(where, "must be a whole number of 0 or more")


def positive(where: str, value: object) -> None:
    if not is_int(value) or value < 1:
        raise schema_problem(where, "must be a whole number of 1 or more")


def number(where: str, value: object) -> None:
    if not is_number(value):
        raise schema_problem(where, "must be a number")


def scalar(where: str, value: object) -> None:
    if type(value) not in (str, int, float, bool):
        raise schema_problem(where, "must be a text, a number, true or false")


def instant(where: str, value: object) -> None:
    """A timeframe bound: a whole number in the unit of the time column, or for timestamp columns a date and time as text."""
    if type(value) is not str:
        whole(where, value)


def one_of(*allowed: object) -> Check:
    def check(where: str, value: object) -> None:
        if type(value) is not str or value not in allowed:
            raise schema_problem(where, f"must be one of {', '.join(map(str, allowed))}")

    return check


def listed(item: Check, least: int = 0) -> Check:
    def check(where: str, value: object) -> None:
        if not isinstance(value, list) or len(value) < least:
            raise schema_problem(where, f"must be a list of at least {least}")
        for i, x in enumerate(value):
            item(f"{where}[{i}]", x)

    return check


def fields(required: dict[str, Check], optional: dict[str, Check] | None = None) -> Check:
    known = {**required, **(optional or {})}

    def check(where: str, value: object) -> None:
        if not isinstance(value, dict):
            raise schema_problem(where, "must be an object")
        if extra := [str(k) for k in value if k not in known]:
            raise schema_problem(where, f"has unknown keys: {', '.join(extra)}")
        if missing := [k for k in required if k not in value]:
            raise schema_problem(where, f"lacks {', '.join(missing)}")
        for k, x in value.items():
            known[k](f"{where}.{k}", x)

    return check


def tuple_of(*items: Check) -> Check:
    def check(where: str, value: object) -> None:
        if not isinstance(value, list) or len(value) != len(items):
            raise schema_problem(where, f"must be a list of {len(items)}")
        for i, (item, x) in enumerate(zip(items, value)):
            item(f"{where}[{i}]", x)

    return check


def shorthand_or(short: Check, long: Check) -> Check:
    return lambda where, value: (short if isinstance(value, list) else long)(where, value)


FILTER_LONG = fields({"column": text, "op": one_of(*OPERATORS), "value": scalar})
FILTER = shorthand_or(tuple_of(text, one_of(*OPERATORS), scalar), FILTER_LONG)
FILTERS = listed(FILTER_LONG, 1)
COUNT_LONG = fields({"type": one_of("count"), "op": one_of(*NUMERIC_OPERATORS), "value": whole})
SUM_LONG = fields({"type": one_of("sum"), "column": text, "op": one_of(*NUMERIC_OPERATORS), "value": number})


def target(where: str, value: object) -> None:
    kind = value[0] if isinstance(value, list) and value else value.get("type") if isinstance(value, dict) else None
    if kind == "count":
        (tuple_of(one_of("count"), one_of(*NUMERIC_OPERATORS), whole) if isinstance(value, list) else COUNT_LONG)(where, value)
    elif kind == "sum":
        (tuple_of(one_of("sum"), text, one_of(*NUMERIC_OPERATORS), number) if isinstance(value, list) else SUM_LONG)(where, value)
    else:
        raise schema_problem(where, "must be a count or sum target")


def filtered(optional: dict[str, Check]) -> Check:
    """An object with either ``filter`` or ``filters``."""
    one, many = fields({"filter": FILTER}, optional), fields({"filters": FILTERS}, optional)
    return lambda where, value: (many if isinstance(value, dict) and "filters" in value else one)(where, value)


STEP = filtered({"rowFound": flag})
SEQUENCE = listed(STEP, 1)
SEQUENCE_CONDITION = fields({"sequence": SEQUENCE}, {"name": text, "maxDuration": whole})
FILTER_CONDITION = filtered({"name": text, "target": target, "includeZero": flag})


def condition(where: str, value: object) -> None:
    (SEQUENCE_CONDITION if isinstance(value, dict) and "sequence" in value else FILTER_CONDITION)(where, value)


AGGREGATION = fields({"column": text}, {"name": text, "type": one_of(*AGGREGATION_TYPES), "otherColumn": text, "top": positive})


def aggregations(where: str, value: object) -> None:
    """A list; the form ``{"columns": [...]}`` is tolerated."""
    if isinstance(value, dict):
        fields({"columns": listed(AGGREGATION)})(where, value)
    else:
        listed(AGGREGATION)(where, value)


QUERY = fields(
    {},
    {
        "timeframe": fields({}, {"from": instant, "to": instant}),
        "query": fields({}, {"relation": text, "conditions": listed(condition), "aggregations": aggregations}),
        "funnel": fields({"sequence": SEQUENCE}, {"maxDuration": whole, "stepAggregations": aggregations, "endAggregations": aggregations}),
    },
)


def check_query(query: object) -> None:
    QUERY("query", query)


__all__ = ["QueryProblem", "check_query"]
