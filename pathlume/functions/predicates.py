"""Row predicates of the query language as columns that are never null.

A comparison with a null or NaN value does not hold, except ``!=`` and ``not contains``, which do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathlume.functions.normalize import col

COMPARISONS = {
    "==": lambda c, v: c == v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "contains": lambda c, v: c.contains(v),
}
NEGATED = {"!=": "==", "not contains": "contains"}


def compare(column: Column, op: str, value: object) -> Column:
    """``column`` must have no NaN (``nan_to_null``)."""
    if op in NEGATED:
        return ~compare(column, NEGATED[op], value)
    if op not in COMPARISONS:
        raise ValueError(f"no such operator: {op}")
    return F.coalesce(COMPARISONS[op](column, F.lit(value)), F.lit(False))


def row_predicate(holder: dict) -> Column:
    """The predicate of an expanded condition or step: its one filter, or all of its filters on the same row."""
    filters = holder["filters"] if "filters" in holder else [holder["filter"]]
    return reduce(Column.__and__, (compare(col(f["column"]), f["op"], f["value"]) for f in filters))
