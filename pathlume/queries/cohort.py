"""Queries of the behavioural engine, one for each of its operators, over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlume.plans.engine import CohortEngine, CohortResult
from pathlume.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HIGH = {"column": "value", "op": ">", "value": 150}


def run(spark: SparkSession, data_dir: str, query: dict, table: str = "events", group: str = "user_id", time: str = "ts") -> CohortResult:
    return CohortEngine(group, time).run(read_table(spark, data_dir, table), query)


def _add(name: str, query: dict, take: Callable[[CohortResult], DataFrame], sql: str, **table: str) -> None:
    QUERIES[name] = lambda spark, data_dir: take(run(spark, data_dir, query, **table))
    SQL[name] = sql


def _groups(r: CohortResult) -> DataFrame:
    return r.matching_groups()


def _summary(r: CohortResult) -> DataFrame:
    return r.summary()


def _values(r: CohortResult) -> DataFrame:
    return r.aggregations().select("scope", F.coalesce("step", F.lit(-1)).alias("step"), "position", "type", F.coalesce("key", F.lit("")).alias("key"), F.round("value", 6).alias("value"))


def _having(condition: str) -> str:
    return f"select user_id, count(*) as group_rows from events group by user_id having {condition}"


# --- empty query and timeframe

_add("scanned", {"timeframe": {"from": "2024-01-05 00:00:00"}}, lambda r: r.scanned(), "select count(*) as scanned_rows, count(distinct user_id) as scanned_groups from events where ts >= timestamp '2024-01-05 00:00:00'")

_add("empty_query", {}, _summary, "select count(distinct user_id) as matching_groups, count(*) as matching_group_rows from events")
_add(
    "timeframe_from_to",
    {"timeframe": {"from": "2024-01-05 00:00:00", "to": "2024-01-12 06:00:00"}},
    _summary,
    "select count(distinct user_id) as matching_groups, count(*) as matching_group_rows from events where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-12 06:00:00'",
)
_add(
    "timeframe_numeric",
    {"timeframe": {"from": 1515000000000, "to": 1516000000000}},
    _summary,
    "select count(distinct visitorid) as matching_groups, count(*) as matching_group_rows from shop_activity where ts >= 1515000000000 and ts < 1516000000000 and visitorid is not null",
    table="shop_activity",
    group="visitorid",
)

# --- row predicates

for _name, _filter, _where in (
    ("filter_eq", ["event_type", "==", "error"], "event_type = 'error'"),
    ("filter_ne", ["event_type", "!=", "error"], "event_type is distinct from 'error'"),
    ("filter_gt", ["value", ">", 250], "value > 250"),
    ("filter_gte", ["value", ">=", 250.5], "value >= 250.5"),
    ("filter_lt", ["value", "<", 0.05], "value < 0.05"),
    ("filter_lte", ["value", "<=", 0.1], "value <= 0.1"),
    ("filter_contains", ["props", "contains", '"k": 66'], "contains(props, '\"k\": 66')"),
    ("filter_not_contains", ["props", "not contains", '"k": 6'], "not coalesce(contains(props, '\"k\": 6'), false)"),
):
    _target = ["count", ">=", 45] if _name in ("filter_ne", "filter_not_contains") else ["count", ">=", 1]
    _add(_name, {"query": {"conditions": [{"filter": _filter, "target": _target}]}}, _groups, _having(f"count(*) filter (where {_where}) >= {_target[2]}"))

# null, NaN and dirty values
_DIRTY = {"table": "app_activity", "group": "deviceid", "time": "ts_sec"}
_add(
    "filter_ne_with_nulls",
    {"query": {"conditions": [{"filter": ["eventvalue", "!=", 5], "target": ["count", ">=", 3]}, {"filter": ["crashcode", "not contains", "a"], "target": ["count", ">=", 3]}]}},
    _groups,
    """select deviceid, count(*) as group_rows from app_activity where deviceid is not null group by deviceid
       having count(*) filter (where eventvalue is distinct from 5) >= 3 and count(*) filter (where not coalesce(contains(crashcode, 'a'), false)) >= 3""",
    **_DIRTY,
)
_add(
    "filter_nan_never_greater",
    {"query": {"conditions": [{"filter": ["eventvalue", ">", 100], "target": ["sum", "eventvalue", ">", 150]}]}},
    _groups,
    """select deviceid, count(*) as group_rows from app_activity where deviceid is not null group by deviceid
       having count(*) filter (where eventvalue > 100 and not isnan(eventvalue)) >= 1 and sum(eventvalue) filter (where eventvalue > 100 and not isnan(eventvalue)) > 150""",
    **_DIRTY,
)
_add(
    "filter_bool",
    {"query": {"conditions": [{"filter": ["iscool", "==", True], "target": ["count", ">=", 2]}, {"filter": ["iscool", "!=", True], "target": ["count", ">=", 4]}]}},
    _groups,
    """select deviceid, count(*) as group_rows from app_activity where deviceid is not null group by deviceid
       having count(*) filter (where iscool) >= 2 and count(*) filter (where iscool is distinct from true) >= 4""",
    **_DIRTY,
)
_add(
    "multi_filter_same_row",
    {"query": {"conditions": [{"filters": [HIGH, {"column": "event_type", "op": "==", "value": "purchase"}], "target": ["count", ">=", 3]}]}},
    _groups,
    _having("count(*) filter (where value > 150 and event_type = 'purchase') >= 3"),
)

# --- targets

_ERROR = "count(*) filter (where event_type = 'error')"
_BIG = "count(*) filter (where value > 250)"
for _name, _condition, _sql in (
    ("target_count_gt", {"filter": ["event_type", "==", "error"], "target": ["count", ">", 15]}, f"{_ERROR} > 15"),
    ("target_count_eq", {"filter": ["event_type", "==", "error"], "target": ["count", "==", 13]}, f"{_ERROR} = 13"),
    ("target_count_ne", {"filter": ["event_type", "==", "error"], "target": ["count", "!=", 13]}, f"{_ERROR} >= 1 and {_ERROR} <> 13"),
    ("target_count_lte", {"filter": ["value", ">", 250], "target": ["count", "<=", 2]}, f"{_BIG} >= 1 and {_BIG} <= 2"),
    ("target_count_zero", {"filter": ["value", ">", 250], "target": ["count", "==", 0]}, f"{_BIG} = 0"),
    ("target_include_zero", {"filter": ["value", ">", 250], "target": ["count", "<=", 1], "includeZero": True}, f"({_BIG} = 0 or {_BIG} <= 1)"),
    ("target_sum_gte", {"filter": ["event_type", "==", "purchase"], "target": ["sum", "value", ">=", 800]}, f"count(*) filter (where event_type = 'purchase') >= 1 and sum(value) filter (where event_type = 'purchase') >= 800"),
    ("target_sum_lt", {"filter": ["value", ">", 250], "target": ["sum", "value", "<", 300]}, f"{_BIG} >= 1 and sum(value) filter (where value > 250) < 300"),
):
    _add(_name, {"query": {"conditions": [_condition]}}, _groups, _having(_sql))

# --- relations

_THREE = [
    {"name": "errors", "filter": ["event_type", "==", "error"], "target": ["count", ">=", 15]},
    {"name": "big", "filter": ["value", ">", 250]},
    {"name": "buys", "filter": ["event_type", "==", "purchase"], "target": ["sum", "value", ">=", 800]},
]
_E, _B, _P = f"{_ERROR} >= 15", f"{_BIG} >= 1", "(count(*) filter (where event_type = 'purchase') >= 1 and sum(value) filter (where event_type = 'purchase') >= 800)"
for _name, _relation, _sql in (
    ("relation_and", "and", f"{_E} and {_B} and {_P}"),
    ("relation_or", "||", f"({_E} or {_B} or {_P})"),
    ("relation_precedence", "$0 or $1 and $2", f"({_E} or ({_B} and {_P}))"),
    ("relation_nested", "($0 or $1) && ($2 or ($0 and $1))", f"({_E} or {_B}) and ({_P} or ({_E} and {_B}))"),
    ("relation_named", "$BIG and ($errors or $Buys)", f"{_B} and ({_E} or {_P})"),
    ("relation_unused_condition", "$big", _B),
):
    _add(_name, {"query": {"conditions": _THREE, "relation": _relation}}, _groups, _having(_sql))
_add("relation_default", {"query": {"conditions": _THREE[:2]}}, _groups, _having(f"{_E} and {_B}"))

# --- aggregations


def _agg(kind: str, column: str, value: str, position: int = 0, where: str = "true", top: int = 10, table: str = "events", scope: str = "query", step: int = -1) -> str:
    if kind == "count":
        return f"select '{scope}' as scope, {step} as step, {position} as position, 'count' as type, '' as key, cast(count({column}) as double) as value from {table} where {where}"
    return (
        f"select '{scope}' as scope, {step} as step, {position} as position, '{kind}' as type, key, round(value, 6) as value from ("
        f"select cast({column} as varchar) as key, cast({value} as double) as value from {table} where {column} is not null and {where} group by {column} order by 2 desc nulls last, 1 limit {top})"
    )


_PER_VALUE = {"countPerValue": "count(*)", "groupsPerValue": "count(distinct user_id)", "sumPerValue": "coalesce(sum(value), 0)", "meanPerValue": "avg(value)"}
_add("agg_count", {"query": {"aggregations": [{"column": "props", "type": "count"}]}}, _values, _agg("count", "props", ""))
for _name, _kind in (("agg_count_per_value", "countPerValue"), ("agg_groups_per_value", "groupsPerValue"), ("agg_sum_per_value", "sumPerValue"), ("agg_mean_per_value", "meanPerValue")):
    _other = {"otherColumn": "value"} if _kind in ("sumPerValue", "meanPerValue") else {}
    _add(_name, {"query": {"aggregations": [{"column": "event_type", "type": _kind, **_other}]}}, _values, _agg(_kind, "event_type", _PER_VALUE[_kind]))
_add(
    "agg_default_set",
    {"query": {"aggregations": [{"column": "event_type"}]}},
    _values,
    " union all ".join([_agg("count", "event_type", ""), _agg("countPerValue", "event_type", "count(*)", 1), _agg("groupsPerValue", "event_type", "count(distinct user_id)", 2)]),
)
_add("agg_top_n", {"query": {"aggregations": [{"column": "props", "type": "countPerValue", "top": 5, "name": "most"}]}}, _values, _agg("countPerValue", "props", "count(*)", top=5))
_add(
    "agg_nulls_and_floats",
    {"query": {"aggregations": [{"column": "iscool", "type": "countPerValue"}, {"column": "goalid", "type": "meanPerValue", "otherColumn": "eventvalue", "top": 7}, {"column": "eventvalue", "type": "count"}]}},
    _values,
    """select 'query' as scope, -1 as step, 0 as position, 'countPerValue' as type, case when iscool then 'True' else 'False' end as key, cast(count(*) as double) as value
         from app_activity where deviceid is not null and iscool is not null group by iscool
       union all select 'query', -1, 1, 'meanPerValue', key, round(value, 6) from (
         select cast(goalid as varchar) as key, avg(case when not isnan(eventvalue) then eventvalue end) as value from app_activity where deviceid is not null and goalid is not null group by goalid order by 2 desc nulls last, 1 limit 7)
       union all select 'query', -1, 2, 'count', '', cast(count(case when not isnan(eventvalue) then eventvalue end) as double) from app_activity where deviceid is not null""",
    **_DIRTY,
)
_MATCHED = f"user_id in (select user_id from events group by user_id having {_E})"
_add(
    "agg_over_matching_groups",
    {"query": {"conditions": _THREE[:1], "aggregations": [{"column": "event_type"}, {"column": "event_type", "type": "sumPerValue", "otherColumn": "value"}]}},
    _values,
    " union all ".join(
        [_agg("count", "event_type", "", 0, _MATCHED), _agg("countPerValue", "event_type", "count(*)", 1, _MATCHED), _agg("groupsPerValue", "event_type", "count(distinct user_id)", 2, _MATCHED), _agg("sumPerValue", "event_type", "sum(value)", 3, _MATCHED)]
    ),
)
_add("matching_rows", {"query": {"conditions": [_THREE[0]], "aggregations": [{"column": "value", "type": "count"}]}}, lambda r: r.matching_rows(), f"select user_id, ts, event_type, value from events where {_MATCHED}")

# --- sequences and funnels


def chain(table: str, group: str, time: str, steps: list[str], source: str = "true") -> str:
    """CTEs s0, s1, ...: the time at which each group reaches each step."""
    out = [f"s0 as (select {group} as g, min({time}) as t from {table} where {group} is not null and {source} and {steps[0]} group by 1)"]
    for i, step in enumerate(steps[1:], 1):
        out.append(f"s{i} as (select e.{group} as g, min(e.{time}) as t from {table} e join s{i - 1} p on e.{group} = p.g where e.{time} > p.t and {step} group by 1)")
    return "with " + ", ".join(out)


def funnel_counts(table: str, group: str, n: int) -> str:
    reached = " union all ".join(f"select {i} as step, g from s{i}" for i in range(n))
    steps = " union all ".join(f"select {i} as step" for i in range(n))
    return f""" select steps.step, count(distinct p.g) as matching_groups, count(e.{group}) as matching_group_rows
      from ({steps}) steps left join ({reached}) p on p.step = steps.step left join {table} e on e.{group} = p.g group by steps.step"""


def _step(kind: str) -> dict:
    return {"filters": [{"column": "event_type", "op": "==", "value": kind}, HIGH]}


_KINDS = ["view", "click", "purchase", "signup"]
_STEPS = [f"event_type = '{k}' and value > 150" for k in _KINDS]
_CHAIN = chain("events", "user_id", "ts", _STEPS)
_add(
    "sequence_condition",
    {"query": {"conditions": [{"sequence": [_step(k) for k in _KINDS[:3]]}]}},
    _groups,
    f"{chain('events', 'user_id', 'ts', _STEPS[:3])} select user_id, count(*) as group_rows from events where user_id in (select g from s2) group by 1",
)
_add(
    "sequence_repeated_step",
    {"query": {"conditions": [{"sequence": [{"filter": ["value", ">", 200]}] * 3}]}},
    _groups,
    f"{chain('events', 'user_id', 'ts', ['value > 200'] * 3)} select user_id, count(*) as group_rows from events where user_id in (select g from s2) group by 1",
)
_add(
    "sequence_or_count",
    {"query": {"relation": "$seq or $none", "conditions": [{"name": "seq", "sequence": [_step(k) for k in _KINDS[:3]]}, {"name": "none", "filter": ["value", ">", 250], "target": ["count", "==", 0]}]}},
    _groups,
    f"{chain('events', 'user_id', 'ts', _STEPS[:3])} select user_id, count(*) as group_rows from events group by 1 having user_id in (select g from s2) or {_BIG} = 0",
)
_FUNNEL = {"sequence": [_step(k) for k in _KINDS]}
_add("funnel_counts", {"funnel": _FUNNEL}, lambda r: r.funnel(), f"{_CHAIN} {funnel_counts('events', 'user_id', 4)}")
_add(
    "funnel_after_conditions",
    {"query": {"conditions": _THREE[:2], "relation": "or"}, "funnel": _FUNNEL},
    lambda r: r.funnel(),
    f"{chain('events', 'user_id', 'ts', _STEPS, f'user_id in (select user_id from events group by user_id having ({_E} or {_B}))')} {funnel_counts('events', 'user_id', 4)}",
)
_add(
    "funnel_step_aggs",
    {"funnel": {**_FUNNEL, "stepAggregations": [{"column": "event_type", "type": "groupsPerValue"}, {"column": "event_type", "type": "sumPerValue", "otherColumn": "value"}]}},
    _values,
    f"{_CHAIN} "
    + " union all ".join(_agg(k, "event_type", _PER_VALUE[k], p, f"user_id in (select g from s{i})", scope="step", step=i) for i in range(4) for p, k in enumerate(("groupsPerValue", "sumPerValue"))),
)
_add(
    "funnel_end_aggs",
    {"funnel": {"sequence": _FUNNEL["sequence"][:3], "endAggregations": [{"column": "props", "type": "countPerValue", "top": 4}, {"column": "event_type", "type": "count"}]}},
    _values,
    f"{_CHAIN} {_agg('countPerValue', 'props', 'count(*)', 0, 'user_id in (select g from s2)', 4, scope='end')} union all {_agg('count', 'event_type', '', 1, 'user_id in (select g from s2)', scope='end')}",
)
# numeric times with ties, nulls and placeholders, and groups that hold much of the table
_SHOP = {"table": "shop_activity", "group": "visitorid", "time": "ts"}
_SHOP_STEPS = ["eventtype = 'view'", "eventtype = 'click'", "eventtype = 'addtocart'", "eventtype = 'transaction'"]
_add(
    "numeric_time_funnel",
    {"funnel": {"sequence": [{"filter": ["eventtype", "==", k]} for k in ("view", "click", "addtocart", "transaction")]}},
    lambda r: r.funnel(),
    f"{chain('shop_activity', 'visitorid', 'ts', _SHOP_STEPS)} {funnel_counts('shop_activity', 'visitorid', 4)}",
    **_SHOP,
)
_ORDER_STEPS = ["o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_totalprice > 200000"]
_add(
    "orders_funnel",
    {"funnel": {"sequence": [{"filter": ["o_orderstatus", "==", "F"]}, {"filter": ["o_orderstatus", "==", "O"]}, {"filter": ["o_totalprice", ">", 200000]}]}},
    lambda r: r.funnel(),
    f"{chain('orders', 'o_custkey', 'o_orderdate', _ORDER_STEPS)} {funnel_counts('orders', 'o_custkey', 3)}",
    table="orders",
    group="o_custkey",
    time="o_orderdate",
)
_add(
    "lineitem_sum_target",
    {"query": {"conditions": [{"filter": ["l_returnflag", "==", "R"], "target": ["sum", "l_extendedprice", ">", 100000]}]}},
    _groups,
    "select l_orderkey, count(*) as group_rows from lineitem group by 1 having count(*) filter (where l_returnflag = 'R') >= 1 and sum(l_extendedprice) filter (where l_returnflag = 'R') > 100000",
    table="lineitem",
    group="l_orderkey",
    time="l_shipdate",
)
