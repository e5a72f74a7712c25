"""The engine against a plain model of it: loans of a library's readers, drawn at random, and queries made from parts."""

import math
import operator
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathlume.operators.hot_keys import Measure
from pathlume.operators.sequences import sequence_reach
from pathlume.plans.engine import CohortEngine
from pathlume.plans.errors import QueryProblem

SCHEMA = "reader string, lent long, shelf string, pages long, fine double, back boolean"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
COMPARE = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def loans(seed, n=160):
    rng = random.Random(seed)
    return [
        (rng.choice(["ada", "ada", "ada", "bo", "cy", "di", None]), rng.randrange(100, 140), rng.choice(["A1", "A2", "B1", "", None]), rng.choice([None, *range(0, 900, 150)]), rng.choice([None, math.nan, 0.0, 1.25, 2.5, -1.0]), rng.choice([True, False, None]))
        for _ in range(n)
    ]


def clean(rows):
    return [dict(zip(NAMES, (None if isinstance(v, float) and v != v else v for v in r))) for r in rows]


def meets(row, f):
    column, op, value = f
    v = row[column]
    if op == "contains":
        return v is not None and value in v
    if op == "not contains":
        return v is None or value not in v
    if v is None:
        return op == "!="
    return COMPARE[op](v, value)


def matches(rows, c):
    if "sequence" in c:
        at = None
        for step in c["sequence"]:
            due = [r["lent"] for r in rows if meets(r, step["filter"]) and r["lent"] is not None and (at is None or r["lent"] > at)]
            if not due:
                return False
            at = min(due)
        return True
    filters = [c["filter"]] if "filter" in c else [(f["column"], f["op"], f["value"]) for f in c["filters"]]
    found = [r for r in rows if all(meets(r, f) for f in filters)]
    target = c.get("target", ["count", ">=", 1])
    if target[0] == "sum":
        return bool(found) and COMPARE[target[2]](sum(r[target[1]] or 0 for r in found), target[3])
    if not found:
        return bool(c.get("includeZero") or target[1:] == ["==", 0])
    return COMPARE[target[1]](len(found), target[2])


def model(rows, conditions, either):
    groups = {}
    for r in clean(rows):
        if r["reader"] is not None:
            groups.setdefault(r["reader"], []).append(r)
    fits = any if either else all
    return {g: own for g, own in groups.items() if not conditions or fits(matches(own, c) for c in conditions)}


FILTERS = [["shelf", "==", "A1"], ["shelf", "!=", "A1"], ["shelf", "contains", "A"], ["shelf", "not contains", "1"], ["pages", ">", 300], ["pages", "<=", 150], ["fine", ">=", 1.25], ["fine", "!=", 0], ["back", "==", True], ["back", "!=", True]]


def condition(rng):
    kind = rng.random()
    if kind < 0.25:
        return {"sequence": [{"filter": rng.choice(FILTERS)} for _ in range(rng.randint(1, 3))]}
    c = {"filter": rng.choice(FILTERS)} if kind < 0.7 else {"filters": [dict(zip(("column", "op", "value"), f)) for f in rng.sample(FILTERS, 2)]}
    if rng.random() < 0.4:
        c["target"] = ["sum", rng.choice(["pages", "fine"]), rng.choice(list(COMPARE)), rng.choice([0, 2.5, 1500])]
    elif rng.random() < 0.8:
        op, n = rng.choice(list(COMPARE)), rng.choice([0, 1, 3, 8])
        c["target"] = ["count", op, n]
        if (op, n) != ("==", 0) and COMPARE[op](0, n) and rng.random() < 0.5:
            c["includeZero"] = True
    return c


@pytest.mark.parametrize("seed", range(14))
def test_random_conditions_equal_the_model(spark, seed):
    rng = random.Random(seed)
    rows, conditions, either = loans(seed), [condition(rng) for _ in range(rng.randint(0, 3))], rng.random() < 0.5
    expected = model(rows, conditions, either)
    query = {"query": {"conditions": conditions, **({"relation": "or" if either else "and"} if conditions else {})}}
    result = CohortEngine("reader", "lent").run(spark.createDataFrame(rows, SCHEMA), query)
    assert {r["reader"]: r["group_rows"] for r in result.matching_groups().collect()} == {g: len(own) for g, own in expected.items()}, query


def counted(values):
    out = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return out


@pytest.mark.parametrize("conditions", [[], [{"filter": ["pages", ">", 300], "target": ["count", ">=", 12]}]])
def test_aggregations_equal_the_model(spark, conditions):
    rows = loans(77)
    own = [r for rs in model(rows, conditions, False).values() for r in rs]
    asked = [{"column": "shelf"}, {"column": "back", "type": "countPerValue"}, {"column": "shelf", "type": "sumPerValue", "otherColumn": "pages", "name": "p"}, {"column": "shelf", "type": "meanPerValue", "otherColumn": "fine"}, {"column": "pages", "type": "groupsPerValue", "top": 3}]
    got = CohortEngine("reader", "lent").run(spark.createDataFrame(rows, SCHEMA), {"query": {"conditions": conditions, "aggregations": asked}}).to_dict()["query"]
    assert got["matchingGroupRows"] == len(own)
    count, per, groups, back, total, mean, pages = (a["value"] for a in got["aggregations"])
    shelved = [r for r in own if r["shelf"] is not None]
    assert count == len(shelved) and per == counted(r["shelf"] for r in shelved)
    assert groups == {s: len({r["reader"] for r in shelved if r["shelf"] == s}) for s in per}
    assert back == {str(k): n for k, n in counted(r["back"] for r in own if r["back"] is not None).items()}
    assert total == {s: sum(r["pages"] or 0 for r in shelved if r["shelf"] == s) for s in per} and got["aggregations"][4]["name"] == "p"
    for s in per:
        fines = [r["fine"] for r in shelved if r["shelf"] == s and r["fine"] is not None]
        assert mean[s] == pytest.approx(sum(fines) / len(fines)) if fines else mean[s] is None
    readers = {str(p): len({r["reader"] for r in own if r["pages"] == p}) for p in {r["pages"] for r in own} - {None}}
    assert list(pages.items()) == sorted(readers.items(), key=lambda x: (-x[1], x[0]))[:3]  # ties by key


def test_funnel_equals_the_model(spark):
    rows = loans(5)
    steps = [["shelf", "==", "A1"], ["back", "==", True], ["pages", ">", 300], ["fine", "==", 2.5]]
    funnel = {"sequence": [{"filter": f} for f in steps], "stepAggregations": [{"column": "shelf", "type": "groupsPerValue"}], "endAggregations": [{"column": "back", "type": "sumPerValue", "otherColumn": "pages", "top": 1}]}
    conditions = [{"filter": ["pages", "==", 150]}]
    got = CohortEngine("reader", "lent").run(spark.createDataFrame(rows, SCHEMA), {"query": {"conditions": conditions}, "funnel": funnel}).to_dict()["funnel"]
    matching = model(rows, conditions, False)
    for i, block in enumerate(got["sequence"]):
        here = {g: own for g, own in matching.items() if matches(own, {"sequence": [{"filter": f} for f in steps[: i + 1]]})}
        assert (block["matchingGroups"], block["matchingGroupRows"]) == (len(here), sum(map(len, here.values())))
        assert block["aggregations"][0]["value"] == {s: sum(any(r["shelf"] == s for r in own) for own in here.values()) for s in {r["shelf"] for own in here.values() for r in own} - {None}}
    sums = {str(b): sum(r["pages"] or 0 for own in here.values() for r in own if r["back"] is b) for b in (True, False)} if here else {}
    best = dict(sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:1])
    assert got["endAggregations"][0]["value"] == best


def test_keys_of_values(spark):
    rows = [("r", 1, True, 1e7, 2), ("r", 2, False, 12345678.5, 2), ("r", 3, True, 0.25, 3), ("r", 4, None, 1e20, None)]
    df = spark.createDataFrame(rows, "reader string, lent long, flag boolean, weight double, n long")
    got = CohortEngine("reader", "lent").run(df, {"query": {"aggregations": [{"column": c, "type": "countPerValue"} for c in ("flag", "weight", "n")]}}).to_dict()["query"]["aggregations"]
    assert [g["value"] for g in got] == [{"True": 2, "False": 1}, {"0.25": 1, "10000000.0": 1, "12345678.5": 1, "1.0E20": 1}, {"2": 2, "3": 1}]


def test_timeframe_bounds(spark):
    rows = loans(9)
    engine, df = CohortEngine("reader", "lent"), spark.createDataFrame(rows, SCHEMA)
    for frame in ({"from": 120}, {"to": 120}, {"from": 110, "to": 111}, {"from": 139, "to": 500}, {"from": 900}):
        kept = [r for r in rows if r[0] is not None and frame.get("from", 0) <= r[1] < frame.get("to", 10**9)]
        query = {"timeframe": frame, "query": {"aggregations": [{"column": "pages"}]}, "funnel": {"sequence": [{"filter": ["pages", ">=", 0]}]}}
        got = engine.run(df, query).to_dict()
        assert (got["query"]["matchingGroups"], got["query"]["matchingGroupRows"]) == (len({r[0] for r in kept}), len(kept))
        assert got["query"]["aggregations"][0]["value"] == sum(r[3] is not None for r in kept) and len(got["funnel"]["sequence"]) == 1


def test_scanned(spark):
    rows = loans(3)
    got = CohortEngine("reader", "lent").run(spark.createDataFrame(rows, SCHEMA), {"timeframe": {"from": 120}, "query": {"conditions": [{"filter": ["pages", ">", 10**6]}]}}).scanned().first()
    kept = [r for r in rows if r[1] >= 120]
    assert tuple(got) == (len(kept), len({r[0] for r in kept} - {None}))


def test_odd_names_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, 5, "q", 1), ("b", 2, 7, "r", 2)], "`the reader` string, `lent at` long, `a.b` long, value string, `rows` long")
    got = CohortEngine("the reader", "lent at").run(df, {"query": {"conditions": [{"filter": ["a.b", ">", 5]}], "aggregations": [{"column": "value"}, {"column": "rows", "type": "countPerValue"}]}}).to_dict()
    assert got["query"]["matchingGroups"] == 1 and got["query"]["aggregations"][3]["value"] == {"2": 1}
    with pytest.raises(QueryProblem):
        CohortEngine("the reader", "lent at").run(df, {"query": {"conditions": [{"filter": ["nope", "==", 1]}]}})


def test_matching_rows_and_projection(spark):
    rows, conditions = loans(21), [{"filter": ["pages", ">", 300], "target": ["count", ">", 9]}]
    result = CohortEngine("reader", "lent").run(spark.createDataFrame(rows, SCHEMA), {"query": {"conditions": conditions}})
    assert result.matching_rows().count() == sum(map(len, model(rows, conditions, False).values())) and result.base.columns == ["reader", "lent", "pages"]


def reach(rows, steps):
    out = {}
    for g in {r[0] for r in rows} - {None}:
        n = 0
        while n < len(steps) and matches([{"lent": t, "k": k} for h, t, k in rows if h == g], {"sequence": [{"filter": ["k", "==", s]} for s in steps[: n + 1]]}):
            n += 1
        out[g] = n
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.lists(st.sampled_from("xyz"), min_size=1, max_size=4))
def test_reach_equals_the_model_with_and_without_heavy_groups(spark, seed, steps):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "b", "c", None]), rng.choice([None, *range(30)]), rng.choice("xyzw")) for _ in range(120)]
    df = spark.createDataFrame(rows, "g string, t long, k string")
    wanted = [{"filter": {"column": "k", "op": "==", "value": s}} for s in steps]
    expected = reach(rows, steps)
    for most, spread in ((None, 1), (10**6, 64), (30, 7), (1, 64)):
        found = sequence_reach(df, "g", "t", {"n": wanted, "first": wanted[:1]}, [Measure("rows", "count")], heavy_rows=most, spread=spread).collect()
        assert {r["g"]: r["n"] for r in found} == expected and {r["g"]: r["first"] for r in found} == reach(rows, steps[:1])
        assert {r["g"]: r["rows"] for r in found} == {g: sum(r[0] == g for r in rows) for g in expected}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plan") / "e")
    spark.range(1000).select((F.col("id") % 50).alias("g"), F.col("id").alias("t"), (F.col("id") % 7).alias("v"), (F.col("id") % 3).alias("w"), F.lit("x").alias("unused")).write.parquet(path)
    return spark.read.parquet(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditions_with_sequences_are_one_scan_and_one_exchange_by_default(stored):
    q = {"query": {"relation": "or", "conditions": [{"filter": ["v", "==", 3], "target": ["count", ">", 2]}, {"sequence": [{"filter": ["v", "==", 1]}, {"filter": ["v", "==", 2]}]}]}}
    plan = plan_of(CohortEngine("g", "t").run(stored, q).matching_groups())
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan parquet") == 1 and "unused" not in plan


def test_aggregations_of_many_columns_read_the_rows_once_for_each_kind(stored):
    every = {"query": {"aggregations": [{"column": c, "type": "countPerValue"} for c in ("v", "w", "g")]}}
    assert plan_of(CohortEngine("g", "t").run(stored, every).aggregations()).count("FileScan parquet") == 1
    some = {"query": {"conditions": [{"filter": ["v", "==", 3]}], **every["query"]}}
    assert plan_of(CohortEngine("g", "t").run(stored, some).aggregations()).count("FileScan parquet") == 2  # the rows, and the groups that match
