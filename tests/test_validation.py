"""Checking and expanding queries. Cases are made from the rules: every operator with every value, every place with something wrong."""

import copy
import itertools
import operator

import pytest

from pathlume.plans import paths
from pathlume.plans.errors import ProblemKind
from pathlume.plans.validate import QueryContext, check, expand

#: Loans of a library: one row per loan.
COLUMNS = {"reader": "INT", "lent_at": "INT", "pages": "INT", "fine": "FLOAT", "shelf": "STRING", "returned": "BOOL"}
CONTEXT = QueryContext(COLUMNS, "reader", "lent_at", 20_000, 90_000)
COMPARE = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
MISFIT = {ProblemKind.TYPE_MISMATCH}


def outcome(query, context=CONTEXT, **options):
    found = check(query, context, **options)
    assert found.success == (found.problem is None) and (found.error_message is None) == found.success
    return found.error_kind


def one(condition, **more):
    return {"query": {"conditions": [condition], **more}}


def full_query():
    """A query with everything a query may have."""
    return {
        "timeframe": {"from": 30_000, "to": 40_000},
        "query": {
            "conditions": [
                {"name": "thick", "filter": ["pages", ">", 700], "target": ["count", ">=", 2]},
                {"filters": [{"column": "shelf", "op": "contains", "value": "B"}, {"column": "returned", "op": "==", "value": False}], "target": ["sum", "fine", "<", 9.5]},
                {"name": "path", "sequence": [{"filter": ["shelf", "==", "A1"]}, {"filter": ["pages", "<=", 90]}]},
            ],
            "relation": "$thick or ($1 and $path)",
            "aggregations": [{"column": "shelf"}, {"column": "shelf", "type": "meanPerValue", "otherColumn": "fine", "top": 4, "name": "fines"}],
        },
        "funnel": {"sequence": [{"filter": ["shelf", "!=", "C"]}], "stepAggregations": [{"column": "returned", "type": "countPerValue"}], "endAggregations": {"columns": [{"column": "pages", "type": "count"}]}},
    }


def test_the_full_query_is_fine_and_left_as_it_was():
    q = full_query()
    found = check(q, CONTEXT)
    assert found.success and q == full_query() and expand(found.expanded) == found.expanded
    assert found.condition_names == {"thick": 0, "path": 2} and sorted(found.used_conditions) == [0, 1, 2]
    assert set(found.used_columns) == set(COLUMNS) and found.used_columns[:2] == ["reader", "lent_at"]
    assert found.expanded["query"]["conditions"][0] == {"name": "thick", "filter": {"column": "pages", "op": ">", "value": 700}, "target": {"type": "count", "op": ">=", "value": 2}}
    assert [a["type"] for a in found.expanded["query"]["aggregations"]] == ["count", "countPerValue", "groupsPerValue", "meanPerValue"]
    assert found.warnings == []


def places(doc, at=()):
    yield at, doc
    for k, x in doc.items() if isinstance(doc, dict) else enumerate(doc) if isinstance(doc, list) else ():
        yield from places(x, (*at, k))


def changed(at, how):
    q = full_query()
    spot = q
    for k in at[:-1]:
        spot = spot[k]
    if at:
        spot[at[-1]] = how(spot[at[-1]])
        return q
    return how(q)


PLACES = list(places(full_query()))


@pytest.mark.parametrize("at", [at for at, x in PLACES if isinstance(x, dict)], ids=str)
def test_unknown_keys_are_refused_everywhere(at):
    assert outcome(changed(at, lambda x: {**x, "blot": 1})) is ProblemKind.SCHEMA


@pytest.mark.parametrize("at", [at for at, x in PLACES if isinstance(x, (dict, list))], ids=str)
def test_a_number_in_place_of_a_block_is_refused_everywhere(at):
    assert outcome(changed(at, lambda x: 7)) is ProblemKind.SCHEMA


@pytest.mark.parametrize("at", [at for at, x in PLACES if isinstance(x, list) and at[-1] in ("filter", "target")], ids=str)
def test_short_forms_have_their_length(at):
    assert outcome(changed(at, lambda x: x[:-1])) is ProblemKind.SCHEMA and outcome(changed(at, lambda x: [*x, 1])) is ProblemKind.SCHEMA


@pytest.mark.parametrize("at", [("query", "conditions", 1, "filters"), ("query", "conditions", 2, "sequence"), ("funnel", "sequence")], ids=str)
def test_lists_that_need_an_entry(at):
    assert outcome(changed(at, lambda x: [])) is ProblemKind.SCHEMA


@pytest.mark.parametrize("kind", ["INT", "FLOAT", "STRING", "BOOL"])
def test_filters_fit_where_operator_and_value_fit_the_column(kind):
    column = next(c for c, k in COLUMNS.items() if k == kind and c not in ("reader", "lent_at"))
    order, text = (">", ">=", "<", "<="), ("contains", "not contains")
    for op, value in itertools.product(("==", "!=", *order, *text), (3, -2, 2.5, "3", "", True)):
        known = kind in ("INT", "FLOAT") if op in order else kind == "STRING" if op in text else True
        fits = {"INT": (int,), "FLOAT": (int, float), "STRING": (str,), "BOOL": (bool,)}[kind]
        expected = None if known and type(value) in fits else ProblemKind.TYPE_MISMATCH
        assert outcome(one({"filter": [column, op, value]})) is expected, (op, value)


def test_unknown_columns_are_named_wherever_they_stand():
    for at in [at for at, x in PLACES if isinstance(x, str) and x in COLUMNS]:
        assert outcome(changed(at, lambda x: "no_such")) is ProblemKind.DATASET_MISMATCH, at
        assert outcome(changed(at, lambda x: "no_such"), None, schema_only=True) is None


def test_include_zero_fits_where_a_count_of_zero_passes():
    for op, value, given in itertools.product(COMPARE, range(4), (None, False, True)):
        c = {"filter": ["pages", ">", 5], "target": ["count", op, value], **({} if given is None else {"includeZero": given})}
        wrong = (given is False) if (op, value) == ("==", 0) else bool(given) and not COMPARE[op](0, value)
        assert outcome(one(c)) is (ProblemKind.TYPE_MISMATCH if wrong else None), (op, value, given)
    assert check(one({"filter": ["pages", ">", 5], "target": ["count", "==", 0]}), CONTEXT).expanded["query"]["conditions"][0]["includeZero"] is True
    assert outcome(one({"filter": ["pages", ">", 5], "target": ["sum", "fine", ">", 0], "includeZero": True})) in MISFIT


def test_sums_need_numbers():
    for column, kind in COLUMNS.items():
        expected = None if kind in ("INT", "FLOAT") else ProblemKind.TYPE_MISMATCH
        assert outcome(one({"filter": ["pages", ">", 5], "target": ["sum", column, ">", 1]})) is expected
        for how in ("sumPerValue", "meanPerValue"):
            assert outcome({"query": {"aggregations": [{"column": "shelf", "type": how, "otherColumn": column}]}}) is expected


def test_targets_and_aggregations_of_odd_values():
    for target in (["count", "contains", 1], ["count", ">", -1], ["count", ">", 1.5], ["count", ">", "1"], ["count", ">", False], ["mean", ">", 1], ["sum", "fine", ">", None], []):
        assert outcome(one({"filter": ["pages", ">", 5], "target": target})) is ProblemKind.SCHEMA
    for a in ({"type": "count"}, {"column": "shelf", "type": "mode"}, {"column": "shelf", "name": "x"}, {"column": "shelf", "type": "sumPerValue"}, {"column": "shelf", "type": "count", "otherColumn": "fine"}, {"column": "shelf", "type": "countPerValue", "top": 0}):
        assert outcome({"query": {"aggregations": [a]}}) is ProblemKind.SCHEMA
    assert outcome(one({"filter": ["shelf", "regex", "A."]})) is ProblemKind.SCHEMA and outcome(one({"filter": ["pages", ">", 5], "filters": []})) is ProblemKind.SCHEMA


def test_names():
    for name in ("7th", "a b", "", " thick", "thick ", "$thick", "a-b", "or", "AND", "||", "é"):
        assert outcome(one({"name": name, "filter": ["pages", ">", 5]})) is ProblemKind.SCHEMA, name
    for name in ("t", "T_2", "thick_books"):
        assert outcome(one({"name": name, "filter": ["pages", ">", 5]}, relation=f"${name.upper()}")) is None
    twice = [{"name": n, "filter": ["pages", ">", 5]} for n in ("thick", "Thick")]
    assert outcome({"query": {"conditions": twice}}) is ProblemKind.SCHEMA
    assert outcome({"query": {"aggregations": [{"column": "shelf", "type": t, "name": "same"} for t in ("count", "countPerValue")]}}) is ProblemKind.SCHEMA


def test_relations_of_queries():
    three = [{"filter": ["pages", ">", n]} for n in range(3)]
    for word in ("and", "OR", "&&", "||"):
        assert check({"query": {"conditions": three, "relation": word}}, CONTEXT).expanded["query"]["relation"] == f" {word.lower()} ".join(f"${i}" for i in range(3))
    assert check({"query": {"conditions": three}}, CONTEXT).expanded["query"]["relation"] == "$0 and $1 and $2"
    assert check({"query": {"conditions": three, "relation": "$2"}}, CONTEXT).used_conditions == [2]
    for relation, conditions in (("$3", three), ("$0 $1", three), ("and", []), ("$0", None)):
        assert outcome({"query": {"relation": relation, **({} if conditions is None else {"conditions": conditions})}}) is ProblemKind.RELATION


def test_timeframes():
    for frame, expected in (
        ({"from": 30_000}, None), ({"to": 30_000}, None), ({"from": 30_000, "to": 30_001}, None), ({}, None),
        ({"from": 5, "to": 4}, ProblemKind.SCHEMA), ({"from": 4, "to": 4}, ProblemKind.SCHEMA), ({"from": -4}, ProblemKind.SCHEMA), ({"from": 4.5}, ProblemKind.SCHEMA),
        ({"from": 30_000_000}, ProblemKind.TYPE_MISMATCH), ({"to": 3}, ProblemKind.TYPE_MISMATCH),
    ):
        assert outcome({"timeframe": frame}) is expected, frame


def test_without_a_dataset():
    assert outcome({}, None) is ProblemKind.INVALID_ARGUMENTS and outcome(full_query(), None, schema_only=True) is None
    for odd in ([], "x", 3, None):
        assert outcome(odd) is ProblemKind.SCHEMA


def test_what_has_no_effect_is_said():
    q = full_query()
    q["funnel"]["maxDuration"] = 60
    q["query"]["conditions"][2]["sequence"][1]["rowFound"] = True
    assert len(check(q, CONTEXT).warnings) == 2
    assert check(full_query(), CONTEXT).differences() and not check(expand(full_query()), CONTEXT).differences()


def test_paths():
    doc = {"shelves": [{"books": [4, 9]}, {"books": [7]}, {"empty": True}]}
    assert paths.values(doc, "shelves.books") == [4, 9, 7] and paths.values(doc, "shelves.none") == []
    before = copy.deepcopy(doc)
    paths.change(doc, "shelves.books", lambda n: None if n == 9 else -n)
    assert doc == {"shelves": [{"books": [-4]}, {"books": [-7]}, {"empty": True}]} and before != doc
