import json
import random

import pytest

from pathlume.operators import schema_drift as sd

FILES = "dataset_name string, part_idx int, filename string, written_at string"
COLUMNS = "dataset_name string, filename string, ordinal int, column_name string, dtype_name string"
ROWS = "dataset_name string, filename string, row_no int, payload string, filename_note string"


def test_payloads_that_were_cut_off_keep_their_whole_pairs():
    whole = '{"a": 1, "b": "x, \\"y\\": 2", "c": [1, 2], "d": null, "e": true, "f": 2.5}'
    assert sd.read_payload(whole) == (json.loads(whole), True)
    assert sd.read_payload(whole[:-8]) == ({"a": 1, "b": 'x, "y": 2', "c": [1, 2], "d": None, "e": True}, False)
    assert sd.read_payload('{"a": 12') == ({}, False) and sd.read_payload('{"a": 12,') == ({"a": 12}, False)
    assert sd.read_payload(None) == sd.read_payload("") == sd.read_payload("[1]") == ({}, False)
    assert sd.read_payload("x" * 100_000) == ({}, False)


def test_values_are_alike_whatever_their_type():
    assert sd.canonical_text(5.0) == sd.canonical_text("5") == sd.canonical_text(5) == ("5", 5.0)
    assert sd.canonical_text(True) == sd.canonical_text("True") == sd.canonical_text(1)
    assert sd.canonical_text(["a", "b"]) == ("a|b", None)
    assert [sd.cast_value("1.5", k) for k in ("INT", "FLOAT", "STRING", "BOOL")] == [None, 1.5, "1.5", None]
    assert sd.cast_value("x", "INT") is None and sd.cast_value(True, "STRING") == "true" and sd.cast_value(None, "INT") is None
    assert sd.wider({"INT", "FLOAT"}) == "FLOAT" and sd.wider({"BOOL", "STRING"}) == "STRING"
    assert [sd.logical_type_of(t) for t in ("Int64", "uint32", "float32", "boolean", "category", "object", "list<string>", None)] == ["INT", "INT", "FLOAT", "BOOL", "STRING", "STRING", "OTHER", "OTHER"]


class Feed:
    def __init__(self, seed=3):
        self.rng, self.files, self.columns, self.rows = random.Random(seed), [], [], []

    def value(self, what):
        r = self.rng
        return {"id": lambda: r.randrange(10**6, 2 * 10**6), "mood": lambda: r.choice(["calm", "rushed", "curious"]), "city": lambda: r.choice(["Rome", "Oslo", "Lima"]), "weight": lambda: round(r.uniform(0.1, 0.9), 3), "price": lambda: round(r.uniform(100, 900), 2), "ok": lambda: r.random() < 0.5}[what]()

    def file(self, idx, columns, recorded=True, n=25, dataset="f"):
        """columns: {name: (content, dtype, how to write it)}"""
        name = f"part {idx}.parquet"
        self.files += [(dataset, idx, name, "late")] * (2 if idx == 2 else 1)
        if recorded:
            self.columns += [(dataset, name, i, c, spec[1]) for i, (c, spec) in enumerate(columns.items())]
        for i in range(n):
            row = {c: spec[2](self.value(spec[0])) for c, spec in columns.items() if self.rng.random() > 0.1}
            text = json.dumps(row)
            self.rows.append((dataset, name, i, text[: len(text) // 2] if i == 7 else text, "clash"))
        self.rows.append(self.rows[-1])

    def drift(self, spark):
        return sd.SchemaDrift(spark.createDataFrame(self.files, FILES), spark.createDataFrame(self.columns, COLUMNS), spark.createDataFrame(self.rows, ROWS))


SAME = lambda x: x


@pytest.fixture(scope="module")
def drift(spark):
    feed = Feed()
    base = {"uid": ("id", "int64", SAME), "mood": ("mood", "object", SAME), "w": ("weight", "float64", SAME)}
    feed.file(1, base)
    feed.file(2, {"uid": ("id", "int32", SAME), "w": ("weight", "float32", SAME), "mood": ("mood", "category", SAME)})  # width, encoding, order: nothing
    feed.file(4, {"userId": ("id", "string", str), "mood": base["mood"], "w": base["w"], "ok": ("ok", "bool", SAME)})  # a gap in the index; renamed and retyped; added
    feed.file(5, {"userId": ("id", "string", str), "city": ("city", "string", SAME), "w": base["w"], "ok": ("ok", "int64", int)}, recorded=False)  # other content; retyped
    feed.file(10, {"userId": ("id", "string", str), "city": ("city", "string", SAME), "weight": base["w"]})  # removed; renamed
    feed.file(11, {"userId": ("id", "string", str), "city": ("city", "string", SAME), "price": ("price", "float64", SAME)})  # another number: removed and added
    feed.file(1, base, dataset="alone")
    return feed.drift(spark), feed


def test_every_change_is_listed_once(drift):
    got = sorted(tuple(r)[1:2] + tuple(r)[3:] for r in drift[0].steps().collect())
    assert got == sorted(
        [
            ("part 4.parquet", "renamed", "uid", "userId"), ("part 4.parquet", "retyped", "uid", "userId"), ("part 4.parquet", "added", "", "ok"),
            ("part 5.parquet", "removed", "mood", ""), ("part 5.parquet", "added", "", "city"), ("part 5.parquet", "retyped", "ok", "ok"),
            ("part 10.parquet", "removed", "ok", ""), ("part 10.parquet", "renamed", "w", "weight"),
            ("part 11.parquet", "removed", "weight", ""), ("part 11.parquet", "added", "", "price"),
        ]
    )


def test_versions_follow_the_fingerprints(drift):
    got = {(r["dataset_name"], r["part_idx"]): r["version"] for r in drift[0].versions.collect()}
    assert got == {("f", 1): 1, ("f", 2): 1, ("f", 4): 2, ("f", 5): 3, ("f", 10): 4, ("f", 11): 5, ("alone", 1): 1}


def test_all_rows_come_under_one_schema(drift):
    of, feed = drift
    rows = [r for r in of.table().collect() if r["dataset_name"] == "f"]
    assert len(rows) == 6 * 25
    for r in rows:
        record = json.loads(r["record"])
        assert set(record) == {"userId", "mood", "weight", "ok", "city", "price"}
        assert record["userId"] is None or isinstance(record["userId"], str)
        assert record["ok"] is None or type(record["ok"]) is int
    assert sum(not r["whole"] for r in rows) == 6
    given = {(r[1], r[2]): json.loads(r[3]) for r in feed.rows if r[0] == "f" and r[3].endswith("}")}
    first = next(r for r in rows if (r["filename"], r["row_no"]) == ("part 1.parquet", 3))
    assert json.loads(first["record"])["weight"] == given["part 1.parquet", 3].get("w")


def test_empty_feeds(spark):
    of = sd.SchemaDrift(spark.createDataFrame([], FILES), spark.createDataFrame([], COLUMNS), spark.createDataFrame([], ROWS))
    assert of.steps().count() == 0 and of.table().count() == 0
    lost = sd.SchemaDrift(spark.createDataFrame([("f", 1, "a", ""), (None, 2, "b", "")], FILES), spark.createDataFrame([("f", "a", 0, "x", None)], COLUMNS), spark.createDataFrame([("f", "a", 0, None, ""), (None, None, None, "{}", "")], ROWS))
    assert lost.steps().count() == 0 and [r["record"] for r in lost.table().collect()] == ['{"x": null}']


def test_casts_keep_figures_and_record_what_is_lost(drift, spark):
    assert sd.cast_value("9007199254740993", "INT") == 9007199254740993 and sd.cast_value(2**60 + 1, "INT") == 2**60 + 1
    assert sd.cast_value("3.7", "INT") is None and sd.cast_value(3.7, "INT") is None and sd.cast_value("3.0", "INT") == 3 and sd.cast_value(True, "INT") == 1
    feed = Feed()
    feed.file(1, {"n": ("id", "int64", lambda v: "3.7" if v % 2 else v)})
    of = feed.drift(spark)
    rows = of.table().collect()
    assert {tuple(r["failed"]) for r in rows} <= {(), ("n",)} and all(json.loads(r["record"])["n"] is None for r in rows if r["failed"]) and 0 < sum(bool(r["failed"]) for r in rows) < len(rows)


def test_texts_alike_in_their_first_forty_characters_differ():
    start = "".join("aB0-"[i % 4] for i in range(60))
    summary = lambda tail: {"value": {str(i): 1 for i in range(200)} if tail == "x" else {str(i + 300): 1 for i in range(200)}, "form": sd_form(start + tail)}
    assert sd.content_likeness(summary("x"), summary("-0-0-")) < sd.SAME_CONTENT


def sd_form(text):
    parts = list(sd._summaries(iter([sd.pd.DataFrame({"dataset_name": ["f"] * 200, "filename": ["a"] * 200, "payload": [json.dumps({"c": text})] * 200})])))
    return {b: int(n) for b, n in sd.pd.concat(parts).query("view == 'form'")[["bin", "n"]].itertuples(index=False)}


def test_likeness_has_no_cliff_in_the_number_of_values():
    def pair(k):
        a, b = ({str(i + shift): 10 for i in range(k)} for shift in (0, k // 10))
        return {"value": a, "form": {"a": 10 * k}}, {"value": b, "form": {"a": 10 * k}}

    scores = [sd.content_likeness(*pair(k)) for k in range(30, 140)]
    assert max(abs(x - y) for x, y in zip(scores, scores[1:])) < 0.1


def test_typed_cells_and_feeds(drift):
    of, _ = drift
    cells = of.cells().filter("dataset_name = 'f'").collect()
    assert len(cells) == 6 * 25 * 6
    kinds = {r["column_name"]: r["logical"] for r in cells}
    assert kinds == {"userId": "STRING", "mood": "STRING", "weight": "FLOAT", "ok": "INT", "city": "STRING", "price": "FLOAT"}
    assert all((r["float_value"] is None) or r["logical"] == "FLOAT" for r in cells)
    feed = of.feed("f")
    assert dict(feed.dtypes) | {"filename": "string"} == {"filename": "string", "row_no": "int", "userId": "string", "mood": "string", "weight": "double", "ok": "bigint", "city": "string", "price": "double"}
    assert feed.count() == 150 and of.feed("none").columns == ["filename", "row_no"]
