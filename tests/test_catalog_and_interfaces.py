import json
import random
import threading
import urllib.error
import urllib.request

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pathlume.api import Lume
from pathlume.cli import main
from pathlume.server import serve
from pathlume.sources.catalog import Catalog, RegistrationError, ValidationMode, files_to_check
from pathlume.sources.storage import discover_files, read_csv, write_rows

PARTS, ROWS = 4, 200


def part(i, **changed):
    base = 1609459200000
    n = list(range(ROWS))
    columns = {
        "user": pa.array([100_000 * i + k % 40 for k in n], pa.int64()),
        "ts": pa.array([base + 1000 * i + k for k in n], pa.int64()),
        "small": pa.array([k % 100 for k in n], pa.uint32()),
        "f": pa.array([float("nan") if k in (0, ROWS - 1) else k / 7 for k in n], pa.float32()),
        "none_f": pa.array([None] * ROWS, pa.float64()),
        "few": pa.array(["0"] * 180 + ["1"] * 14 + ["2"] * 4 + ["3"] * 2, pa.string()),
        "many": pa.array([str(k) for k in n], pa.string()).dictionary_encode(),
        "none_s": pa.array([None] * ROWS, pa.string()),
        "flag": pa.array([k % 2 == 0 for k in n], pa.bool_()),
        "when": pa.array(pd.to_datetime([0] * ROWS)),
        "lists": pa.array([[1, 2]] * ROWS, pa.list_(pa.int32())),
    }
    return pa.table({**columns, **changed})


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "data"
    base.mkdir()
    for i in range(PARTS):
        pq.write_table(part(i), base / f"part{i}.parquet", coerce_timestamps="us")
    pq.write_table(part(9), base / "other.pq", coerce_timestamps="us")
    (base / "notes.txt").write_text("x")
    return base


@pytest.fixture
def lume(spark, tmp_path):
    return Lume(spark, str(tmp_path / "catalog"))


def test_files_are_found_by_pattern_and_sampled_without_repetition(spark, folder):
    found = discover_files(spark, str(folder))
    assert found.names == tuple(f"part{i}.parquet" for i in range(PARTS)) and found.total_bytes == sum((folder / n).stat().st_size for n in found.names)
    assert discover_files(spark, f"file://{folder}/", "*.pq").names == ("other.pq",) and discover_files(spark, str(folder), "*.csv").names == ()
    with pytest.raises(FileNotFoundError):
        discover_files(spark, str(folder / "nowhere"))
    names = [f"{i:03}" for i in range(200)]
    sample = files_to_check(names, ValidationMode.SAMPLE, random.Random(0))
    assert sample[:2] == ["000", "199"] and len(sample) == len(set(sample)) == 12
    assert files_to_check(names, ValidationMode.SINGLE, None) == ["000"] and files_to_check(names[:2], ValidationMode.SAMPLE, None) == names[:2] and files_to_check([], ValidationMode.SAMPLE, None) == []


def test_registration_profiles_columns(spark, folder, tmp_path):
    d = Catalog(spark, str(tmp_path / "c")).register("d", str(folder), "user", "ts", mode=ValidationMode.ALL)
    assert d.columns == {"user": "INT", "ts": "INT", "small": "INT", "f": "FLOAT", "none_f": "FLOAT", "few": "STRING", "many": "STRING", "none_s": "STRING", "flag": "BOOL"}
    assert set(d.unsupported) == {"when", "lists"}
    assert d.numeric["small"] == [0.0, 99.0] and d.numeric["none_f"] == [None, None] and d.min_timestamp == 1609459200000
    assert d.text["few"] == {"categorical": True, "ratio": 4 / (PARTS * ROWS), "top": {"0": 0.9, "1": 0.07, "2": 0.02, "3": 0.01}}
    assert d.text["many"]["categorical"] is False and d.text["none_s"]["categorical"] is False
    assert d.short_schema()["potentialCategoricals"] == ["few"] and d.full_schema()["columns"]["few"]["catTopValues"]["0"] == 0.9
    assert d.parts()["totalParts"] == PARTS and "user" in d.full_schema()["columns"]


@pytest.mark.parametrize(
    ("changed", "group", "time", "message"),
    [
        ({"user": pa.array([None] * ROWS, pa.int64())}, "user", "ts", "null"),
        ({}, "f", "ts", "whole numbers or text"),
        ({}, "user", "f", "null or NaN"),
        ({}, "user", "few", "numbers or timestamps"),
        ({}, "nope", "ts", "no column"),
        ({"extra": pa.array([1] * ROWS)}, "user", "ts", "columns of"),
        ({"small": pa.array(["x"] * ROWS)}, "user", "ts", "columns of"),
    ],
)
def test_registrations_that_are_refused(spark, folder, tmp_path, changed, group, time, message):
    pq.write_table(part(PARTS - 1, **changed), folder / f"part{PARTS - 1}.parquet", coerce_timestamps="us")
    with pytest.raises(RegistrationError, match=message):
        Catalog(spark, str(tmp_path / "c")).register("d", str(folder), group, time)


def test_groups_in_two_files_are_refused_unless_allowed(spark, folder, tmp_path):
    pq.write_table(part(0), folder / "part3.parquet", coerce_timestamps="us")
    catalog = Catalog(spark, str(tmp_path / "c"))
    with pytest.raises(RegistrationError, match="more than one file"):
        catalog.register("d", str(folder), "user", "ts", mode=ValidationMode.FIRST_LAST)
    assert catalog.register("d", str(folder), "user", "ts", validate_uniques=False).name == "d"
    with pytest.raises(RegistrationError, match="no files"):
        catalog.register("e", str(folder), "user", "ts", pattern="*.x")
    with pytest.raises(RegistrationError, match="no name"):
        catalog.register("../e", str(folder), "user", "ts")


QUERY = {"query": {"conditions": [{"filter": ["small", ">", 95], "target": ["count", ">=", 1]}], "aggregations": [{"column": "few", "type": "countPerValue"}]}, "funnel": {"sequence": [{"filter": ["few", "==", "0"]}, {"filter": ["few", "==", "3"]}]}}


def test_life_of_a_dataset(lume, folder):
    assert lume.list_datasets() == [] and lume.run_query("d", {})["errorKind"] == "INVALID_ARGUMENTS" and lume.get_dataset_schema("d") is None
    assert lume.register_dataset("d", str(folder), "user", "ts")["dataset"]["totalParts"] == PARTS
    first = lume.get_dataset("d").identity
    got = lume.run_query("d", QUERY)
    assert got["success"] and got["query"]["matchingGroups"] == PARTS * 8 and got["query"]["aggregations"][0]["top"] == 10 and len(got["funnel"]["sequence"]) == 2
    assert got["stats"]["dataset"]["totalParts"] == PARTS and got["stats"]["cost"] is None
    assert not lume.unregister_dataset("d")["success"]  # used just now
    assert lume.register_dataset("d", str(folder), "user", "ts")["success"] and lume.get_dataset("d").identity != first and lume.catalog.last_used("d") is None
    assert lume.run_query("d", {"timeframe": {"from": 12}})["errorKind"] == "TYPE_MISMATCH"
    assert lume.unregister_dataset("d")["success"] and lume.unregister_dataset("d") == {"success": True, "datasetFound": False, "datasetLastUsed": None}
    assert lume.expand_and_validate_query(None, {}, schema_only=True).success and not lume.expand_and_validate_query(None, {}).success


def test_progress_then_result(lume, folder):
    lume.register_dataset("d", str(folder), "user", "ts")
    *before, last = lume.stream_query("d", QUERY, every_s=0.02)
    assert last["success"] and all(b["requestId"] == last["requestId"] and b["progress"]["failed"] == 0 for b in before)


def test_http(lume, folder):
    server = serve(lume, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode() if body is not None else None)
        try:
            with urllib.request.urlopen(request) as answer:
                return answer.status, answer.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert call("/datasets/register", {"name": "d"})[0] == 400
        status, text = call("/datasets/register", {"name": "d", "basepath": str(folder), "groupIdColumn": "user", "timestampColumn": "ts", "validationMode": "FIRST_LAST"})
        assert status == 200 and json.loads(text)["success"]
        assert [d["name"] for d in json.loads(call("/datasets")[1])] == ["d"]
        assert "few" in json.loads(call("/datasets/d/schema?full=true")[1])["columns"] and json.loads(call("/datasets/d/parts")[1])["totalParts"] == PARTS
        assert json.loads(call("/datasets/d/empty-query")[1])["query"]["matchingGroupRows"] == PARTS * ROWS
        assert json.loads(call("/datasets/d/query", QUERY)[1])["success"] and call("/datasets/d/query", {"x": 1})[0] == 400
        lines = call("/datasets/d/query?stream=true", QUERY)[1].strip().split("\n")
        assert json.loads(lines[-1])["success"]
        assert call("/datasets/x/schema")[0] == 404 and call("/nowhere")[0] == 404
        assert json.loads(call("/datasets/d/unregister", {"force": True})[1])["success"]
    finally:
        server.shutdown()


def test_command_line(spark, folder, tmp_path, capsys):
    def run(*args):
        code = main(["--catalog", str(tmp_path / "c"), *args], spark)
        return code, json.loads(capsys.readouterr().out)

    assert run("register", "d", str(folder), "user", "ts")[0] == 0
    assert run("list")[1][0]["name"] == "d" and run("info", "d", "--full")[1]["groupIdColumn"] == "user"
    assert run("run", "d", "--empty")[1]["query"]["matchingGroups"] == PARTS * 40
    (tmp_path / "q.json").write_text(json.dumps(QUERY))
    assert run("run", "d", "--file", str(tmp_path / "q.json"))[1]["success"]
    assert run("run", "d", "--string", "{not json")[0] == 1 and run("run", "nope", "--empty")[0] == 1 and run("info", "nope")[0] == 1
    assert run("config")[1]["aggregations.top.default"] == 10
    assert run("unregister", "d", "--force")[0] == 0


def test_csv_and_parquet_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "i long, s string")
    for ending in ("csv", "parquet"):
        write_rows(df, str(tmp_path / f"t.{ending}"))
    assert read_csv(spark, str(tmp_path / "t.csv"), "i long, s string").orderBy("i").collect() == df.collect() == spark.read.parquet(str(tmp_path / "t.parquet")).orderBy("i").collect()
    with pytest.raises(ValueError):
        write_rows(df, str(tmp_path / "t.xls"))
