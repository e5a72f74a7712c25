import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pathlume.operators import column_profile as cp


def table_of(rows, names=("load_no", "i", "f", "b", "s")):
    kinds = {"load_no": pa.int64(), "i": pa.int64(), "f": pa.float64(), "b": pa.bool_(), "s": pa.string()}
    return pa.table({n: pa.array([r[k] for r in rows], kinds[n], from_pandas=False) for k, n in enumerate(names)})


def random_rows(seed, n=600):
    rng = random.Random(seed)
    return [(i * 5 // n if rng.random() < 0.97 else rng.randrange(5), rng.choice([None, rng.randrange(50)]), rng.choice([None, math.nan, -0.0, 0.0, rng.random() * 9]), rng.choice([None, True, False]), rng.choice([None, "", " x", "X", f"t{rng.randrange(90)}", "Ünï", "y" * 500])) for i in range(n)]


def brute(rows):
    out = {}
    for k, name in enumerate("ifbs", 1):
        for load in {r[0] for r in rows}:
            own = [r[k] for r in rows if r[0] == load]
            some = [x for x in own if x is not None and x == x]
            ends = (float(min(some)), float(max(some))) if some and name in "if" else (None, None)
            out[name, load] = (len(own), len(own) - len(some), len(set(some)), *ends)
    return out


@pytest.mark.parametrize(("row_group", "dictionary"), [(1000, True), (60, True), (37, False)])
def test_profiles_equal_brute_force(spark, tmp_path, row_group, dictionary):
    rows = random_rows(row_group)
    (tmp_path / "t.parquet").mkdir()
    for i in range(2):
        pq.write_table(table_of(rows[i * 300 : (i + 1) * 300]), tmp_path / "t.parquet" / f"p{i}.parquet", row_group_size=row_group, use_dictionary=dictionary)
    profiles = cp.TableProfiles({"t": spark.read.parquet(str(tmp_path / "t.parquet"))}, {"t": list("ifbs")}).profiles()
    got = {(r["column_name"], r["load_no"]): (r["n_rows"], r["n_null"], r["n_distinct"], r["numeric_min"], r["numeric_max"]) for r in profiles.collect()}
    assert got == brute(rows)


def test_constant_and_all_null_chunks_are_not_read(tmp_path, monkeypatch):
    pq.write_table(table_of([(3, 7, None, True, None)] * 20), tmp_path / "t.parquet")
    read = []
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda *a, **k: read.append(k) or pytest.fail("a chunk was read"))
    parts = pd.concat(list(cp._partials_of(f"file://{tmp_path}/t.parquet", 0, [(0, "i", "INT"), (1, "f", "FLOAT"), (2, "b", "BOOL"), (3, "s", "STRING")], "load_no")))
    assert not read and parts[parts["view"] == cp.NULLS].groupby("column_id")["n"].sum().to_dict() == {0: 0, 1: 20, 2: 0, 3: 20}


def test_rows_without_a_load_number_belong_to_no_load(spark, tmp_path):
    rows = [(None, 7, 1.0, True, "a")] * 900 + [(load, 8, 1.0, True, "a") for load in (-1, 0, 1, 2) for _ in range(50)]
    pq.write_table(table_of(rows), tmp_path / "t.parquet")
    of = cp.TableProfiles({"t": spark.read.parquet(str(tmp_path / "t.parquet"))}, {"t": ["i"]})
    assert {(r["load_no"], r["n_rows"]) for r in of.profiles().collect()} == {(None, 900), (-1, 50), (0, 50), (1, 50), (2, 50)}
    assert of.departures().count() == 0


def test_whole_numbers_beyond_the_exact_floating_ones_are_distinct(spark, tmp_path):
    pq.write_table(table_of([(1, v, 1.0, True, "a") for v in (2**53, 2**53 + 1, -(2**60), -(2**60) + 1)]), tmp_path / "t.parquet")
    of = cp.TableProfiles({"t": spark.read.parquet(str(tmp_path / "t.parquet"))}, {"t": ["i"]})
    assert of.profiles().first()["n_distinct"] == 4


def test_names_of_object_storage_are_understood(monkeypatch):
    import pyarrow.fs as pafs

    asked = []
    monkeypatch.setattr(pafs, "S3FileSystem", lambda **options: asked.append(options) or "store")
    assert cp._file_system("s3a://box/a%20b/part.parquet", {"access_key": "k"}) == ("store", "box/a b/part.parquet") and asked == [{"access_key": "k"}]


def test_empty_tables_have_no_profile(spark, tmp_path):
    pq.write_table(table_of([]), tmp_path / "t.parquet")
    of = cp.TableProfiles({"t": spark.read.parquet(str(tmp_path / "t.parquet"))}, {"t": list("ifbs")})
    assert of.profiles().count() == 0 and of.departures().count() == 0


def counts(shares, sizes, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame([rng.multinomial(n, s) for s, n in zip(shares, sizes)])


def test_departing_loads_stand_out_and_chance_does_not():
    usual = np.array([0.5, 0.3, 0.15, 0.05])
    for seed in range(30):
        sizes = np.random.default_rng(seed).integers(200, 2000, 24)
        assert cp.departures(counts([usual] * 24, sizes, seed)).empty
        odd = [usual] * 22 + [0.7 * usual + 0.3 * np.array([0, 0, 0, 1])] * 2
        assert set(cp.departures(counts(odd, sizes, seed)).index) == {22, 23}
    small = [usual] * 11 + [0.98 * usual + 0.02 * np.array([0, 0, 0, 1])]
    assert cp.departures(counts(small, [50_000] * 12)).empty  # a fiftieth is no case however sure it is
    assert cp.departures(counts([usual] * 2, [100] * 2)).empty


def test_records(spark):
    profiles = spark.createDataFrame(
        [("t", 1, "i", 10, 0, 5, 1.0, 9.0, "INT"), ("t", 2, "i", 10, 10, 0, None, None, "INT"), ("t", 1, "s", 10, 0, 5, None, None, "STRING"), ("t", 3, "s", 10, 0, 5, None, None, "STRING"), ("t", 1, "b", 10, 0, 2, None, None, "BOOL")],
        "dataset_name string, load_no long, column_name string, n_rows long, n_null long, n_distinct long, numeric_min double, numeric_max double, kind string",
    )
    schema = "dataset_name string, load_no long, column_name string, numeric_min double, numeric_max double, cat_unique_ratio double, registered_at int"
    found = lambda *records: {tuple(r) for r in cp.disagreeing_records(profiles, spark.createDataFrame(list(records), schema)).collect()}
    assert found(("t", 1, "i", 1.0, 9.0, None, 1), ("t", 1, "s", None, None, 0.5, 1), ("t", 2, "i", math.nan, None, None, 1), ("t", 9, "i", 5.0, 5.0, None, 1), ("t", 1, "b", 5.0, 5.0, 5.0, 1)) == set()
    assert found(("t", 1, "i", 1.0, 9.0, None, 1), ("t", 1, "i", 1.0, 9.1, None, 2), ("t", 1, "i", 1.0, 9.1, None, 2)) == {("t", 1, "i")}  # the latest counts, repeated or not
    assert found(("t", 1, "s", None, None, None, 1), ("t", 3, "s", None, None, 0.5000004, 1), ("t", 2, "i", 1.0, None, None, 1)) == {("t", 1, "s"), ("t", 2, "i")}


def test_distinct_ratios_of_loads_of_any_size():
    rng = np.random.default_rng(3)

    def often(loads):
        found = []
        for load, values in enumerate(loads):
            times = pd.Series(values).value_counts().value_counts()
            found += [(load, n, n * k) for k, n in times.items()]
        return pd.DataFrame(found, columns=["load_no", "n", "of"])

    usual = [rng.integers(0, 2000, n) for n in (1000, 1100, 900, 1050, 950, 1000)]
    sizes = [rng.integers(0, 2000, 20_000), rng.integers(0, 2000, 60)]  # their ratios differ by their size alone
    assert cp.equal_size_departures(often(usual + sizes)).empty
    odd = [rng.integers(0, 200, 20_000), rng.integers(0, 9, 60), np.arange(20_000)]  # a hot load frozen to few values, a small one, all distinct
    assert list(cp.equal_size_departures(often(usual + sizes + odd)).index) == [8, 9, 10]
    assert cp.equal_size_departures(often(usual[:2])).empty


def test_a_hot_load_is_judged_on_its_distinct_ratio(spark, tmp_path):
    rng = random.Random(4)
    rows = [(load, rng.randrange(100_000, 110_000) if load else 100_000 + 250 * rng.randrange(40), 1.0, True, "a") for load in range(6) for _ in range(300 if load else 3000)]
    pq.write_table(table_of(rows), tmp_path / "t.parquet")
    found = cp.TableProfiles({"t": spark.read.parquet(str(tmp_path / "t.parquet"))}, {"t": ["i"]}).histograms
    judged = cp.departing_loads(found).filter(cp.F.col("view") == cp.DISTINCT_RATIO).collect()
    assert [(r["column_id"], r["load_no"]) for r in judged] == [(0, 0)]


def test_a_tail_of_other_values_of_the_same_size_and_form_shows(spark, tmp_path):
    rng = random.Random(8)
    value = lambda odd: 100_000 + 2 * rng.randrange(2000) + odd
    rows = [(load, v := value(load == 4), 1.0, True, f"t{v}") for load in range(8) for _ in range(1500)]
    pq.write_table(table_of(rows), tmp_path / "t.parquet")
    departing = cp.TableProfiles({"t": spark.read.parquet(str(tmp_path / "t.parquet"))}, {"t": ["i", "s"]}).departures()
    assert {(r["column_name"], r["load_no"]) for r in departing.collect()} == {("i", 4), ("s", 4)}
