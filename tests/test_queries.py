"""Every query with SQL gives what the SQL gives; all others run."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
CORE = sorted(name for name in entry.queries() if not name.startswith(("p4_", "p6_", "p7_", "p8_")))


@pytest.fixture(scope="module")
def tables():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def canonical(df: pd.DataFrame) -> list[tuple]:
    text = lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.15g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in entry.oracle_sql():
        expected = tables.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(expected.columns) and canonical(got) == canonical(expected)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
