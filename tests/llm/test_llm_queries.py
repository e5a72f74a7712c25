"""Queries of the subpackage with SQL give what the SQL gives."""

import glob
import os

import pytest

from pathlume.llm import queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def tables():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query(spark, tables, name):
    got, expected = q.QUERIES[name](spark, DATA).toPandas(), tables.execute(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    rows = lambda df: sorted(tuple(str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(expected)
