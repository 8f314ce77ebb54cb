"""Every query of the core that has SQL gives, on the smallest tables, what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from cairn.plans import oracles, queries

NAMES = sorted(oracles.oracle_sql())
#: Queries that SQL can't express, with the tests that hold them against something else.
OTHERWISE = {"prose_chunks": "test_store_and_stream.py"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat()[:19] if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    df = queries.queries()[name](spark, data)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=str)
    result = duck.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert found == sorted((tuple(plain(row[i]) for i in places) for row in result.fetchall()), key=str)


def test_every_query_is_compared():
    assert set(queries.queries()) == set(NAMES) | set(OTHERWISE)
