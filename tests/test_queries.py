"""Registered queries against their SQL in DuckDB."""

import math
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
# Minutes of small jobs; test_grid holds the same code against dense fits on smaller input.
LONG = {"tron_grid", "sweep_wide"}


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def comparable(row):
    def one(v):
        return ("nan" if math.isnan(v) else repr(round(v, 9))) if isinstance(v, float) else str(v)
    return tuple(one(v) for v in row)


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - LONG))
def test_query_equals_sql(spark, connection, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = connection.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(comparable([r[i] for i in places]) for r in cursor.fetchall())
    assert sorted(comparable([r[c] for c in columns]) for r in df.collect()) == expected


def test_entry(spark):
    row = entry(spark).first()
    assert row["n"] == 1000 and 0 <= row["accuracy"] <= 1 and 0 <= row["auc"] <= 1


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
