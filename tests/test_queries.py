"""Every registered query against its DuckDB counterpart on the smallest tables."""

import glob
import os

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from tools.check import norm

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _canonical(rows, columns):
    order = sorted(columns)
    return sorted((tuple(norm(r[columns.index(c)]) for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = _canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == _canonical(cursor.fetchall(), names)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["doc_id", "redacted"]
    assert df.count() > 0
