"""Every registered query against the same question put to DuckDB, on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry
from ledgerloom.plans.catalog import REGISTERS
from tests.conftest import SMALL, plan

QUERIES = {name: run for register in REGISTERS for name, run in register.queries.items()}
ORACLES = {name: sql for register in REGISTERS for name, sql in register.sql.items()}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, folder, duck, capsys, name):
    df = QUERIES[name](spark, folder)
    text = plan(df, capsys)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "InPandas" not in text
    got = df.collect()
    assert got
    if name not in ORACLES:
        return
    answer = duck.execute(ORACLES[name])
    names = [column[0] for column in answer.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(row[names.index(c)] for c in df.columns) for row in answer.fetchall()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(row)) for row in got)


def test_entry(spark):
    totals = entry(spark).agg({"amount": "sum", "lines": "sum"}).head()
    assert all(v > 0 for v in totals)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
