"""Every query over tables against DuckDB on the same files."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import model_queries, table_queries

QUERIES = {**table_queries.QUERIES, **model_queries.QUERIES}
ORACLE_SQL = {**table_queries.ORACLE_SQL, **model_queries.ORACLE_SQL}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(str(tuple(None if v is None or v != v else v for v in r)) for r in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, sf, duck, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "graphloom.llm", None)
    assert set(entry.queries()) == set(QUERIES)
