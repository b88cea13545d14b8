"""Every query that has SQL, against DuckDB on the same tables; the others run and keep their columns."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if isinstance(v, Decimal) else v


def table_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    expected = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert table_of(df.collect(), df.columns) == table_of(expected.fetchall(), expected.columns)


def test_sql_has_queries():
    assert SQL.keys() <= entry.queries().keys()


def test_flagship(spark):
    assert entry.entry(spark).columns == ["value"]
