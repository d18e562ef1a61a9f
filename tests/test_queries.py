"""Every query of the library against its DuckDB twin on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from corpusflow.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")
    con.execute("set timezone='UTC'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in SQL:
        assert len(set(columns)) == len(columns)
        return
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == want


def test_entry_point():
    import __spark_entry__ as e

    assert set(SQL) <= set(QUERIES) <= set(e.queries())
