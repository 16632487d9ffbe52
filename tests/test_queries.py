"""Each query against its SQL in DuckDB, value by value."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, sf, name):
    got = contract.queries()[name](spark, sf)
    cols = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert mine == theirs


def test_entry(spark):
    got = contract.entry(spark)
    assert got.columns == ["site", "user", "item", "score"] and got.count() > 0
