"""Every query with an SQL twin gives its rows at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tonewright import queries

DIR = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    assert cols == sorted(rel.columns)
    want = sorted([plain(r[rel.columns.index(c)]) for c in cols] for r in rel.fetchall())
    assert sorted([plain(r[c]) for c in cols] for r in df.collect()) == want


def test_contract(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in set(queries.QUERIES) - set(queries.ORACLES):
        queries.QUERIES[name](spark, DIR).collect()
