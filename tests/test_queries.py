"""Every registered query against its DuckDB oracle on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(__spark_entry__.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = __spark_entry__.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    theirs = duck.sql(__spark_entry__.ORACLES[name])
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert mine == sorted(repr(tuple(plain(r[i]) for i in at)) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.QUERIES) - set(__spark_entry__.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert __spark_entry__.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
