"""Every registered query against its SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from lectern.plans import catalogue

from . import test_brute_force

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    result = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == expected


def test_every_query_is_checked():
    """A query without SQL has a test against plain Python."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {n.removeprefix("test_") for n in vars(test_brute_force) if n.removeprefix("test_") in catalogue.QUERIES} - set(catalogue.ORACLES)
