"""Registered queries and their SQL on the smallest tables: equal, and not empty."""

import os

import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql()))
def test_equal(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(__spark_entry__.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    want = sorted((tuple(norm(row[i]) for i in at) for row in r.fetchall()), key=repr)
    assert got == want and got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
