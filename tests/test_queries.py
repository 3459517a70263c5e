"""Every registered query with SQL, against DuckDB over the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not there")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(map(repr, (r[c] for c in columns))) for r in got.collect())
    places = [want.columns.index(c) for c in columns]
    b = sorted(tuple(map(repr, (r[k] for k in places))) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql_or_a_reason():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert all(n.startswith("op") or n == "pipeline" for n in without)
