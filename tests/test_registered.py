"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of
from workload.oracle import ORACLE as SQL
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def database(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return db


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).columns[0] == "query_id"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, folder, database, name):
    got = QUERIES[name](spark, folder)
    want = database.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    have = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert have == rows_of(names, want.fetchall())
