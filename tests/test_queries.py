"""Every query with SQL gives the rows of DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from quayside.plans import queries as plans

SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = plans.QUERIES[name](spark, SF)
    cursor = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert rows_of(found.columns, found.collect()) == rows_of(names, cursor.fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(plans.ORACLES) <= set(__spark_entry__.oracle_sql())
