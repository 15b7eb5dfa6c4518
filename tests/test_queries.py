"""Every registered query against its SQL counterpart."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from vecmill.plans.oracles import ORACLES
from vecmill.plans.queries import QUERIES

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "float": "FLOAT",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    return connection


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 32_000


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLES[name])
    columns = sorted(expected.columns)
    assert sorted(result.columns) == columns
    types = {c: str(t) for c, t in zip(expected.columns, expected.types)}
    assert {c: TYPES[t] for c, t in result.dtypes} == types
    got = sorted((tuple(r) for r in result.select(*columns).collect()), key=repr)
    want = sorted(expected.select(*columns).fetchall(), key=repr)
    assert len(got) == len(want)
    assert got == want
