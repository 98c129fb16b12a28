"""Every registered query against its SQL, and the driver's entry points."""

import duckdb
import pytest

import __spark_entry__ as driver
from tidemark.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return connection


def key(row):
    return tuple((value is None, str(value)) for value in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    result = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in result.select(*sorted(result.columns)).collect()]
    relation = db.sql(ORACLES[name])
    assert {c: TYPES[t] for c, t in result.dtypes} == dict(zip(relation.columns, map(str, relation.types)))
    columns = ", ".join(f'"{c}"' for c in sorted(relation.columns))
    assert sorted(rows, key=key) == sorted(relation.project(columns).fetchall(), key=key)
    if name != "interval_miss":
        assert rows


def test_driver_entry_points(spark):
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= driver.queries().keys() and driver.oracle_sql().keys() <= driver.queries().keys()
    assert driver.entry(spark).count() == 14
