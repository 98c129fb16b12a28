"""Every registered query over a small table, beside its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__ as driver
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def test_all_ten_and_the_pipeline_are_registered():
    names = driver.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_a_row_for_each_document(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = QUERIES[name](spark, SF)
    assert got.select("doc_id").distinct().count() == n
    assert got.count() == n or name.startswith("op6_")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = QUERIES[name](spark, SF)
    relation = db.sql(ORACLES[name])
    assert {c: TYPES[t] for c, t in result.dtypes} == dict(zip(relation.columns, map(str, relation.types)))
    columns = ", ".join(f'"{c}"' for c in sorted(relation.columns))
    rows = [tuple(r) for r in result.select(*sorted(result.columns)).collect()]
    assert sorted(rows) == sorted(relation.project(columns).fetchall())
