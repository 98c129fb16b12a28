"""Runs every registered query beside its SQL in DuckDB and compares rows and types.

    python tools/check_oracles.py [sf dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.registry import ORACLES, QUERIES  # noqa: E402

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, db = session(), duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    failed = []
    for name in names:
        start = time.time()
        try:
            result = QUERIES[name](spark, sf_dir)
            rows = [tuple(r) for r in result.select(*sorted(result.columns)).collect()]
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name} {len(rows)} {took:.1f}s")
                continue
            relation = db.sql(ORACLES[name])
            expected_types = dict(zip(relation.columns, map(str, relation.types)))
            types = {c: TYPES.get(t, t) for c, t in result.dtypes}
            columns = ", ".join(f'"{c}"' for c in sorted(relation.columns))
            expected = relation.project(columns).fetchall()
        except Exception as error:  # noqa: BLE001
            print(f"ERROR {name}: {str(error)[:600]}")
            failed.append(name)
            continue
        key = lambda row: tuple((v is None, str(v)) for v in row)
        same = sorted(rows, key=key) == sorted(expected, key=key)
        if same and types == expected_types:
            print(f"ok    {name} {len(rows)} {took:.1f}s")
        else:
            failed.append(name)
            odd = {c: (types.get(c), expected_types.get(c)) for c in {*types, *expected_types}
                   if types.get(c) != expected_types.get(c)}
            print(f"DIFF  {name} {len(rows)} vs {len(expected)} types {odd}")
            print("   only spark", list(set(rows) - set(expected))[:3])
            print("   only sql  ", list(set(expected) - set(rows))[:3])
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
