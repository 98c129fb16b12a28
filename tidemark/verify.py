"""Audits from the command line: a list of audits in, verdict rows out.

    python -m tidemark.verify AUDITS OUT

AUDITS is a file or folder of JSON lines, one audit each: ``name``, ``ledger`` (JSON lines) and
``sink`` (a parquet folder by ``sink_table=``), and if wanted ``tables``, ``expect`` ("no-loss" or
"loss") and ``unique_required``. OUT gets one JSON line for each table of each audit. The exit code is
the number of audits whose prediction failed, 100 at most.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.reconcile import verdict_report
from tidemark.schemas import TABLES
from tidemark.sources.tables import read_ledger, read_sink

AUDIT = "name string, ledger string, sink string, tables array<string>, expect string, unique_required boolean"


def reports(spark: SparkSession, audits: DataFrame) -> DataFrame:
    """The verdict rows of all audits; their list is the only thing that is collected."""
    parts = []
    for audit in audits.collect():
        tables = audit.tables or TABLES
        rows = read_sink(spark, audit.sink, tables, ["event_id"])
        parts.append(
            verdict_report(
                read_ledger(spark, audit.ledger), rows, audit.name,
                audit.expect or "no-loss", bool(audit.unique_required), tables,
            )
        )
    return reduce(DataFrame.unionByName, parts)


def main(arguments: list[str] | None = None) -> int:
    source, out = sys.argv[1:] if arguments is None else arguments
    spark = SparkSession.builder.appName("tidemark-verify").getOrCreate()
    audits = spark.read.schema(AUDIT).option("mode", "FAILFAST").json(source)
    reports(spark, audits).write.mode("overwrite").json(out)
    written = spark.read.schema("scenario string, `pass` boolean").json(out)
    failed = written.where(~F.col("pass")).select("scenario").distinct().count()
    return min(failed, 100)


if __name__ == "__main__":
    raise SystemExit(main())
