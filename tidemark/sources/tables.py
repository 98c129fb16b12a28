"""Ledgers, sink tables and the records a job keeps about itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.versions import latest_version
from tidemark.schemas import COMMIT_NOTE, LEDGER, PARTITION, SINK
from tidemark.streaming.places import read_table


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """I4: the producer's ledger, one JSON object a line; blank lines are skipped."""
    return (
        spark.read.schema(LEDGER).option("mode", "FAILFAST").json(path)
    )


def read_sink(
    spark: SparkSession, path: str, tables: list[str] | None = None, columns: list[str] | None = None
) -> DataFrame:
    """A sink stored under ``sink_table=`` folders; names prune folders and columns.

    A sink that nothing reached, or that was never created, holds no rows.
    """
    sink = read_table(spark, path, SINK)
    if tables is not None:
        sink = sink.where(F.col("sink_table").isin(tables))
    return sink if columns is None else sink.select("sink_table", *columns)


def jdbc_options(
    url: str, table: str, lower: int, upper: int, parts: int, split_on: str = "src_offset"
) -> dict[str, str]:
    """Options for a sink table behind JDBC, read in ``parts`` parallel slices."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": split_on,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(parts),
        "fetchsize": "10000",
    }


def read_sink_jdbc(spark: SparkSession, *tables: dict[str, str]) -> DataFrame:
    """JDBC sink tables, one set of ``jdbc_options`` each, every row tagged with its table."""
    read = [
        spark.read.format("jdbc").options(**options).load()
        .withColumn("sink_table", F.lit(options["dbtable"]))
        for options in tables
    ]
    return reduce(DataFrame.unionByName, read)


def read_progress(progress: DataFrame, job: str, topic: str) -> DataFrame:
    """Where one job stands in one topic: the latest row of each partition."""
    own = progress.where((F.col("job") == job) & (F.col("topic") == topic))
    return latest_version(own, ["job", *PARTITION], ["updated_at", "next_offset"])


def read_rejects(rejects: DataFrame, job: str, since) -> DataFrame:
    """Rows a job refused since a moment."""
    return rejects.where((F.col("job") == job) & (F.col("rejected_at") >= F.lit(since)))


def commit_ranges(commits: DataFrame) -> DataFrame:
    """the JSON range note of each commit-audit row as columns (`to` inclusive)."""
    note = F.from_json("log_comment", COMMIT_NOTE)
    return (
        commits.where(F.col("log_comment") != "")
        .withColumn("_note", note)
        .select(
            "event_time",
            "written_rows",
            F.col("_note.job").alias("job"),
            F.col("_note.topic").alias("topic"),
            F.col("_note.p").alias("partition"),
            F.col("_note.from").alias("from_offset"),
            F.col("_note.to").alias("to_offset"),
        )
    )


def read_commits(commits: DataFrame, since, limit: int = 50) -> DataFrame:
    """I8: the newest commits after a moment, with the last offset each one reached."""
    recent = commit_ranges(commits.where(F.col("event_time") > F.lit(since)))
    return (
        recent.groupBy("event_time", "written_rows", *PARTITION)
        .agg(F.max("to_offset").alias("last_offset"))
        .orderBy(F.desc("event_time"), *PARTITION, F.desc("written_rows"))
        .limit(limit)
    )
