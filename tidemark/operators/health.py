"""Signals that something is silently wrong. Every check takes its clock as an argument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.versions import latest_version
from tidemark.schemas import PARTITION
from tidemark.sources.vectors import at_or_after, collect_vector, vector_frame

MINUTE_MS = 60_000


def lag(bounds: DataFrame, group_commits: DataFrame) -> DataFrame:
    """M1: end of log minus committed offset; without a commit the whole log is lag."""
    committed = group_commits.select(*PARTITION, "current_offset")
    return bounds.join(committed, PARTITION, "left").select(
        *PARTITION,
        "end",
        "current_offset",
        (F.col("end") - F.coalesce("current_offset", "begin")).alias("lag"),
    )


def stale_tables(sink: DataFrame, tables: list[str], now, minutes: int) -> DataFrame:
    """M2: expected tables and whether their newest row is older than the limit.

    A table without any row is stale too.
    """
    newest = sink.groupBy("sink_table").agg(F.max("inserted_at").alias("last_insert"))
    wanted = sink.sparkSession.createDataFrame([(t,) for t in tables], "sink_table string")
    age = F.unix_millis(F.lit(now)) - F.unix_millis("last_insert")
    return (
        wanted.join(newest, "sink_table", "left")
        .select("sink_table", age.alias("age_ms"))
        .withColumn("stale", F.coalesce(F.col("age_ms") > minutes * MINUTE_MS, F.lit(True)))
    )


def reject_rate(rejects: DataFrame, now, minutes: int) -> DataFrame:
    """M3: rejects of the last minutes per job and reason."""
    oldest = F.timestamp_millis(F.unix_millis(F.lit(now)) - minutes * MINUTE_MS)
    return (
        rejects.where((F.col("rejected_at") > oldest) & (F.col("rejected_at") <= F.lit(now)))
        .groupBy("job", "reason")
        .agg(F.count("*").alias("rejects"))
    )


def stalled_progress(progress: DataFrame, now, minutes: int) -> DataFrame:
    """M4: partitions whose latest progress row is older than the limit."""
    latest = latest_version(progress, ["job", *PARTITION], ["updated_at", "next_offset"])
    age = F.unix_millis(F.lit(now)) - F.unix_millis("updated_at")
    return (
        latest.select("job", *PARTITION, "next_offset", age.alias("age_ms"))
        .where(F.col("age_ms") > minutes * MINUTE_MS)
    )


def retention_headroom(
    log: DataFrame, frontiers: DataFrame, retention_ms: int, now_ms: int
) -> DataFrame:
    """M5: age of the oldest record still needed, and how long until it expires.

    The record is the first one at or past the partition's next_offset; a partition with
    nothing left to read has no row.
    """
    needed = collect_vector(frontiers, "next_offset")
    beyond = F.broadcast(vector_frame(log.sparkSession, needed, "next_offset").select(*PARTITION))
    return (
        at_or_after(log, needed)
        .join(beyond, PARTITION, "left_semi")
        .groupBy(*PARTITION)
        .agg(
            F.min("offset").alias("oldest_needed"),
            F.min_by("record_ts", "offset").alias("record_ts"),
        )
        .withColumn("age_ms", F.lit(now_ms) - F.col("record_ts"))
        .withColumn("headroom_ms", F.lit(retention_ms) - F.col("age_ms"))
        .drop("record_ts")
    )


def progress_crosscheck(progress: DataFrame, ranges: DataFrame) -> DataFrame:
    """Stored next_offset against one past the greatest committed range.

    ``progress`` holds one row per partition, ``ranges`` the commit audit of the same job.
    """
    audited = ranges.groupBy(*PARTITION).agg((F.max("to_offset") + 1).alias("audit_next"))
    stored = progress.select(*PARTITION, "next_offset")
    status = (
        F.when(F.col("audit_next").isNull(), "no-audit")
        .when(F.col("next_offset").isNull(), "no-progress")
        .when(F.col("next_offset") > F.col("audit_next"), "progress-ahead")
        .when(F.col("next_offset") < F.col("audit_next"), "progress-behind")
        .otherwise("agree")
    )
    return stored.join(audited, PARTITION, "full_outer").withColumn("status", status)
