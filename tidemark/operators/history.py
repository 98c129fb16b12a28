"""What a log still holds: spans, counts, clocks and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.routes import in_window
from tidemark.schemas import PARTITION, POSITION
from tidemark.sources.vectors import pin_small


def history_profile(
    log: DataFrame, clock: str = "record_ts", with_bytes: bool = False, bounds: DataFrame | None = None
) -> DataFrame:
    """Offsets, span, records, holes and clock range of each partition.

    ``bounds`` (topic, partition, begin, end), as a broker or a writer keeps them, tells where the
    log really starts and ends: it brings in partitions without records and holes before the first
    record or after the last. Without it both are taken from the records.
    ``with_bytes`` reads the values too; leave it off to scan two narrow columns.
    """
    size = [F.sum(F.octet_length("value")).alias("bytes")] if with_bytes else []
    found = log.groupBy(*PARTITION).agg(
        F.min("offset").alias("begin"),
        (F.max("offset") + 1).alias("end"),
        F.count("*").alias("records"),
        F.min_by(clock, "offset").alias("first_offset_ts"),
        F.max_by(clock, "offset").alias("last_offset_ts"),
        F.min(clock).alias("min_ts"),
        F.max(clock).alias("max_ts"),
        *size,
    )
    if bounds is not None:
        counts = ["records", *(["bytes"] if with_bytes else [])]
        found = bounds.select(*PARTITION, "begin", "end").join(found.drop("begin", "end"), PARTITION, "left")
        found = found.fillna(0, counts)
    return found.withColumn("span", F.col("end") - F.col("begin")).withColumn(
        "holes", F.col("span") - F.col("records")
    )


def time_range(log: DataFrame, lo: int, hi: int, clock: str = "record_ts") -> DataFrame:
    """The offsets a timestamp lookup gives for ``[lo, hi)``: per partition the first offset
    at or past each moment, or the end of the log where there is none."""
    stamp = F.col(clock)
    return log.groupBy(*PARTITION).agg(
        F.coalesce(F.min(F.when(stamp >= lo, F.col("offset"))), F.max("offset") + 1)
        .alias("from_offset"),
        F.coalesce(F.min(F.when(stamp >= hi, F.col("offset"))), F.max("offset") + 1)
        .alias("to_offset"),
        F.count_if((stamp >= lo) & (stamp < hi)).alias("records"),
    )


def interval_count(log: DataFrame, lo: int, hi: int, clock: str = "record_ts") -> DataFrame:
    """H3: exact records of ``[lo, hi)`` per partition beside the span a lookup would read."""
    return time_range(log, lo, hi, clock).withColumn(
        "span", F.greatest(F.col("to_offset") - F.col("from_offset"), F.lit(0))
    )


def interval_miss(log: DataFrame, lo: int, hi: int, clock: str = "record_ts") -> DataFrame:
    """H4: records of ``[lo, hi)`` outside the offset range the lookup resolves to.

    With clocks that do not rise with the offset, those a replay by time would skip.
    """
    looked_up = pin_small(time_range(log, lo, hi, clock).drop("records"))
    outside = (F.col("offset") < F.col("from_offset")) | (F.col("offset") >= F.col("to_offset"))
    return (
        in_window(log, clock, lo, hi)
        .join(looked_up, PARTITION)
        .where(outside)
        .select(*POSITION, clock)
    )


def retention_estimate(profile: DataFrame, max_ms: int, max_bytes: int) -> DataFrame:
    """H5: how long each partition keeps records under a time and a size cap, at the rate
    its history shows. Needs the profile's bytes; a partition without a rate is bound by
    time alone."""
    elapsed = F.col("max_ts") - F.col("min_ts")
    by_size = F.when(
        (F.col("bytes") > 0) & (elapsed > 0),
        F.floor(F.lit(float(max_bytes)) / F.col("bytes") * elapsed),
    )
    return (
        profile.withColumn("size_window_ms", by_size)
        .withColumn("window_ms", F.least(F.lit(max_ms).cast("bigint"), "size_window_ms"))
        .withColumn(
            "bound_by",
            F.when(F.col("size_window_ms") < max_ms, "size").otherwise("time"),
        )
        .select(*PARTITION, "bytes", "size_window_ms", "window_ms", "bound_by")
    )
