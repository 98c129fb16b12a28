"""Topic logs: parquet tables with the Kafka source's columns, or Kafka itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import PARTITION, TOPIC_LOG
from tidemark.sources.vectors import (
    ResumeError,
    Vector,
    at_or_after,
    between,
    collect_vector,
    offsets_json,
    pin_small,
)


def topic_log(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Every record of a topic-log table, as a batch or as a stream."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(TOPIC_LOG)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def kafka_options(
    servers: str,
    topic: str,
    starts: Vector | str = "earliest",
    ends: Vector | None = None,
    *,
    start_ms: int | Vector | None = None,
    end_ms: Vector | None = None,
    on_no_match: str = "error",
    max_offsets: int | None = None,
    min_offsets: int | None = None,
    max_wait: str | None = None,
) -> dict[str, str]:
    """Options for ``format("kafka")``; a record lost to retention fails the read.

    ``starts`` is a vector, ``earliest`` or ``latest``. With ``ends`` the partition set is
    fixed to the vector's own, as a bounded repair needs. ``start_ms`` starts at a record clock
    instead, one time for all partitions or one for each; the broker finds the offsets.
    ``end_ms`` ends a batch read the same way. ``on_no_match`` is what a partition without so
    late a record does: ``error``, or ``end``, which skips its backlog. ``max_offsets`` and
    ``min_offsets`` limit a micro-batch, ``max_wait`` ("5s") how long the latter may hold it back.
    """
    options = {"kafka.bootstrap.servers": servers, "failOnDataLoss": "true"}
    limits = {
        "maxOffsetsPerTrigger": max_offsets, "minOffsetsPerTrigger": min_offsets, "maxTriggerDelay": max_wait,
    }
    options |= {name: str(value) for name, value in limits.items() if value is not None}
    if start_ms is not None:
        policy = {"error": "error", "end": "latest"}
        if on_no_match not in policy:
            raise ValueError(f"unknown policy {on_no_match!r}")
        options["startingOffsetsByTimestampStrategy"] = policy[on_no_match]
        if isinstance(start_ms, int):
            options["startingTimestamp"] = str(start_ms)
        else:
            options["startingOffsetsByTimestamp"] = offsets_json(start_ms)
    else:
        options["startingOffsets"] = starts if isinstance(starts, str) else offsets_json(starts)
    if end_ms is not None:
        options["endingOffsetsByTimestamp"] = offsets_json(end_ms)
    if ends is None:
        return options | {"subscribe": topic}
    if start_ms is not None or isinstance(starts, str) or starts.keys() != ends.keys():
        raise ResumeError("a bounded read needs start and end offsets of the same partitions")
    assigned: dict[str, list[int]] = {}
    for name, partition in sorted(starts):
        assigned.setdefault(name, []).append(partition)
    listing = ", ".join(f'"{name}": {parts}' for name, parts in assigned.items())
    return options | {"assign": "{" + listing + "}", "endingOffsets": offsets_json(ends)}


def kafka_log(spark: SparkSession, options: dict[str, str], streaming: bool = False) -> DataFrame:
    """The topic-log columns read from Kafka (needs the connector on the classpath)."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.format("kafka").options(**options).load()
    return raw.select(
        "topic", "partition", "offset",
        F.unix_millis("timestamp").alias("record_ts"), "key", "value",
    )


def log_bounds(log: DataFrame) -> DataFrame:
    """First and exclusive last offset of each partition that holds records."""
    return log.groupBy(*PARTITION).agg(
        F.min("offset").alias("begin"), (F.max("offset") + 1).alias("end")
    )


def pinned_bounds(log: DataFrame) -> DataFrame:
    """The log's bounds, found by one scan and held as one row per partition."""
    return pin_small(log_bounds(log))


def read_range(
    log: DataFrame, starts: Vector, ends: Vector, bounds: DataFrame | None = None
) -> DataFrame:
    """Exactly ``[start, end)`` of each named partition.

    With ``bounds`` the read fails when a start has left retention or an end lies past the
    log, instead of returning less than was asked for.
    """
    if bounds is not None:
        begin, end = collect_vector(bounds, "begin"), collect_vector(bounds, "end")
        for tp, start in starts.items():
            if start == ends[tp]:
                continue
            if tp not in begin or start < begin[tp]:
                raise ResumeError(f"{tp[0]}-{tp[1]}: start {start} is no longer in the log")
            if ends[tp] > end[tp]:
                raise ResumeError(f"{tp[0]}-{tp[1]}: end {ends[tp]} is past the log")
    return between(log, starts, ends)


def stream_from(log: DataFrame, starts: Vector) -> DataFrame:
    """Follow a log from a start vector; a partition seen later is read whole."""
    return at_or_after(log, starts)
