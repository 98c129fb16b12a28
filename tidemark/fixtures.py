"""Delivery-shaped tables that Spark derives from ``events.parquet``.

Event ids are dense from 0 and in time order, so partition and offset are arithmetic.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.routes import map_routes, phase_of, route_of
from tidemark.functions.wire import encode
from tidemark.operators.frontier import branch_frontier
from tidemark.schemas import BEFORE, AFTER, DURING

JOB, TOPIC, PARTITIONS = "writer", "events", 3
# An id no producer hands out is this far above a real one.
STRAY_ID = 10**15
DAY_MS = 86_400_000
# 2024-01-31 00:00:00 UTC
NOW_MS = 1_706_659_200_000


def now() -> Column:
    """The fixed clock of every health check."""
    return F.timestamp_millis(F.lit(NOW_MS))


class Fixtures:
    """Lazy fixture tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def events(self) -> DataFrame:
        """event_id, its time in milliseconds, and its own fields as payload."""
        return self.of_events(self.spark.read.parquet(f"{self.sf_dir}/events.parquet"))

    def of_events(self, raw: DataFrame) -> DataFrame:
        millis = F.unix_millis(F.col("ts").cast("timestamp"))
        payload = F.concat_ws("|", "event_type", "props", F.col("user_id").cast("string"))
        return raw.select("event_id", millis.alias("produced_at"), payload.alias("payload"))

    @cached_property
    def n(self) -> int:
        """One past the greatest event id."""
        return self.events.agg(F.max("event_id")).first()[0] + 1

    @cached_property
    def ledger(self) -> DataFrame:
        """What was produced, with its phase; every 97th event has a route nobody takes."""
        return self.as_ledger(self.events)

    def as_ledger(self, events: DataFrame) -> DataFrame:
        eid = F.col("event_id")
        route = (
            F.when(eid % 500 == 0, "rare").when(eid % 97 == 0, "x").otherwise(route_of(eid))
        )
        return events.select(
            "event_id",
            "produced_at",
            route.alias("route"),
            phase_of(eid, F.lit(self.n / 3.0), F.lit(self.n * 5 / 6.0)).alias("phase"),
            F.col("produced_at").alias("record_ts"),
            "payload",
        )

    @cached_property
    def skewed_ledger(self) -> DataFrame:
        """the record clock of the outage's events runs a day late."""
        shift = F.when(F.col("phase") == DURING, F.lit(DAY_MS)).otherwise(F.lit(0))
        return self.ledger.withColumn("record_ts", F.col("produced_at") - shift)

    def as_log(self, ledger: DataFrame) -> DataFrame:
        """Ledger rows as topic-log records, keeping the typed columns beside the bytes."""
        placed = ledger.withColumns(
            {
                "topic": F.lit(TOPIC),
                "partition": (F.col("event_id") % PARTITIONS).cast("int"),
                "offset": F.floor(F.col("event_id") / F.lit(float(PARTITIONS))).cast("bigint"),
            }
        )
        return encode(placed)

    @cached_property
    def log(self) -> DataFrame:
        return self.as_log(self.ledger)

    @cached_property
    def skewed_log(self) -> DataFrame:
        return self.as_log(self.skewed_ledger)

    def as_sink(self, log: DataFrame) -> DataFrame:
        """Each routed record stored once."""
        return (
            map_routes(log)
            .where(F.col("sink_table").isNotNull())
            .select(
                "event_id",
                "produced_at",
                "route",
                "payload",
                F.col("topic").alias("src_topic"),
                F.col("partition").alias("src_part"),
                F.col("offset").alias("src_offset"),
                F.timestamp_millis(F.col("produced_at") + 1000).alias("inserted_at"),
                "sink_table",
                "phase",
            )
        )

    @cached_property
    def clean_sink(self) -> DataFrame:
        return self.as_sink(self.log)

    @cached_property
    def sink(self) -> DataFrame:
        """Every 41st row missing, every 53rd stored twice, a stray copy of every 211th."""
        eid = F.col("event_id")
        kept = eid % 41 != 0
        stored = F.array(
            F.when(kept, eid), F.when(kept & (eid % 53 == 0), eid), F.when(eid % 211 == 0, eid + STRAY_ID)
        )
        return self.clean_sink.withColumn("event_id", F.explode(F.array_compact(stored)))

    @cached_property
    def starved_sink(self) -> DataFrame:
        """One table got nothing until the restart."""
        return self.clean_sink.where((F.col("sink_table") != "t_b") | (F.col("phase") == AFTER))

    def poisoned(self, rows: DataFrame) -> DataFrame:
        return rows.where((F.col("phase") == DURING) & (F.col("event_id") % 10 == 0))

    def sound(self, rows: DataFrame) -> DataFrame:
        return rows.where((F.col("phase") != DURING) | (F.col("event_id") % 10 != 0))

    @cached_property
    def rejects(self) -> DataFrame:
        """The outage's routed rows that could not be written, with their wire text."""
        return self.poisoned(map_routes(self.log)).where(F.col("sink_table").isNotNull()).select(
            F.lit(JOB).alias("job"),
            "topic", "partition", "offset",
            F.col("event_id").cast("string").alias("event_id"),
            F.lit("poison").alias("reason"),
            F.timestamp_millis("produced_at").alias("rejected_at"),
            F.col("value").cast("string").alias("payload"),
        )

    def commits(self, variant: str = "whole") -> DataFrame:
        """Commit-audit rows of the time before the outage, fifty offsets each.

        ``flawed`` lacks every seventh range of partition 0 and repeats that of partition 1.
        """
        ranges = (
            self.log.where(F.col("phase") == BEFORE)
            .withColumn("_k", F.floor(F.col("offset") / 50))
            .groupBy("topic", "partition", "_k")
            .agg(
                F.min("offset").alias("_from"),
                F.max("offset").alias("_to"),
                F.count("*").alias("written_rows"),
                F.timestamp_millis(F.max("produced_at")).alias("event_time"),
            )
        )
        if variant == "flawed":
            odd = F.col("_k") % 7 == 1
            ranges = ranges.where((F.col("partition") != 0) | ~odd)
            times = F.when((F.col("partition") == 1) & odd, 2).otherwise(1)
            ranges = ranges.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times)))
        note = F.to_json(
            F.struct(
                F.lit(JOB).alias("job"),
                "topic",
                F.col("partition").alias("p"),
                F.col("_from").alias("from"),
                F.col("_to").alias("to"),
            )
        )
        return ranges.select("event_time", "written_rows", note.alias("log_comment"))

    @cached_property
    def progress_rows(self) -> DataFrame:
        """Append-only progress, one row per fifty offsets up to the outage."""
        return (
            self.log.where(F.col("phase") == BEFORE)
            .withColumn("_k", F.floor(F.col("offset") / 50))
            .groupBy("topic", "partition", "_k")
            .agg(
                (F.max("offset") + 1).alias("next_offset"),
                F.count("*").alias("rows_written"),
                F.timestamp_millis(F.max("produced_at")).alias("updated_at"),
            )
            .select(
                F.lit(JOB).alias("job"), "topic", "partition", "next_offset", "rows_written", "updated_at"
            )
        )

    @cached_property
    def branch_maxima(self) -> DataFrame:
        """Progress as a maximum per branch over the starved sink before the restart: the
        starved branch has no row at all in partition 1."""
        return (
            self.clean_sink.where(
                (F.col("phase") != AFTER)
                & ((F.col("sink_table") != "t_b") | ((F.col("phase") == BEFORE) & (F.col("src_part") != 1)))
            )
            .groupBy(F.col("src_topic").alias("topic"), F.col("src_part").alias("partition"), "sink_table")
            .agg(F.max("src_offset").alias("max_offset"))
            .withColumn("job", F.lit(JOB))
        )

    @cached_property
    def half_starved_sink(self) -> DataFrame:
        """What the sink of ``branch_maxima`` holds."""
        return self.clean_sink.where(
            (F.col("phase") != AFTER)
            & ((F.col("sink_table") != "t_b") | ((F.col("phase") == BEFORE) & (F.col("src_part") != 1)))
        )

    @cached_property
    def branch_prefixes(self) -> DataFrame:
        """Contiguous progress per branch of the same sink; a branch that wrote nothing to a
        partition has no row there."""
        held = self.half_starved_sink.withColumnsRenamed(
            {"src_topic": "topic", "src_part": "partition", "src_offset": "offset"}
        )
        wrote = held.select("topic", "partition", "sink_table").distinct()
        return branch_frontier(map_routes(self.log), held).join(
            wrote, ["topic", "partition", "sink_table"], "left_semi"
        )

    @cached_property
    def group_commits(self) -> DataFrame:
        """The consumer group's commits at the start of the outage."""
        return (
            self.log.where(F.col("phase") == BEFORE)
            .groupBy("topic", "partition")
            .agg((F.max("offset") + 1).alias("current_offset"))
        )
