"""A sparse index of record clocks: lookups by time that read only the offset blocks that can matter.

An index row is a block of offsets of one partition with its least and greatest clock. Clocks need not
rise with the offset. The first offset at or past a moment lies in the first block whose greatest clock
reaches it, so one block a partition is read; records of an interval lie in blocks whose clocks meet it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.routes import in_window
from tidemark.schemas import PARTITION, POSITION
from tidemark.sources.vectors import Vector, between, collect_vector, pin_small

BLOCK = 1 << 16


def build_index(log: DataFrame, clock: str = "record_ts", block: int = BLOCK) -> DataFrame:
    """One row for each block of offsets that holds records."""
    number = F.floor(F.col("offset") / block).cast("bigint").alias("block")
    return log.groupBy(*PARTITION, number).agg(
        F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"),
        F.min(clock).alias("least"), F.max(clock).alias("greatest"), F.count("*").alias("records"),
    )


def merge_index(*parts: DataFrame) -> DataFrame:
    """The index of several parts of a log, such as the batches of a writer; blocks may be cut by them."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*PARTITION, "block").agg(
        F.min("first_offset").alias("first_offset"), F.max("last_offset").alias("last_offset"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("records").alias("records"),
    )


def _vector(index: DataFrame, offset) -> Vector:
    return collect_vector(index.groupBy(*PARTITION).agg(offset.alias("at")).where("at IS NOT NULL"), "at")


def offsets_for_times(log: DataFrame, index: DataFrame, at: int, clock: str = "record_ts") -> DataFrame:
    """Per partition the first offset whose clock is at or past a moment, null if there is none."""
    reaching = index.where(F.col("greatest") >= at)
    starts = _vector(reaching, F.min("first_offset"))
    ends = _vector(reaching, F.min_by("last_offset", "first_offset") + 1)
    found = between(log, starts, ends).where(F.col(clock) >= at).groupBy(*PARTITION).agg(F.min("offset").alias("first_offset"))
    return index.select(*PARTITION).distinct().join(found, PARTITION, "left")


def time_range(log: DataFrame, index: DataFrame, lo: int, hi: int, clock: str = "record_ts") -> DataFrame:
    """Per partition ``[from_offset, to_offset)`` that lookups of both ends resolve to; no match is the log's end."""
    ends = index.groupBy(*PARTITION).agg((F.max("last_offset") + 1).alias("_end"))
    first = offsets_for_times(log, index, lo, clock).withColumnRenamed("first_offset", "_from")
    last = offsets_for_times(log, index, hi, clock).withColumnRenamed("first_offset", "_to")
    return ends.join(first, PARTITION).join(last, PARTITION).select(
        *PARTITION, F.coalesce("_from", "_end").alias("from_offset"), F.coalesce("_to", "_end").alias("to_offset")
    )


def interval_miss(log: DataFrame, index: DataFrame, lo: int, hi: int, clock: str = "record_ts") -> DataFrame:
    """H4: records of ``[lo, hi)`` outside the offsets that the lookup resolves to.

    Read are the stretches before and after those offsets, as far as blocks hold clocks of the interval.
    """
    looked_up = pin_small(time_range(log, index, lo, hi, clock))
    met = index.where((F.col("least") < hi) & (F.col("greatest") >= lo)).join(looked_up, PARTITION)
    before = met.where(F.col("first_offset") < F.col("from_offset"))
    after = met.where(F.col("last_offset") >= F.col("to_offset"))
    stretches = (
        (_vector(before, F.min("first_offset")), _vector(before, F.max(F.least(F.col("last_offset") + 1, "from_offset")))),
        (_vector(after, F.min(F.greatest("first_offset", "to_offset"))), _vector(after, F.max("last_offset") + 1)),
    )
    parts = [in_window(between(log, starts, ends), clock, lo, hi).select(*POSITION, clock) for starts, ends in stretches]
    # An empty range resolves both ends to one place; what lies on either side is read once.
    return parts[0].unionByName(parts[1])
