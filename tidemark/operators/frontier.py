"""Completed prefixes, gaps and the adjacency of committed ranges.

A partition can hold a large share of a topic, so nothing here sorts or windows a whole
partition: positions are reduced by (topic, partition, offset), and where order matters the
work is cut into offset buckets whose edges are stitched afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import PARTITION, POSITION

# Offsets per bucket: at most this many distinct rows meet in one window group.
BUCKET = 1 << 18


def account(log: DataFrame, accounted: DataFrame, branch: str | None = None) -> DataFrame:
    """One row per logged position with done = 1 if it was delivered, rejected or skipped.

    Accounted positions the log no longer holds drop out. With ``branch``, a column of both
    sides, a position is done only where its own branch has it.
    """
    keys = [*POSITION, *([branch] if branch else [])]
    tagged = log.select(*keys, F.lit(1).alias("_logged"), F.lit(0).alias("done")).unionByName(
        accounted.select(*keys, F.lit(0).alias("_logged"), F.lit(1).alias("done"))
    )
    return (
        tagged.groupBy(*keys)
        .agg(F.max("_logged").alias("_logged"), F.max("done").alias("done"))
        .where(F.col("_logged") == 1)
        .drop("_logged")
    )


def frontier(
    log: DataFrame, accounted: DataFrame, bounds: DataFrame | None = None
) -> DataFrame:
    """Per partition the offset below which nothing is outstanding.

    ``accounted`` must hold every disposition: delivered, rejected, filtered, unrouted.
    Offsets the log skips are not gaps. ``bounds`` (topic, partition, begin, end) brings in
    partitions without records, which stand at their begin offset. ``naive_next`` is the
    greatest accounted offset + 1, the number a maximum would resume from.
    """
    done, open_ = F.col("done") == 1, F.col("done") == 0
    found = (
        account(log, accounted)
        .groupBy(*PARTITION)
        .agg(
            F.coalesce(
                F.min(F.when(open_, F.col("offset"))), F.max("offset") + 1
            ).alias("next_offset"),
            F.count_if(open_).alias("outstanding"),
            (F.max(F.when(done, F.col("offset"))) + 1).alias("naive_next"),
        )
    )
    if bounds is None:
        return found
    return bounds.join(found, PARTITION, "left").select(
        *PARTITION,
        F.coalesce("next_offset", "begin").alias("next_offset"),
        F.coalesce("outstanding", F.lit(0)).alias("outstanding"),
        "naive_next",
    )


def branch_frontier(log: DataFrame, sink_positions: DataFrame) -> DataFrame:
    """W1 per branch: both sides carry sink_table; a branch with nothing outstanding in a
    partition holds nobody back, so it stands at the partition's end.

    One row per (topic, partition, sink_table) the log has records for.
    """
    partition = Window.partitionBy(*PARTITION)
    open_ = (F.col("done") == 0) & F.col("sink_table").isNotNull()
    return (
        account(log, sink_positions, "sink_table")
        .groupBy(*PARTITION, "sink_table")
        .agg(
            F.min(F.when(open_, F.col("offset"))).alias("_first_open"),
            F.max("offset").alias("_last"),
            F.count_if(open_).alias("outstanding"),
        )
        .withColumn("_end", F.max("_last").over(partition) + 1)
        .where(F.col("sink_table").isNotNull())
        .select(
            *PARTITION,
            "sink_table",
            F.coalesce("_first_open", "_end").alias("next_offset"),
            "outstanding",
        )
    )


def gap_ranges(log: DataFrame, accounted: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The unaccounted offsets as maximal runs ``[from_offset, to_offset]``."""
    open_ = account(log, accounted).where(F.col("done") == 0).select(*POSITION)
    return runs(open_, bucket)


def runs(positions: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Maximal runs of consecutive offsets among distinct positions.

    Runs are found per offset bucket. Only a run that touches a bucket edge can continue in
    the next bucket; there are at most two of those per bucket, and they alone are joined up
    per partition.
    """
    number = F.floor(F.col("offset") / bucket).cast("bigint")
    within = Window.partitionBy(*PARTITION, "_bucket").orderBy("offset")
    pieces = (
        positions.withColumn("_bucket", number)
        .withColumn("_run", F.col("offset") - F.row_number().over(within))
        .groupBy(*PARTITION, "_bucket", "_run")
        .agg(
            F.min("offset").alias("from_offset"),
            F.max("offset").alias("to_offset"),
            F.count("*").alias("records"),
        )
        .withColumn(
            "_edge",
            (F.col("from_offset") == F.col("_bucket") * bucket)
            | (F.col("to_offset") == (F.col("_bucket") + 1) * bucket - 1),
        )
    )
    # An inner run is alone in its chain, so it needs no order among the others.
    chain = Window.partitionBy(*PARTITION, "_inner").orderBy("from_offset")
    inner = F.when(~F.col("_edge"), F.col("from_offset"))
    breaks = F.coalesce(
        (F.lag("to_offset").over(chain) + 1 != F.col("from_offset")).cast("int"), F.lit(1)
    )
    return (
        pieces.withColumn("_inner", inner)
        .withColumn("_break", breaks)
        .withColumn("_chain", F.sum("_break").over(chain))
        .groupBy(*PARTITION, "_inner", "_chain")
        .agg(
            F.min("from_offset").alias("from_offset"),
            F.max("to_offset").alias("to_offset"),
            F.sum("records").alias("records"),
        )
        .select(*PARTITION, "from_offset", "to_offset", "records")
    )


def range_adjacency(ranges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Does each committed range start where the ones before it ended?

    ``ranges`` has from_offset and inclusive to_offset. Equal ranges count as one row with
    ``copies``. ``expected_from`` is one past everything committed by ranges that start
    earlier (or at the same offset but end earlier). Status is ``first``, ``ok``, ``gap`` or
    ``overlap``; an overlap is a replay or a second writer.
    """
    distinct = (
        ranges.groupBy(*PARTITION, "from_offset", "to_offset")
        .agg(F.count("*").alias("copies"))
        .withColumn("_bucket", F.floor(F.col("from_offset") / bucket).cast("bigint"))
    )
    earlier_buckets = (
        Window.partitionBy(*PARTITION)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = (
        distinct.groupBy(*PARTITION, "_bucket")
        .agg(F.max("to_offset").alias("_reach"))
        .select(*PARTITION, "_bucket", F.max("_reach").over(earlier_buckets).alias("_before"))
    )
    earlier_here = (
        Window.partitionBy(*PARTITION, "_bucket")
        .orderBy("from_offset", "to_offset")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    expected = F.greatest(F.max("to_offset").over(earlier_here), F.col("_before")) + 1
    return (
        distinct.join(reach, [*PARTITION, "_bucket"])
        .withColumn("expected_from", expected)
        .withColumn(
            "status",
            F.when(F.col("copies") > 1, "overlap")
            .when(F.col("expected_from").isNull(), "first")
            .when(F.col("from_offset") > F.col("expected_from"), "gap")
            .when(F.col("from_offset") < F.col("expected_from"), "overlap")
            .otherwise("ok"),
        )
        .select(
            *PARTITION, "from_offset", "to_offset", "copies", "expected_from", "status"
        )
    )


def merge_ranges(ranges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Committed ranges ``[from_offset, to_offset]`` as an interval set: the fewest runs that cover them.

    Ranges may repeat, overlap, nest or touch, in any order. The set of two sets is
    ``merge_ranges(one.unionByName(other))``, so a stored set takes up each batch's ranges and stays as
    small as the number of holes. Runs are opened in offset buckets and numbered over them; only sums
    and reaches by bucket are put in order over a whole partition.
    """
    by_bucket = Window.partitionBy(*PARTITION).orderBy("_bucket")
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    longest = (
        ranges.groupBy(*PARTITION, "from_offset")
        .agg(F.max("to_offset").alias("to_offset"))
        .withColumn("_bucket", F.floor(F.col("from_offset") / bucket).cast("bigint"))
    )
    reach = (
        longest.groupBy(*PARTITION, "_bucket")
        .agg(F.max("to_offset").alias("_reach"))
        .select(*PARTITION, "_bucket", F.max("_reach").over(earlier).alias("_before"))
    )
    here = Window.partitionBy(*PARTITION, "_bucket").orderBy("from_offset")
    so_far = F.greatest(F.max("to_offset").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    opened = longest.join(reach, [*PARTITION, "_bucket"]).withColumn(
        "_opens", F.coalesce((F.col("from_offset") > so_far + 1).cast("int"), F.lit(1))
    )
    numbers = (
        opened.groupBy(*PARTITION, "_bucket")
        .agg(F.sum("_opens").alias("_count"))
        .select(*PARTITION, "_bucket", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_first"))
    )
    own = F.sum("_opens").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        opened.withColumn("_own", own)
        .join(numbers, [*PARTITION, "_bucket"])
        .groupBy(*PARTITION, (F.col("_first") + F.col("_own")).alias("_run"))
        .agg(F.min("from_offset").alias("from_offset"), F.max("to_offset").alias("to_offset"))
        .drop("_run")
    )


def frontier_from_ranges(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """W1 from an interval set (see ``merge_ranges``) and the log's bounds, without the log.

    As ``frontier``, for a log whose offsets have no holes; where it has legal ones, add them to the set.
    """
    low, high = F.greatest("from_offset", "begin"), F.least("to_offset", F.col("end") - 1)
    covered = F.when(F.col("from_offset").isNotNull(), F.greatest(high - low + 1, F.lit(0)))
    first = (F.col("from_offset") <= F.col("begin")) & (F.col("to_offset") >= F.col("begin"))
    return (
        bounds.join(runs, PARTITION, "left")
        .groupBy(*PARTITION, "begin", "end")
        .agg(
            F.max(F.when(first, high + 1)).alias("_reached"),
            F.coalesce(F.sum(covered), F.lit(0)).alias("_covered"),
            F.max(F.when(covered > 0, high + 1)).alias("naive_next"),
        )
        .select(
            *PARTITION,
            F.coalesce("_reached", "begin").alias("next_offset"),
            (F.col("end") - F.col("begin") - F.col("_covered")).alias("outstanding"),
            "naive_next",
        )
    )


def offsets_for_times(log: DataFrame, at: int, clock: str = "record_ts") -> DataFrame:
    """Per partition the first offset whose clock is at or past a moment.

    The clock need not rise with the offset; null means no record qualifies.
    """
    return log.groupBy(*PARTITION).agg(
        F.min(F.when(F.col(clock) >= F.lit(at), F.col("offset"))).alias("first_offset")
    )
