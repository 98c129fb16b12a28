"""Offset vectors: one number per (topic, partition).

A vector is the only thing this package brings to the driver. Its size is the number of
topic partitions; it is checked against ``MAX_PARTITIONS`` and never assumed.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import PARTITION

Vector = dict[tuple[str, int], int]

# More partitions than a Kafka cluster is run with; at 3 longs a row, a few megabytes.
MAX_PARTITIONS = 200_000
# Partitions of like offsets share one bound in the predicate that reaches the scan.
BOUNDS = 32


class ResumeError(RuntimeError):
    """A start position cannot be used as it stands."""


def pin_small(df: DataFrame, max_rows: int = MAX_PARTITIONS) -> DataFrame:
    """A broadcast copy of a frame that holds at most ``max_rows`` rows; refuses a larger one."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        raise ResumeError(f"more than {max_rows} rows where one per partition was expected")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def collect_vector(df: DataFrame, value: str, max_rows: int = MAX_PARTITIONS) -> Vector:
    """The rows of a plan as a dict; refuses an oversized, null or repeated position."""
    rows = df.select(*PARTITION, value).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ResumeError(f"more than {max_rows} partitions in an offset vector")
    vector: Vector = {}
    for topic, partition, offset in rows:
        if offset is None:
            raise ResumeError(f"no {value} for {topic}-{partition}")
        if (topic, partition) in vector:
            raise ResumeError(f"two values of {value} for {topic}-{partition}")
        vector[(topic, partition)] = offset
    return vector


def vector_frame(spark: SparkSession, vector: Vector, value: str) -> DataFrame:
    """A vector as a DataFrame (topic, partition, <value>)."""
    rows = [(topic, part, offset) for (topic, part), offset in vector.items()]
    return spark.createDataFrame(rows, f"topic string, partition int, {value} bigint")


def offsets_json(vector: Vector) -> str:
    """A vector in the form the Kafka source takes for start and end offsets."""
    nested: dict[str, dict[str, int]] = {}
    for (topic, partition), offset in sorted(vector.items()):
        nested.setdefault(topic, {})[str(partition)] = offset
    return json.dumps(nested)


def at_or_after(log: DataFrame, starts: Vector) -> DataFrame:
    """Rows at or past the start of their partition; a partition not named is read whole.

    A coarse bound reaches the scan, at any number of partitions: they are sorted by start and
    cut into at most ``BOUNDS`` groups, each with its least start. A join with the vector, whose
    size the caller has checked, then keeps exactly what was asked for.
    """
    if not starts:
        return log
    reached = [_any_of(group) & (F.col("offset") >= starts[group[0]]) for group in _groups(starts)]
    vector = F.broadcast(vector_frame(log.sparkSession, starts, "_start"))
    return (
        log.where(reduce(or_, reached) | _unnamed(starts))
        .join(vector, PARTITION, "left")
        .where(F.col("_start").isNull() | (F.col("offset") >= F.col("_start")))
        .drop("_start")
    )


def between(log: DataFrame, starts: Vector, ends: Vector) -> DataFrame:
    """Rows inside ``[start, end)`` of the named partitions, and of no others; bounds reach the
    scan as in ``at_or_after``."""
    if starts.keys() != ends.keys():
        raise ResumeError("start and end offsets name different partitions")
    open_ranges = {tp: (starts[tp], ends[tp]) for tp in starts if starts[tp] < ends[tp]}
    if not open_ranges:
        return log.where(F.lit(False))
    reached = [
        _any_of(group)
        & (F.col("offset") >= starts[group[0]])
        & (F.col("offset") < max(ends[tp] for tp in group))
        for group in _groups({tp: starts[tp] for tp in open_ranges})
    ]
    rows = [(topic, part, lo, hi) for (topic, part), (lo, hi) in open_ranges.items()]
    vector = log.sparkSession.createDataFrame(
        rows, "topic string, partition int, _lo bigint, _hi bigint"
    )
    return (
        log.where(reduce(or_, reached))
        .join(F.broadcast(vector), PARTITION)
        .where((F.col("offset") >= F.col("_lo")) & (F.col("offset") < F.col("_hi")))
        .drop("_lo", "_hi")
    )


def _groups(starts: Vector) -> list[list[tuple[str, int]]]:
    """Partitions by topic and start, in at most about ``BOUNDS`` runs; the first has the least."""
    size = max(1, -(-len(starts) // BOUNDS))
    by_topic: dict[str, list[tuple[str, int]]] = {}
    for tp in sorted(starts, key=lambda tp: (starts[tp], tp)):
        by_topic.setdefault(tp[0], []).append(tp)
    return [own[i : i + size] for own in by_topic.values() for i in range(0, len(own), size)]


def _any_of(group: list[tuple[str, int]]) -> Column:
    return (F.col("topic") == group[0][0]) & F.col("partition").isin([part for _, part in group])


def _unnamed(starts: Vector) -> Column:
    """Partitions that the vector does not name, in terms that a scan can take: other topics,
    numbers beyond the named ones and the holes between them."""
    named: dict[str, set[int]] = {}
    for topic, partition in starts:
        named.setdefault(topic, set()).add(partition)
    other = reduce(and_, (F.col("topic") != topic for topic in named))
    for topic, parts in named.items():
        outside = (F.col("partition") < min(parts)) | (F.col("partition") > max(parts))
        if holes := set(range(min(parts), max(parts))) - parts:
            outside |= F.col("partition").isin(sorted(holes))
        other |= (F.col("topic") == topic) & outside
    return other
