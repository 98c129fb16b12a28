"""Stateful streaming operators: the contiguity guard as keyed state, and alerts on silence.

Both use ``transformWithState`` and so need the RocksDB state store (see ``rocksdb_state``). Only
positions, or one clock a row, reach the Python workers, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.schemas import PARTITION, POSITION

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERDICT = (
    "topic string, partition int, first_offset bigint, last_offset bigint, offsets bigint, records bigint, "
    "next_offset bigint, status string, new_next bigint, from_offset bigint"
)
ALERT = "name string, last_seen_ms bigint, alert_ms bigint"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own choice is put back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Contiguity(StatefulProcessor):
    """State of a partition: the range its records have covered so far."""

    def __init__(self, gaps_allowed: bool) -> None:
        self.gaps_allowed = gaps_allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.covered = handle.getValueState("covered", "from_offset bigint, next_offset bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kinds, records = [], 0
        for batch in rows:
            records += len(batch)
            kinds.append(batch["offset"].drop_duplicates())
        offsets = pd.concat(kinds).drop_duplicates()
        first, last, distinct = int(offsets.min()), int(offsets.max()), len(offsets)
        start, expected = self.covered.get() if self.covered.exists() else (None, None)
        if (expected is not None and first > expected) or (not self.gaps_allowed and last + 1 - first != distinct):
            status = "gap"
        elif start is not None and first < start:
            status = "early"
        elif expected is None:
            status = "first"
        elif last + 1 <= expected:
            status = "replayed"
        else:
            status = "overlap" if first < expected else "ok"
        new_next = last + 1 if expected is None else max(last + 1, expected)
        new_start = first if start is None else min(first, start)
        if status not in ("gap", "early"):  # a refused batch leaves the state as it was
            self.covered.update((new_start, new_next))
        row = (*key, first, last, distinct, records, expected, status, new_next, new_start)
        names = [field.split()[0] for field in VERDICT.split(", ")]
        frame = pd.DataFrame([row], columns=names)
        yield frame.astype({"next_offset": "Int64"})

    def close(self) -> None:
        pass


def contiguity_stream(log: DataFrame, gaps_allowed: bool = False) -> DataFrame:
    """Of every micro-batch and partition the verdict that ``check_progress`` gives, from keyed state.

    The state moves on by batches that progress could take; a partition's offsets of one batch are held
    by one task, as distinct numbers. The set-based guard of ``Delivery`` is the default; this one is for
    queries that have no store.
    """
    rows = log.select(*POSITION).groupBy(*PARTITION)
    return rows.transformWithStateInPandas(
        Contiguity(gaps_allowed), outputStructType=VERDICT, outputMode="Append", timeMode="None"
    )


class Silence(StatefulProcessor):
    """State of a name: when it was last heard of; a timer runs from then on."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen_ms bigint")

    def _rewind(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.limit_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._rewind(timerValues.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for _ in rows:
            pass
        self.last.update((now,))
        self._rewind(now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        seen = self.last.get()[0] if self.last.exists() else None
        self.handle.registerTimer(now + self.limit_ms)  # again, as long as the silence lasts
        frame = pd.DataFrame([(key[0], seen, now)], columns=["name", "last_seen_ms", "alert_ms"])
        yield frame.astype({"last_seen_ms": "Int64"})

    def close(self) -> None:
        pass


def silence_alerts(rows: DataFrame, name: str, expected: list[str], limit_ms: int) -> DataFrame:
    """M2/M4 as a stream: a row for each expected name not heard of for ``limit_ms``, then one every ``limit_ms`` more.

    ``name`` is the column that tells who is heard of: ``sink_table`` of a stream of stored rows gives
    stale tables, job and partition of progress rows give stalled progress. A name that never comes alerts
    too, from the query's start on. Time is the cluster's, so alerts come without new data.
    """
    spark = rows.sparkSession
    known = spark.createDataFrame([(n,) for n in expected], "name string")
    heard = rows.select(F.col(name).cast("string").alias("name")).where(F.col("name").isNotNull())
    return heard.groupBy("name").transformWithStateInPandas(
        Silence(limit_ms), outputStructType=ALERT, outputMode="Append", timeMode="ProcessingTime",
        initialState=known.groupBy("name"),
    )
