"""The delivery pipelines: topic to tables, topic to topic, and both in a row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.routes import route_filter
from tidemark.functions.rules import DELIVERED, Rule, dispose
from tidemark.functions.wire import decode, encode, events_only
from tidemark.schemas import PROGRESS, SINK, TOPIC_LOG
from tidemark.sources.logs import log_bounds, pinned_bounds, read_range
from tidemark.sources.vectors import collect_vector
from tidemark.streaming import sinks
from tidemark.streaming.compaction import Attempts, compact, read_current, sweep
from tidemark.streaming.places import delete_folder, ensure_table, read_table, work_dir, written

ENDS = T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("end", T.LongType())])
APPEND, ATOMIC, IF_ABSENT = "append", "batch-atomic", "insert-if-absent"
# Delivered events before a hook has changed them.
RAW = "raw"


@dataclass(frozen=True)
class Store:
    """The tables of one job below a root folder."""

    root: str
    job: str = "writer"

    def journal(self, mode: str) -> str:
        """Every batch as it was written down; each way of writing has a folder of its own."""
        return f"{self.root}/batches-{mode}"

    def data(self, mode: str) -> str:
        """The table that batches go on to; batch-atomic ones stay in their journal."""
        return f"{self.root}/data-{mode}"

    @property
    def owners(self) -> str:
        return f"{self.root}/owners"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"

    @property
    def audit(self) -> str:
        return f"{self.root}/audit"

    def _finished(self, spark: SparkSession) -> DataFrame:
        """(run, batch_id) of batches whose progress is stored; an unfinished one will be written again."""
        return sinks.read_progress_table(spark, self.progress).select(*sinks.ATTEMPT_KEYS).distinct()

    def read_journal(self, spark: SparkSession, mode: str) -> DataFrame:
        """What finished batches wrote down."""
        return read_current(spark, sinks.journal_table(self.journal(mode)), self._finished(spark))

    def read_data(self, spark: SparkSession) -> DataFrame:
        """All rows, whichever way they were written."""
        atomic = self.read_journal(spark, ATOMIC).where(F.col("kind") == DELIVERED).select(*SINK.names)
        appended = read_table(spark, self.data(APPEND), SINK).select(*SINK.names)
        return atomic.unionByName(appended).unionByName(sinks.read_inserted(spark, self.data(IF_ABSENT)))

    def read_rejects(self, spark: SparkSession) -> DataFrame:
        every = [sinks.journal_rejects(self.read_journal(spark, mode)) for mode in (APPEND, ATOMIC, IF_ABSENT)]
        return reduce(DataFrame.unionByName, every)

    def read_progress(self, spark: SparkSession) -> DataFrame:
        return sinks.stored_progress(sinks.read_progress_table(spark, self.progress), self.job)

    def read_audit(self, spark: SparkSession) -> DataFrame:
        return read_current(spark, sinks.audit_table(self.audit))

    def tables(self) -> list[Attempts]:
        """Everything that grows with the batches."""
        journals = [sinks.journal_table(self.journal(mode)) for mode in (APPEND, ATOMIC, IF_ABSENT)]
        inserted = self.data(IF_ABSENT)
        return [
            *journals, sinks.inserted_rows(inserted), sinks.inserted_keys(inserted), sinks.audit_table(self.audit),
            sinks.progress_table(self.progress),
        ]

    def compact(self, spark: SparkSession) -> None:
        """K3: finished batches of all tables into their bases, progress last.

        The newest batch of each run stays as it is: the next one reads its progress, and it alone may be
        written again. The list of batches is written down first, since progress must not absorb a batch
        that another table has not.
        """
        done = self._finished(spark)
        newest = done.groupBy("run").agg(F.max("batch_id").alias("batch_id"))
        listed = f"{work_dir(spark, 'compaction')}/batches"
        done.join(newest, sinks.ATTEMPT_KEYS, "left_anti").coalesce(1).write.parquet(listed)
        for table in self.tables():
            compact(spark, table, spark.read.schema(sinks.ATTEMPT).parquet(listed))
        delete_folder(spark, listed)

    def sweep(self, spark: SparkSession) -> int:
        """Deletes what compaction has made needless; call it when no reader of older states is left."""
        return sum(sweep(spark, table) for table in self.tables())


@dataclass(frozen=True)
class Delivery:
    """How events are judged and written.

    ``run`` names the folders of the job's batches. By default that is the id of the checkpoint
    it runs on; a given name is bound to the first checkpoint that uses it and refused to others.
    ``guarded`` refuses batches that do not continue the stored progress. It needs batches
    that hold each partition in offset order, as Kafka gives them; a topic-log table does so
    if every micro-batch takes whole appends (no file limit). ``hook`` may change the delivered
    rows. ``before_progress`` runs between data and progress, for tests of a crash there.
    """

    store: Store
    run: str | None = None
    mode: str = ATOMIC
    rules: list[Rule] = field(default_factory=list)
    route_map: dict[str, str] | None = None
    drop_route: str | None = None
    guarded: bool = True
    gaps_allowed: bool = False
    clock: Callable[[], Column] = F.current_timestamp
    hook: Callable[[DataFrame], DataFrame] | None = None
    before_progress: Callable[[int], None] | None = None

    def __post_init__(self) -> None:
        if self.mode not in (APPEND, ATOMIC, IF_ABSENT):
            raise ValueError(f"unknown sink mode {self.mode!r}")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: journal, guard, data, then audit and progress.

        The batch is read once, by the write of its journal, which counts the records as they pass.
        All else comes from the journal's columns. No reader takes a batch into account before its
        progress is stored, so one that the guard refuses leaves nothing to be seen.
        """
        spark = batch.sparkSession
        run = sinks.own_run(spark, self.store.owners, self.run)
        sinks.refuse_finished(spark, self.store.progress, run, batch_id)
        stored = self._stored(spark, run, batch_id)
        # Where offsets may jump, progress does not prove that an earlier offset was seen, so
        # repeats go to the sink; let it be insert-if-absent.
        covered = stored if self.guarded and not self.gaps_allowed else None
        judged = dispose(decode(batch), self.rules, self.drop_route, self.route_map)
        path = sinks.attempt_path(self.store.journal(self.mode), run, batch_id)
        passed = self._write_journal(sinks.journal_rows(judged, self.store.job, self.clock(), covered), path)
        journal = spark.read.schema(sinks.JOURNAL).parquet(path)
        # One row per partition; read once, since the guard and two tables use it.
        ranges = sinks.pin_small(sinks.batch_ranges(sinks.journal_positions(journal)))
        checked = sinks.check_ranges(ranges, stored, self.gaps_allowed)
        if (kept := ranges.agg(F.sum("records")).first()[0] or 0) != passed:
            raise sinks.JournalError(f"batch {batch_id}: {passed} records passed, {kept} are stored")
        if self.guarded:
            sinks.guard(checked)
        self._store(journal, path, run, batch_id)
        if self.before_progress is not None:
            self.before_progress(batch_id)
        notes = sinks.audit_rows(checked, self.store.job, self.clock())
        sinks.write_attempt(notes.coalesce(1), self.store.audit, run, batch_id)
        steps = sinks.progress_rows(checked, stored, self.store.job, self.clock())
        sinks.write_attempt(steps.coalesce(1), self.store.progress, run, batch_id)

    def _write_journal(self, rows: DataFrame, path: str) -> int:
        """Writes a batch down; the number of its records, observed by the write itself."""
        seen = Observation()
        kind = F.when(F.col("kind") == DELIVERED, RAW).otherwise(F.col("kind")) if self.hook else F.col("kind")
        observed = rows.withColumn("kind", kind).observe(seen, F.count(F.lit(1)).alias("records"))
        observed.write.mode("overwrite").partitionBy("kind", "sink_table").parquet(path)
        return seen.get["records"]

    def _stored(self, spark: SparkSession, run: str, batch_id: int) -> DataFrame:
        """Progress before this batch, whatever earlier attempts at it left behind.

        A run's first batch looks at what other runs left; the others read the batch before.
        """
        if batch_id > 0:
            rows = sinks.read_attempt(spark, self.store.progress, PROGRESS, run, batch_id - 1)
        else:
            every = sinks.read_progress_table(spark, self.store.progress)
            rows = every.where(F.col("run") != run).select(*PROGRESS.names)
        return sinks.pin_small(sinks.stored_progress(rows, self.store.job))

    def _store(self, journal: DataFrame, path: str, run: str, batch_id: int) -> None:
        """What the sink is to hold of a journal."""
        spark = journal.sparkSession
        rows = journal.where(F.col("kind") == (RAW if self.hook else DELIVERED)).select(*SINK.names)
        if self.hook is not None:
            rows = self.hook(rows).select(*SINK.names)
        if self.mode == IF_ABSENT:
            sinks.insert_if_absent(rows, self.store.data(IF_ABSENT), run, batch_id)
        elif self.mode == APPEND:
            sinks.append_fanout(rows, self.store.data(APPEND))
        elif self.hook is not None:
            changed = rows.withColumns({"job": F.lit(self.store.job), "reason": F.lit(None).cast("string"), "kind": F.lit(DELIVERED)})
            changed.select(*sinks.JOURNAL.names).write.mode("append").partitionBy("kind", "sink_table").parquet(path)


def run_direct(
    log: DataFrame, delivery: Delivery, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Follows a topic log into the job's tables; by default all there is, then stops.

    T3/P13: started again on its checkpoint, it goes on from there and ignores any start
    position. T8: a failing write fails the query, and the next start replays the batch.
    """
    return (
        log.writeStream.foreachBatch(delivery.write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


RANGES = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("stop", T.LongType()),
    ]
)


def run_limited(log: DataFrame, delivery: Delivery, run: str, max_offsets: int) -> int:
    """Delivers a topic-log table in guarded batches of at most ``max_offsets`` of each partition.

    Returns the number of the run's batches so far.

    A file limit cuts a log between files, in any order; this cuts it by offset, so the contiguity guard
    may stay on. Every batch's ranges are written down before it is read (``plans`` in the store) and hold
    when it is delivered again. Started again under the same run name, it finishes the batch that was
    open and goes on from stored progress.
    """
    spark, store = log.sparkSession, delivery.store
    delivery = replace(delivery, run=run)
    plans = f"{store.root}/plans"
    bounds = {(r.topic, r.partition): (r.begin, r.end) for r in pinned_bounds(log).collect()}
    stored = sinks.read_progress_table(spark, store.progress).where(F.col("run") == run)
    last = stored.agg(F.max("batch_id")).first()[0]
    batch_id = 0 if last is None else last + 1
    while True:
        folder = sinks.attempt_path(plans, run, batch_id)
        if not written(spark, folder):
            reached = collect_vector(store.read_progress(spark), "next_offset")
            rows = [
                (*tp, start, min(start + max_offsets, end))
                for tp, (begin, end) in bounds.items()
                if (start := reached.get(tp, begin)) < end
            ]
            if not rows:
                return batch_id
            spark.createDataFrame(rows, RANGES).coalesce(1).write.mode("overwrite").parquet(folder)
        plan = spark.read.schema(RANGES).parquet(folder)
        delivery.write(read_range(log, collect_vector(plan, "start"), collect_vector(plan, "stop")), batch_id)
        batch_id += 1


@dataclass(frozen=True)
class Router:
    """How a hop writes the next topic, here a topic-log table; ``run`` as in ``Delivery``."""

    path: str
    topic: str = "events-routed"
    partitions: int = 3
    run: str | None = None
    drop_route: str | None = None
    target: Column | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        """The hop's topic as a batch."""
        return sinks.read_attempts(spark, self.path, TOPIC_LOG)

    def read_lineage(self, spark: SparkSession) -> DataFrame:
        """The source position of each record of the hop's topic, written beside it."""
        return sinks.read_attempts(spark, self.path, sinks.LINEAGE)

    def read_stream(self, spark: SparkSession, **options) -> DataFrame:
        """The hop's topic as a stream."""
        whole = T.StructType([*TOPIC_LOG.fields, *sinks.ATTEMPT.fields])
        ensure_table(spark, self.path, whole, sinks.ATTEMPT_KEYS)
        rows = spark.readStream.schema(whole).options(**options).parquet(self.path)
        return rows.drop(*sinks.ATTEMPT_KEYS)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of the hop; malformed records stay behind for the audit."""
        spark = batch.sparkSession
        run = sinks.own_run(spark, f"{self.path}-owners", self.run)
        sinks.refuse_finished(spark, f"{self.path}-ends", run, batch_id)
        ends = self._ends(spark, run, batch_id)
        events = encode(route_filter(events_only(decode(batch)), self.drop_route))
        placed = sinks.place_in_topic(events, self.topic, self.partitions, ends, self.target)
        sinks.write_topic(placed, self.path, run, batch_id)
        written = sinks.read_attempt(spark, self.path, TOPIC_LOG, run, batch_id)
        reached = (
            log_bounds(written).select("partition", "end").unionByName(ends)
            .groupBy("partition").agg(F.max("end").alias("end"))
        )
        sinks.write_attempt(reached.coalesce(1), f"{self.path}-ends", run, batch_id)

    def _ends(self, spark: SparkSession, run: str, batch_id: int) -> DataFrame:
        """Where the hop's topic ended before this batch, one row per partition."""
        path = f"{self.path}-ends"
        if batch_id > 0:
            rows = sinks.read_attempt(spark, path, ENDS, run, batch_id - 1)
        else:
            every = sinks.read_attempts(spark, path, ENDS)
            others = every.where(F.col("run") != run)
            rows = others.groupBy("partition").agg(F.max("end").alias("end"))
        return sinks.pin_small(rows)


def run_router(
    log: DataFrame, router: Router, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Decodes, filters and writes events to the next topic, keyed by event id."""
    return (
        log.writeStream.foreachBatch(router.write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_router_kafka(
    log: DataFrame, servers: str, topic: str, checkpoint: str, drop_route: str | None = None
) -> StreamingQuery:
    """The same hop into Kafka (needs the connector); delivery is at least once."""
    events = encode(route_filter(events_only(decode(log)), drop_route))
    return (
        events.select("key", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def run_two_hop(
    log: DataFrame, router: Router, delivery: Delivery, checkpoints: tuple[str, str]
) -> tuple[StreamingQuery, StreamingQuery]:
    """Both hops until nothing is left. Each has its own checkpoint: one hop's state is
    of no use to the other."""
    if checkpoints[0] == checkpoints[1]:
        raise ValueError("two hops cannot share a checkpoint")
    first = run_router(log, router, checkpoints[0])
    first.awaitTermination()
    second = run_direct(router.read_stream(log.sparkSession), delivery, checkpoints[1])
    second.awaitTermination()
    return first, second


def dedup_stream(events: DataFrame, key: list[str], clock: str, delay: str) -> DataFrame:
    """T5: drops repeats of a key that arrive within ``delay`` of the first by the clock (in
    milliseconds); state older than that is let go.

    Spark drops a record whose clock lies more than ``delay`` behind the newest one seen, so
    give it a broker clock, not a producer's. For repeats at any distance, or clocks that
    cannot be trusted, use the insert-if-absent sink."""
    return (
        events.withColumn("_at", F.timestamp_millis(F.col(clock)))
        .withWatermark("_at", delay)
        .dropDuplicatesWithinWatermark(key)
        .drop("_at")
    )
