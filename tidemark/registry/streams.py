"""Streaming pipelines, each run to the end of its input in a fresh folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rules, wire
from tidemark.operators import reconcile as R
from tidemark.operators.reconcile import positions_of
from tidemark.plans import resume as P
from tidemark.fixtures import now
from tidemark.registry.base import NOW_MS, Fixtures, query
from tidemark.registry.sinks import DELIVERED_SQL, copies
from tidemark.schemas import TOPIC_LOG
from tidemark.sources import logs
from tidemark.sources.vectors import collect_vector
from tidemark.streaming import pipelines as T
from tidemark.streaming.guards import contiguity_stream, rocksdb_state
from tidemark.streaming.places import work_dir

LOG = TOPIC_LOG.names


def write_log(f: Fixtures, path: str, phases: list[str]) -> None:
    """Adds the records of some phases to a topic-log table."""
    f.log.where(F.col("phase").isin(phases)).select(*LOG).write.mode("append").parquet(path)


def deliver(f: Fixtures, log: DataFrame, root: str, checkpoint: str, **options) -> T.Delivery:
    delivery = T.Delivery(T.Store(f"{root}/store"), clock=now, **options)
    T.run_direct(log, delivery, f"{root}/{checkpoint}").awaitTermination()
    return delivery


COPIES = f"SELECT {DELIVERED_SQL}, count(*) AS copies FROM clean GROUP BY ALL"


@query(
    "stream_direct",
    """SELECT 'data' AS kind, sink_table AS name, CAST("partition" AS INTEGER) AS "partition",
      "offset", CAST(event_id AS VARCHAR) AS detail FROM clean WHERE event_id % 10 <> 0
    UNION ALL SELECT 'reject', 'poison', "partition", "offset", value FROM clean WHERE event_id % 10 = 0
    UNION ALL SELECT 'progress', 'writer', "partition", "end", CAST("end" - "begin" AS VARCHAR) FROM bounds""",
)
def stream_direct(f: Fixtures) -> DataFrame:
    """Data, rejects and progress of one run straight from the events file."""
    root = work_dir(f.spark, "direct")
    # A pattern, because a streaming source wants a folder or a pattern, not a file.
    schema = f.spark.read.parquet(f"{f.sf_dir}/events.parquet").schema
    raw = f.spark.readStream.schema(schema).parquet(f"{f.sf_dir}/events.parque[t]")
    log = f.as_log(f.as_ledger(f.of_events(raw))).select(*LOG)
    delivery = deliver(f, log, root, "checkpoint", rules=rules.every_nth_is_bad(10))
    store = delivery.store
    data = positions_of(store.read_data(f.spark)).select(
        F.lit("data").alias("kind"), F.col("sink_table").alias("name"), "partition", "offset",
        F.col("event_id").cast("string").alias("detail"),
    )
    rejects = store.read_rejects(f.spark).select(
        F.lit("reject"), "reason", "partition", "offset", "payload"
    )
    progress = store.read_progress(f.spark).select(
        F.lit("progress"), "job", "partition", "next_offset", F.col("rows_written").cast("string")
    )
    return data.union(rejects).union(progress)


@query("stream_restart", COPIES)
def stream_restart(f: Fixtures) -> DataFrame:
    """Stopped at the outage, restarted on its checkpoint after it."""
    root = work_dir(f.spark, "restart")
    for phases in (["before-outage"], ["during-outage", "after-restart"]):
        write_log(f, f"{root}/log", phases)
        log = logs.topic_log(f.spark, f"{root}/log", streaming=True)
        delivery = deliver(f, log, root, "checkpoint")
    return copies(delivery.store.read_data(f.spark))


def lose_checkpoint(f: Fixtures, name: str, modes: list[str]) -> DataFrame:
    """A run until the outage, then one on a new checkpoint from stored progress on; runs have
    their default names, so the second must not touch the first one's batches."""
    root = work_dir(f.spark, name)
    write_log(f, f"{root}/log", ["before-outage"])
    log = logs.topic_log(f.spark, f"{root}/log", streaming=True)
    first = deliver(f, log, root, "checkpoint-0", mode=modes[0])
    write_log(f, f"{root}/log", ["during-outage", "after-restart"])
    bounds = logs.pinned_bounds(logs.topic_log(f.spark, f"{root}/log"))
    plan = P.from_stored(bounds, first.store.read_progress(f.spark), "stored")
    log = logs.stream_from(
        logs.topic_log(f.spark, f"{root}/log", streaming=True), P.start_vector(plan, bounds)
    )
    deliver(f, log, root, "checkpoint-1", mode=modes[1])
    return copies(first.store.read_data(f.spark))


@query("stream_restart_from_store", COPIES)
def stream_restart_from_store(f: Fixtures) -> DataFrame:
    """The checkpoint is lost with the outage; both runs write batches of their own."""
    return lose_checkpoint(f, "from-store", [T.ATOMIC, T.ATOMIC])


@query("stream_restart_by_id", COPIES)
def stream_restart_by_id(f: Fixtures) -> DataFrame:
    """As before, with batches cut differently going through the insert-if-absent sink."""
    return lose_checkpoint(f, "by-id", [T.IF_ABSENT, T.IF_ABSENT])


@query("stream_restart_mode_change", COPIES)
def stream_restart_mode_change(f: Fixtures) -> DataFrame:
    """The second run of the same store changes from batch folders to insert-if-absent."""
    return lose_checkpoint(f, "mode-change", [T.ATOMIC, T.IF_ABSENT])


@query(
    "stream_from_vector",
    f"""SELECT {DELIVERED_SQL}, count(*) AS copies FROM clean
    WHERE phase <> 'before-outage' GROUP BY ALL""",
)
def stream_from_vector(f: Fixtures) -> DataFrame:
    """A new job that starts at the old one's commits."""
    root = work_dir(f.spark, "from-vector")
    write_log(f, f"{root}/log", ["before-outage", "during-outage", "after-restart"])
    starts = collect_vector(f.group_commits, "current_offset")
    log = logs.stream_from(logs.topic_log(f.spark, f"{root}/log", streaming=True), starts)
    return copies(deliver(f, log, root, "checkpoint").store.read_data(f.spark))


@query(
    "stream_two_hop",
    f"""SELECT event_id, produced_at, route, payload, 'events-routed' AS src_topic, src_part, row_number() OVER (
        PARTITION BY src_part ORDER BY "partition", "offset") - 1 AS src_offset, sink_table, CAST(1 AS BIGINT) AS copies,
        CAST({NOW_MS} AS BIGINT) AS inserted_ms
    FROM (SELECT *, CAST(event_id // 3 % 2 AS INTEGER) AS src_part FROM log)
    QUALIFY sink_table IS NOT NULL""",
)
def stream_two_hop(f: Fixtures) -> DataFrame:
    """Through a second topic of two partitions; offsets in the sink are the second topic's."""
    root = work_dir(f.spark, "two-hop")
    write_log(f, f"{root}/log", ["before-outage", "during-outage", "after-restart"])
    router = T.Router(f"{root}/topic2", partitions=2, target=F.floor(F.col("event_id") / 3) % 2)
    delivery = T.Delivery(T.Store(f"{root}/store"), clock=now)
    log = logs.topic_log(f.spark, f"{root}/log", streaming=True)
    T.run_two_hop(log, router, delivery, (f"{root}/c1", f"{root}/c2"))
    return copies(delivery.store.read_data(f.spark))


@query(
    "stream_two_hop_lost_checkpoint",
    """SELECT event_id, row_number() OVER (PARTITION BY p ORDER BY late, "partition", "offset") - 1 AS "offset",
      p AS "partition", value FROM (SELECT *, CAST(event_id // 3 % 2 AS INTEGER) AS p,
        phase <> 'before-outage' AS late FROM log)""",
)
def stream_two_hop_lost_checkpoint(f: Fixtures) -> DataFrame:
    """The first hop starts again on a new checkpoint with the records since the outage; the
    second topic keeps what it held and its offsets go on."""
    root = work_dir(f.spark, "hop-lost")
    router = T.Router(f"{root}/topic2", partitions=2, target=F.floor(F.col("event_id") / 3) % 2)
    for number, phases in enumerate((["before-outage"], ["during-outage", "after-restart"])):
        write_log(f, f"{root}/log-{number}", phases)
        log = logs.topic_log(f.spark, f"{root}/log-{number}", streaming=True)
        T.run_router(log, router, f"{root}/c{number}").awaitTermination()
    decoded = wire.events_only(wire.decode(router.read(f.spark)))
    return decoded.select("event_id", "offset", "partition", F.col("value").cast("string"))


@query("stream_dedup", "SELECT event_id, payload FROM log")
def stream_dedup(f: Fixtures) -> DataFrame:
    """Three files, a batch each: the phases, with every 53rd record of the one before once more and
    every 53rd of its own three times, so that repeats meet state of an earlier batch."""
    root = work_dir(f.spark, "dedup")
    times = F.when(F.col("event_id") % 53 == 0, 3).otherwise(1)
    repeated = f.log.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times)))
    phases = ["before-outage", "during-outage", "after-restart"]
    for number, phase in enumerate(phases):
        rows = repeated.where(F.col("phase") == phase)
        if number:
            rows = rows.unionByName(repeated.where((F.col("phase") == phases[number - 1]) & (F.col("event_id") % 53 == 0)))
        rows.select(*LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    log = logs.topic_log(f.spark, f"{root}/log", streaming=True, max_files_per_trigger=1)
    events = wire.events_only(wire.decode(log)).select("event_id", "record_ts", "payload")
    once = T.dedup_stream(events, ["event_id"], "record_ts", "90 days")
    query = (
        once.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return f.spark.read.parquet(f"{root}/out").select("event_id", "payload")


@query("stream_limited", COPIES)
def stream_limited(f: Fixtures) -> DataFrame:
    """Guarded batches of at most a quarter of a partition's offsets, stopped at the outage and started again."""
    root = work_dir(f.spark, "limited")
    delivery = T.Delivery(T.Store(f"{root}/store"), clock=now)
    limit = max(1, f.n // 12)
    for phases in (["before-outage"], ["during-outage", "after-restart"]):
        write_log(f, f"{root}/log", phases)
        T.run_limited(logs.topic_log(f.spark, f"{root}/log"), delivery, "limited", limit)
    return copies(delivery.store.read_data(f.spark))


@query(
    "stream_guard",
    """SELECT topic, "partition", min("offset") AS first_offset, max("offset") AS last_offset, count(*) AS offsets,
      count(*) AS "records", CASE phase WHEN 'before-outage' THEN NULL ELSE any_value(current_offset) END AS next_offset,
      CASE phase WHEN 'before-outage' THEN 'first' WHEN 'during-outage' THEN 'ok' ELSE 'gap' END AS status,
      max("offset") + 1 AS new_next, CAST(0 AS BIGINT) AS from_offset
    FROM log
    JOIN group_commits USING (topic, "partition") WHERE phase <> 'after-restart' GROUP BY topic, "partition", phase
    UNION ALL
    SELECT topic, "partition", min("offset"), max("offset"), count(*), count(*), min("offset") - 1, 'gap', max("offset") + 1, 0
    FROM (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY "offset") AS n FROM log WHERE phase = 'after-restart')
    WHERE n > 1 GROUP BY topic, "partition" """,
)
def stream_guard(f: Fixtures) -> DataFrame:
    """Keyed state over a restart: a batch a phase; the last lacks the first record of each partition."""
    root = work_dir(f.spark, "guard")
    first = F.row_number().over(Window.partitionBy("partition").orderBy("offset")) == 1
    late = f.log.where("phase = 'after-restart'").withColumn("first", first).where("NOT first")
    parts = [f.log.where("phase = 'before-outage'"), f.log.where("phase = 'during-outage'"), late]
    for rows in parts:
        rows.select(*LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
        verdicts = contiguity_stream(logs.topic_log(f.spark, f"{root}/log", streaming=True))
        with rocksdb_state(f.spark):
            query = (
                verdicts.writeStream.format("parquet")
                .option("path", f"{root}/verdicts")
                .option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
        query.awaitTermination()
    return f.spark.read.parquet(f"{root}/verdicts")


@query(
    "hop_lineage",
    """SELECT topic AS src_topic, "partition" AS src_part, "offset" AS src_offset,
      CAST(2 AS BIGINT) AS copies FROM log WHERE phase = 'before-outage'""",
)
def hop_lineage(f: Fixtures) -> DataFrame:
    """A hop that lost its checkpoint sent the records of before the outage twice; found by position alone."""
    root = work_dir(f.spark, "lineage")
    router = T.Router(f"{root}/topic2", partitions=2)
    for number, phases in enumerate((["before-outage"], ["before-outage", "during-outage", "after-restart"])):
        write_log(f, f"{root}/log-{number}", phases)
        log = logs.topic_log(f.spark, f"{root}/log-{number}", streaming=True)
        T.run_router(log, router, f"{root}/c{number}").awaitTermination()
    found = R.hop_lineage(router.read_lineage(f.spark))
    return found.where("copies > 1").drop("partition", "offset")
