"""Writers, progress and rejects, run as batches against scratch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixtures import JOB, now
from tidemark.functions import rules, wire
from tidemark.registry.base import NOW_MS, Fixtures, query
from tidemark.registry.scans import DIRTY_SQL, dirty_log
from tidemark.schemas import PROGRESS, SINK, TOPIC_LOG
from tidemark.streaming import pipelines as T
from tidemark.streaming import sinks as K
from tidemark.streaming.compaction import compact, read_current, sweep
from tidemark.streaming.places import read_table, work_dir

# A stored row, its clock of insertion in milliseconds.
STORED = [*[name for name in SINK.names if name != "inserted_at"], "inserted_ms"]
ROW_SQL = (
    'event_id, produced_at, route, payload, topic AS src_topic, "partition" AS src_part, '
    '"offset" AS src_offset, sink_table'
)
# Rows of the fixture's sink carry a clock of their own, delivered ones that of the job.
STORED_SQL = f"{ROW_SQL}, produced_at + 1000 AS inserted_ms"
DELIVERED_SQL = f"{ROW_SQL}, CAST({NOW_MS} AS BIGINT) AS inserted_ms"


def stored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("inserted_ms", F.unix_millis("inserted_at")).select(*STORED)


def copies(rows: DataFrame) -> DataFrame:
    return stored(rows).groupBy(*STORED).agg(F.count("*").alias("copies"))


@query(
    "sink_append",
    f"""SELECT {STORED_SQL}, count(*) AS copies FROM (SELECT * FROM clean
      UNION ALL SELECT * FROM clean WHERE phase = 'before-outage') GROUP BY ALL""",
)
def sink_append(f: Fixtures) -> DataFrame:
    """A plain-insert sink, restarted from the beginning after the outage."""
    path = work_dir(f.spark, "append")
    rows = f.clean_sink.select(*SINK.names, "phase")
    K.append_fanout(rows.where("phase = 'before-outage'").drop("phase"), path)
    K.append_fanout(rows.drop("phase"), path)
    return copies(read_table(f.spark, path, SINK))


@query(
    "insert_if_absent",
    f"SELECT {STORED_SQL}, count(*) AS copies FROM clean GROUP BY ALL",
)
def insert_if_absent(f: Fixtures) -> DataFrame:
    """The same replay, with repeats inside the batch too, into a table keyed by event id."""
    path = work_dir(f.spark, "if-absent")
    rows = f.clean_sink.select(*SINK.names, "phase")
    K.insert_if_absent(rows.where("phase = 'before-outage'").drop("phase"), path)
    replay = rows.unionByName(rows.where("event_id % 53 = 0")).drop("phase")
    K.insert_if_absent(replay, path)
    return copies(K.read_inserted(f.spark, path))


@query("sink_idempotent", f"SELECT {STORED_SQL}, count(*) AS copies FROM clean GROUP BY ALL")
def sink_idempotent(f: Fixtures) -> DataFrame:
    """Two batches, the second written twice."""
    path = work_dir(f.spark, "atomic")
    rows = f.clean_sink.select(*SINK.names, "phase")
    early = rows.where("phase = 'before-outage'").drop("phase")
    late = rows.where("phase != 'before-outage'").drop("phase")
    for batch_id, batch in ((0, early), (1, late), (1, late)):
        K.write_batch_atomic(batch, path, "run-0", batch_id)
    return copies(f.spark.read.schema(SINK).parquet(path))


@query(
    "progress_check",
    """SELECT topic, "partition", min("offset") AS first_offset, max("offset") AS last_offset,
      count(*) AS offsets, count(*) AS "records", least(min("offset"), any_value(begin_at)) AS from_offset,
      any_value(current_offset) + any_value(shift) AS next_offset,
      CASE "partition" WHEN 0 THEN 'ok' WHEN 1 THEN 'overlap' ELSE 'gap' END AS status,
      greatest(max("offset") + 1, any_value(current_offset) + any_value(shift)) AS new_next
    FROM log JOIN group_commits USING (topic, "partition")
    JOIN (VALUES (0, 0, 3), (1, 10, 2), (2, -5, 1)) v("partition", shift, begin_at) USING ("partition")
    WHERE phase = 'during-outage' GROUP BY topic, "partition" """,
)
def progress_check(f: Fixtures) -> DataFrame:
    """The outage as one batch: partition 0 continues, 1 overlaps by ten, 2 lacks five."""
    batch = f.log.where("phase = 'during-outage'")
    return K.check_progress(batch, outage_progress(f))


def outage_progress(f: Fixtures) -> DataFrame:
    """Progress at the outage: partition 1 is ten ahead of the commits, 2 five behind."""
    shift = F.when(F.col("partition") == 1, 10).when(F.col("partition") == 2, -5).otherwise(0)
    return f.group_commits.select(
        "topic", "partition", (3 - F.col("partition")).cast("bigint").alias("from_offset"),
        (F.col("current_offset") + shift).alias("next_offset"),
    )


@query(
    "progress_commit",
    f"""SELECT 'writer' AS job, topic, "partition", CAST(any_value(begin_at) AS BIGINT) AS from_offset,
      CASE "partition" WHEN 2 THEN any_value(current_offset) - 5 ELSE max("offset") + 1 END AS next_offset,
      CASE "partition" WHEN 2 THEN 0 ELSE count(*) END AS rows_written,
      CAST(CASE "partition" WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS version,
      CAST({NOW_MS} AS BIGINT) AS updated_ms, CASE "partition" WHEN 2 THEN 0 ELSE count(*) FILTER ("offset" >= current_offset + shift
        AND sink_table IS NOT NULL) END AS stored
    FROM log JOIN group_commits USING (topic, "partition")
    JOIN (VALUES (0, 0, 3), (1, 10, 2), (2, 0, 1)) v("partition", shift, begin_at) USING ("partition")
    WHERE phase = 'during-outage' GROUP BY topic, "partition" """,
)
def progress_commit(f: Fixtures) -> DataFrame:
    """The outage delivered as batches: partitions 0 and 1 commit, of the second only what is new is stored;
    the batch of partition 2 is refused, and its progress stays."""
    store = T.Store(f"{work_dir(f.spark, 'commit')}/store")
    seed = outage_progress(f).withColumns(
        {"job": F.lit(JOB), "rows_written": F.lit(0).cast("bigint"), "version": F.lit(1).cast("bigint"), "updated_at": now()}
    )
    K.write_attempt(seed.select(*PROGRESS.names), store.progress, "before", 0)
    batch = f.log.where("phase = 'during-outage'").select(*TOPIC_LOG.names)
    T.Delivery(store, run="outage", clock=now).write(batch.where("partition < 2"), 0)
    try:
        T.Delivery(store, run="outage-2", clock=now).write(batch.where("partition = 2"), 0)
        raise AssertionError("a gap was accepted")
    except K.OffsetGap:
        pass
    held = store.read_data(f.spark).groupBy(F.col("src_part").alias("partition")).agg(F.count("*").alias("stored"))
    progress = store.read_progress(f.spark).withColumn("updated_ms", F.unix_millis("updated_at"))
    columns = ["job", "topic", "partition", "from_offset", "next_offset", "rows_written", "version", "updated_ms"]
    return progress.select(*columns).join(held, "partition", "left").na.fill({"stored": 0})


@query(
    "reject_split",
    f"""SELECT 'writer' AS job, topic, "partition", "offset", CAST(event_id AS VARCHAR) AS event_id,
      reason, value AS payload, CAST({NOW_MS} AS BIGINT) AS rejected_ms FROM disposed WHERE disposition IN ('rejected', 'malformed')""",
    DIRTY_SQL,
)
def reject_split(f: Fixtures) -> DataFrame:
    judged = rules.dispose(wire.decode(dirty_log(f)), rules.every_nth_is_bad(10), drop_route="rare")
    bad = K.split_rejects(judged, JOB, now())
    return bad.withColumn("rejected_ms", F.unix_millis("rejected_at")).drop("rejected_at")


@query(
    "reject_repair",
    f"""SELECT {ROW_SQL}, CASE WHEN phase = 'during-outage' AND event_id % 10 = 0 THEN {NOW_MS}
      ELSE produced_at + 1000 END AS inserted_ms, count(*) AS copies FROM clean GROUP BY ALL""",
)
def reject_repair(f: Fixtures) -> DataFrame:
    """The sink without the poisoned rows, then those rows from the reject table."""
    path = work_dir(f.spark, "repair")
    K.insert_if_absent(f.sound(f.clean_sink).select(*SINK.names), path)
    repaired = K.repair_rejects(f.rejects, rules=[])
    for _ in range(2):
        K.insert_if_absent(K.delivered_rows(repaired, now()), path)
    return copies(K.read_inserted(f.spark, path))


@query(
    "router_hop",
    """SELECT event_id, CAST("partition" AS INTEGER) AS "partition", 100 + row_number() OVER (
        PARTITION BY "partition" ORDER BY src_part, src_offset) - 1 AS "offset", value
    FROM (SELECT event_id, event_id // 3 % 2 AS "partition", "partition" AS src_part,
            "offset" AS src_offset, value FROM log WHERE route <> 'rare')""",
)
def router_hop(f: Fixtures) -> DataFrame:
    """The second topic has two partitions, whose logs already reach offset 100."""
    events = wire.events_only(wire.decode(f.log.select("topic", "partition", "offset", "value")))
    kept = wire.encode(events.where("route != 'rare'"))
    ends = f.spark.range(2).selectExpr("cast(id as int) AS partition", "100L AS end")
    target = F.floor(F.col("event_id") / 3) % 2
    placed = K.place_in_topic(kept, "events-routed", 2, ends, target, bucket=1000)
    return placed.select("event_id", "partition", "offset", F.col("value").cast("string"))


@query(
    "backfill_dedup",
    f"SELECT {STORED_SQL} FROM clean",
)
def backfill_dedup(f: Fixtures) -> DataFrame:
    """History in the old table, the rest written to both, history copied, then read deduplicated."""
    root = work_dir(f.spark, "backfill")
    old, new = f"{root}/old", f"{root}/new"
    rows = f.clean_sink.select(*SINK.names, "phase")
    K.append_fanout(rows.where("phase = 'before-outage'").drop("phase"), old)
    K.dual_write(rows.where("phase != 'before-outage'").drop("phase"), old, new)
    K.backfill(f.spark, old, new)
    return stored(K.current_rows(read_table(f.spark, new, SINK)))


@query("compacted_current", f"SELECT {STORED_SQL} FROM clean")
def compacted_current(f: Fixtures) -> DataFrame:
    """A table of versions, compacted, written to again (with versions it holds), compacted and swept."""
    table = K.version_table(f"{work_dir(f.spark, 'versions')}/events", width=1 << 12)
    rows = f.clean_sink.select(*SINK.names, "phase")
    late = F.col("phase") == "after-restart"
    for number, part in enumerate((~late, late | (F.col("event_id") % 53 == 0))):
        for half in (0, 1):
            K.add_versions(rows.where(part & (F.col("event_id") % 2 == half)), table.path, f"load-{number}", half)
        compact(f.spark, table)
    sweep(f.spark, table)
    return stored(read_current(f.spark, table))


@query("batch_backfill_store", f"SELECT {DELIVERED_SQL}, count(*) AS copies FROM clean GROUP BY ALL")
def batch_backfill_store(f: Fixtures) -> DataFrame:
    """Two batch jobs without a checkpoint fill one store; a third that takes the first one's name is refused."""
    store = T.Store(f"{work_dir(f.spark, 'batch-jobs')}/store")
    early = F.col("phase") == "before-outage"
    log = f.log.withColumn("early", early)
    for run, part in (("history", F.col("early")), ("rest", ~F.col("early"))):
        T.Delivery(store, run=run, clock=now).write(log.where(part).select(*TOPIC_LOG.names), 0)
    try:
        T.Delivery(store, run="history", clock=now).write(log.where(~F.col("early")).select(*TOPIC_LOG.names), 0)
    except K.RunTaken:
        return copies(store.read_data(f.spark))
    raise AssertionError("a finished batch was written again")
