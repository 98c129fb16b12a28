"""Ways to write a batch of delivered events, and the records kept about it.

Every writer here can be called again for the same batch after a failure. The progress row
comes last: a crash in between leaves progress behind the data, which replays and is safe.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.rules import DELIVERED, REJECTED, Rule, dispose
from tidemark.functions.wire import MALFORMED, decode, text_of
from tidemark.operators.frontier import BUCKET
from tidemark.operators.versions import first_version, latest_version
from tidemark.schemas import COMMIT_AUDIT, PARTITION, POSITION, PROGRESS, REJECTS, SINK, TOPIC_LOG
from tidemark.sources.vectors import (
    MAX_PARTITIONS,
    ResumeError,
    Vector,
    at_or_after,
    pin_small,
)
from tidemark.streaming.compaction import ATTEMPT, ATTEMPT_KEYS, Attempts, compact, newest_of, read_current
from tidemark.streaming.places import delete_folder, ensure_table, read_table, work_dir, written

# Event ids per storage range of a table that takes inserts by id.
ID_RANGE = 1 << 24

SINK_COLUMNS = SINK.names
REPLAYED = "replayed"
# A record's place in a hop's topic and where it came from.
LINEAGE = T.StructType(
    [
        *[TOPIC_LOG[name] for name in POSITION],
        *[SINK[name] for name in ("src_topic", "src_part", "src_offset")],
    ]
)
# A batch as it is written down: every record's position and fate, with what its kind needs.
JOURNAL = T.StructType(
    [
        T.StructField("job", T.StringType()),
        *SINK.fields,
        T.StructField("reason", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)


class OffsetGap(RuntimeError):
    """A batch does not continue where the stored progress ends."""


class RunTaken(RuntimeError):
    """A run's name belongs to another checkpoint, whose batches would be overwritten."""


class JournalError(RuntimeError):
    """A journal does not hold the records that passed its writer."""


OWNER = T.StructType([T.StructField("owner", T.StringType()), T.StructField("run", T.StringType())])
NO_QUERY = "no-checkpoint"


def query_id(spark: SparkSession) -> str | None:
    """The id of the streaming query whose batch is being written: that of its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def own_run(spark: SparkSession, path: str, run: str | None) -> str:
    """The run that names the folders of the batch being written.

    Without a name it is the checkpoint's id, so that a new checkpoint never meets the folders
    of an old one. A given name is bound, in the table at ``path``, to the first checkpoint that
    uses it; from any other it raises.

    A batch written outside a streaming query has no checkpoint that pins its records, so it needs
    a name; see ``refuse_finished`` too.
    """
    owner = query_id(spark) or NO_QUERY
    if run is None:
        if owner == NO_QUERY:
            raise RunTaken("a batch outside a streaming query needs a run of its own name")
        return owner
    held = read_table(spark, path, OWNER).where(F.col("run") == run).select("owner").collect()
    if any(row.owner != owner for row in held):
        raise RunTaken(f"run {run!r} belongs to checkpoint {held[0].owner}, this is {owner}")
    if not held:
        claim = spark.createDataFrame([(owner,)], "owner string")
        claim.write.mode("errorifexists").parquet(f"{path}/run={run}")
    return run


def refuse_finished(spark: SparkSession, path: str, run: str, batch_id: int) -> None:
    """Outside a streaming query, raises if this batch of the run has its last folder already."""
    if query_id(spark) is None and written(spark, attempt_path(path, run, batch_id)):
        raise RunTaken(f"batch {batch_id} of run {run!r} is stored; name another run")


def attempt_path(path: str, run: str, batch_id: int) -> str:
    """The folder one batch of one run owns inside a table."""
    return f"{path}/run={run}/batch_id={batch_id}"


def delivered_rows(disposed: DataFrame, now: Column | None = None) -> DataFrame:
    """Delivered records in the sink tables' shape, with the clock of their insertion."""
    return (
        disposed.where(F.col("disposition") == DELIVERED)
        .withColumn("inserted_at", F.current_timestamp() if now is None else now)
        .withColumnsRenamed({"topic": "src_topic", "partition": "src_part", "offset": "src_offset"})
        .select(*SINK_COLUMNS)
    )


def append_fanout(rows: DataFrame, path: str) -> None:
    """K1: plain insert, one folder per table. A replay stores its rows again."""
    rows.write.mode("append").partitionBy("sink_table").parquet(path)


def write_batch_atomic(rows: DataFrame, path: str, run: str, batch_id: int) -> None:
    """K4: the batch owns a folder and replaces it whole, so a replay changes nothing.

    A checkpoint pins the batch's offsets. ``run`` names the checkpoint (see ``own_run``): a
    later one counts its batches from zero again and must not overwrite these. The folder is
    empty for a moment while it is replaced; readers take batches that progress knows.
    """
    rows.write.mode("overwrite").partitionBy("sink_table").parquet(attempt_path(path, run, batch_id))


def absent_rows(
    rows: DataFrame, target: DataFrame, key: list[str], order: list[str] | None = None
) -> DataFrame:
    """The first copy of each key of the batch that the target does not hold yet.

    Both sides shrink to one row per key within the map tasks, before the shuffle.
    """
    fresh = first_version(rows, key, order or ["src_topic", "src_part", "src_offset"])
    return fresh.join(target.select(*key).distinct(), key, "left_anti")


def id_range(width: int = ID_RANGE) -> Column:
    """Storage range of an event id."""
    return F.floor(F.col("event_id") / width).cast("bigint")


LAYOUT = ["sink_table", "id_range"]
RANGED = T.StructType([*SINK.fields, T.StructField("id_range", T.LongType())])
# Which ids of a block of 2^15 are stored: one bit each.
KEYS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("sink_table", T.StringType()),
        T.StructField("id_range", T.LongType()),
    ]
)


def merged_keys(keys: DataFrame) -> DataFrame:
    """One row a block: every id that any attempt stored."""
    own = keys.groupBy(*LAYOUT, "block").agg(
        F.bitmap_or_agg("bits").alias("bits"), F.max("run").alias("run"), F.max("batch_id").alias("batch_id")
    )
    return own.select(*KEYS.names, *ATTEMPT_KEYS)


def _cells(names: list[str]) -> dict[str, str]:
    return {name: name for name in names}


def inserted_rows(path: str) -> Attempts:
    """The rows of a table that takes inserts by id."""
    return Attempts(path, RANGED, _cells(LAYOUT))


def inserted_keys(path: str) -> Attempts:
    """Its key index, in the same folders: exact, one bit an id."""
    return Attempts(f"{path}-keys", KEYS, _cells(LAYOUT), merged_keys)


def insert_commits(spark: SparkSession, path: str) -> DataFrame:
    """(run, batch_id) of the inserts whose rows and keys are both stored."""
    whole = T.StructType([T.StructField("rows", T.LongType()), *ATTEMPT.fields])
    return read_table(spark, f"{path}-commits", whole).select(*ATTEMPT_KEYS)


def read_inserted(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, those of finished inserts only."""
    return read_current(spark, inserted_rows(path), insert_commits(spark, path)).select(*SINK_COLUMNS)


def _has_bit() -> Column:
    """Is the bit of event_id set in ``bits``?"""
    byte = "conv(hex(substring(bits, cast(bitmap_bit_position(event_id) div 8 + 1 as int), 1)), 16, 10)"
    return F.expr(f"shiftright(cast({byte} as int), cast(bitmap_bit_position(event_id) % 8 as int)) & 1 = 1")


def unstored_rows(rows: DataFrame, path: str, run: str, batch_id: int, width: int = ID_RANGE) -> DataFrame:
    """The first copy of each (table, id) of the batch that no other finished insert holds.

    The target is not read, only its key index, and of that only the folders the batch touches: they
    reach the scan as a dynamic partition filter, in any number. Blocks of 2^15 ids, one bit each, meet
    the batch in a join; an earlier attempt of this insert does not count.
    """
    spark = rows.sparkSession
    ranged = rows.withColumns({"id_range": id_range(width), "block": F.bitmap_bucket_number("event_id")})
    touched = ranged.groupBy(*LAYOUT).agg(F.count("*").alias("_rows")).where(F.col("_rows") > 0).select(*LAYOUT)
    other = (F.col("run") != run) | (F.col("batch_id") != batch_id)
    commits = insert_commits(spark, path).where(other)
    held = read_current(spark, inserted_keys(path), commits, touched).select(*KEYS.names)
    fresh = first_version(ranged, [*LAYOUT, "event_id"], ["src_topic", "src_part", "src_offset"])
    met = fresh.join(held, [*LAYOUT, "block"], "left")
    return met.where(F.col("bits").isNull() | ~_has_bit()).select(*SINK_COLUMNS, "id_range")


def insert_if_absent(
    rows: DataFrame, path: str, run: str | None = None, batch_id: int = 0, width: int = ID_RANGE
) -> None:
    """K2: stores events whose (table, id) is not stored yet; a table keeps one ``width``.

    The insert owns a folder of rows, one of keys and one of its commit, written in this order, so that
    a crash leaves rows that no reader counts; written again under the same run and batch it replaces
    itself. Without a run it gets a name of its own. Rows are rebalanced by folder and sorted by id, which
    bounds the number of files and lets readers skip row groups.
    """
    spark = rows.sparkSession
    run = uuid.uuid4().hex if run is None else run
    target = attempt_path(path, run, batch_id)
    (
        unstored_rows(rows, path, run, batch_id, width)
        .hint("rebalance", *LAYOUT)
        .sortWithinPartitions(*LAYOUT, "event_id")
        .write.mode("overwrite")
        .partitionBy(*LAYOUT)
        .parquet(target)
    )
    stored = spark.read.schema(RANGED).parquet(target)
    keys = stored.groupBy(*LAYOUT, F.bitmap_bucket_number("event_id").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("event_id")).alias("bits")
    )
    keys.write.mode("overwrite").partitionBy(*LAYOUT).parquet(attempt_path(f"{path}-keys", run, batch_id))
    count = stored.agg(F.count("*").alias("rows"))
    count.coalesce(1).write.mode("overwrite").parquet(attempt_path(f"{path}-commits", run, batch_id))


def compact_inserted(spark: SparkSession, path: str, finished: DataFrame | None = None) -> None:
    """K3: rows and keys of finished inserts into the table's base; its readers see either state whole."""
    done = insert_commits(spark, path) if finished is None else finished
    compact(spark, inserted_rows(path), done)
    compact(spark, inserted_keys(path), done)


def split_rejects(disposed: DataFrame, job: str, now: Column) -> DataFrame:
    """Rejected and malformed records in the reject table's shape, raw text kept."""
    return disposed.where(F.col("disposition").isin(REJECTED, MALFORMED)).select(
        F.lit(job).alias("job"),
        *POSITION,
        F.col("event_id").cast("string").alias("event_id"),
        "reason",
        now.alias("rejected_at"),
        text_of(F.col("value")).alias("payload"),
    )


def repair_rejects(
    rejects: DataFrame, rules: list[Rule], route_map: dict[str, str] | None = None
) -> DataFrame:
    """K9: rejects read again from their payload under corrected rules.

    The result has dispositions: store the delivered rows with ``insert_if_absent``, the
    rest stays rejected.
    """
    raw = rejects.select(
        *POSITION,
        F.lit(None).cast("bigint").alias("record_ts"),
        F.encode("payload", "UTF-8").alias("value"),
    )
    return dispose(decode(raw), rules, route_map=route_map)


def batch_ranges(batch: DataFrame) -> DataFrame:
    """First, last and distinct offsets of each partition in a batch, whatever became of the
    records; ``records`` counts every copy.

    Offsets are counted as bits, 2^15 to a block, within the map tasks: what is shuffled is at most
    4 KB a block, not a row a position.
    """
    blocks = batch.groupBy(*PARTITION, F.bitmap_bucket_number("offset").alias("_block")).agg(
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("offset"))).alias("offsets"),
        F.count("*").alias("records"),
    )
    return blocks.groupBy(*PARTITION).agg(
        F.min("first_offset").alias("first_offset"),
        F.max("last_offset").alias("last_offset"),
        F.sum("offsets").alias("offsets"),
        F.sum("records").alias("records"),
    )


def stored_progress(progress: DataFrame, job: str) -> DataFrame:
    """The latest progress row of each partition of a job."""
    return latest_version(
        progress.where(F.col("job") == job), ["job", *PARTITION], ["version", "next_offset"]
    )


def check_progress(batch: DataFrame, stored: DataFrame, gaps_allowed: bool = False) -> DataFrame:
    """K6/K7: sets a batch against the stored progress of each partition; see ``check_ranges``."""
    return check_ranges(batch_ranges(batch), stored, gaps_allowed)


def check_ranges(found: DataFrame, stored: DataFrame, gaps_allowed: bool = False) -> DataFrame:
    """K6/K7: sets a batch's ranges against the stored progress of each partition.

    ``first`` without a stored row, ``ok`` if adjacent, ``overlap`` if it starts earlier
    (only its new suffix counts), ``replayed`` if it brings nothing new. ``gap`` if offsets
    are absent before the batch or inside it. ``early`` if it reaches back before the range
    that progress covers, as a log read out of order would. With ``gaps_allowed`` holes
    inside the log are legal and only a start past next_offset is a gap.
    """
    expected = F.col("next_offset")
    reached = F.col("last_offset") + 1
    hole = F.lit(False) if gaps_allowed else (reached - F.col("first_offset") != F.col("offsets"))
    if "from_offset" not in stored.columns:
        stored = stored.withColumn("from_offset", F.lit(None).cast("bigint"))
    ranges = found.join(
        stored.select(*PARTITION, "next_offset", "from_offset"), PARTITION, "left"
    )
    status = (
        F.when(F.col("first_offset") > expected, "gap")
        .when(hole, "gap")
        .when(F.col("first_offset") < F.col("from_offset"), "early")
        .when(expected.isNull(), "first")
        .when(reached <= expected, "replayed")
        .when(F.col("first_offset") < expected, "overlap")
        .otherwise("ok")
    )
    return ranges.withColumns(
        {
            "status": status,
            "new_next": F.greatest(reached, expected),
            "from_offset": F.least("first_offset", "from_offset"),
        }
    )


def guard(checked: DataFrame) -> Vector:
    """Raises on a batch that progress cannot take; else the stored next_offset of the
    partitions the batch overlaps.

    Collects one row per partition of the batch, with the same bound as a start vector.
    """
    rows = checked.select(*PARTITION, "status", "next_offset", "first_offset").limit(
        MAX_PARTITIONS + 1
    ).collect()
    if len(rows) > MAX_PARTITIONS:
        raise ResumeError(f"a batch spans more than {MAX_PARTITIONS} partitions")
    gaps = [r for r in rows if r.status in ("gap", "early")]
    if gaps:
        r = gaps[0]
        raise OffsetGap(
            f"{r.topic}-{r.partition}: {r.status}: batch starts at {r.first_offset}, "
            f"expected {r.next_offset} without a hole ({len(gaps)} partitions in all)"
        )
    return {
        (r.topic, r.partition): r.next_offset for r in rows if r.status in ("overlap", "replayed")
    }


def journal_rows(disposed: DataFrame, job: str, now: Column, stored: DataFrame | None = None) -> DataFrame:
    """Every record of a batch as one row, so that one write stores all that came of it.

    Delivered events are whole, rejected and malformed ones keep their text; of the rest (filtered,
    unrouted, empty) the position remains, which is what progress counts. With ``stored`` (topic, partition,
    next_offset), records that progress covers are ``replayed`` and keep their position only.
    """
    kind = F.col("disposition")
    if stored is not None:
        covered = F.broadcast(stored.select(*PARTITION, F.col("next_offset").alias("_next")))
        disposed = disposed.join(covered, PARTITION, "left")
        kind = F.when(F.col("offset") < F.col("_next"), REPLAYED).otherwise(kind)
    disposed = disposed.withColumn("kind", kind)
    good, bad = F.col("kind") == DELIVERED, F.col("kind").isin(REJECTED, MALFORMED)
    return disposed.select(
        F.lit(job).alias("job"),
        F.when(good | bad, F.col("event_id")).alias("event_id"),
        F.when(good, F.col("produced_at")).alias("produced_at"),
        F.when(good, F.col("route")).alias("route"),
        F.when(good, F.col("payload")).when(bad, text_of(F.col("value"))).alias("payload"),
        F.col("topic").alias("src_topic"),
        F.col("partition").alias("src_part"),
        F.col("offset").alias("src_offset"),
        F.when(good | bad, now).alias("inserted_at"),
        F.when(good, F.col("sink_table")).alias("sink_table"),
        F.when(bad, F.col("reason")).alias("reason"),
        "kind",
    )


def journal_table(path: str) -> Attempts:
    """Batches by kind and table; compaction keeps events and rejects, and drops what is position only."""
    keep = F.col("kind").isin(DELIVERED, REJECTED, MALFORMED)
    cells = {"kind": "kind", "sink_table": "sink_table", "offset_range": f"src_offset div {ID_RANGE}"}
    return Attempts(path, JOURNAL, cells, lambda rows: rows.where(keep))


def journal_positions(journal: DataFrame) -> DataFrame:
    """Positions of a journal's records."""
    return journal.select(
        F.col("src_topic").alias("topic"), F.col("src_part").alias("partition"), F.col("src_offset").alias("offset")
    )


def journal_rejects(journal: DataFrame) -> DataFrame:
    """A journal's rejects in the reject table's shape, with run and batch."""
    bad = journal.where(F.col("kind").isin(REJECTED, MALFORMED))
    return bad.select(
        "job", F.col("src_topic").alias("topic"), F.col("src_part").alias("partition"),
        F.col("src_offset").alias("offset"), F.col("event_id").cast("string").alias("event_id"), "reason",
        F.col("inserted_at").alias("rejected_at"), "payload", *ATTEMPT_KEYS,
    )


def new_suffix(batch: DataFrame, overlaps: Vector) -> DataFrame:
    """K6: the rows of a batch that stored progress does not cover."""
    return at_or_after(batch, overlaps)


def progress_rows(
    checked: DataFrame, stored: DataFrame, job: str, now: Column
) -> DataFrame:
    """Where the job stands after a batch: one row for every partition it ever read.

    Partitions the batch did not touch keep their row, so the next batch needs this one only.
    """
    advanced = checked.join(
        stored.select(*PARTITION, F.col("version").alias("_last")), PARTITION, "left"
    ).select(
        F.lit(job).alias("job"),
        *PARTITION,
        "from_offset",
        F.col("new_next").alias("next_offset"),
        F.col("records").alias("rows_written"),
        (F.coalesce("_last", F.lit(0)) + 1).cast("bigint").alias("version"),
        now.alias("updated_at"),
    )
    idle = stored.join(checked.select(*PARTITION), PARTITION, "left_anti")
    return advanced.unionByName(idle.select(*advanced.columns))


def audit_rows(checked: DataFrame, job: str, now: Column) -> DataFrame:
    """One commit note per partition of a batch."""
    note = F.to_json(
        F.struct(
            F.lit(job).alias("job"),
            "topic",
            F.col("partition").alias("p"),
            F.col("first_offset").alias("from"),
            F.col("last_offset").alias("to"),
        )
    )
    return checked.select(
        now.alias("event_time"), F.col("records").alias("written_rows"), note.alias("log_comment")
    )


def write_attempt(rows: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Stores a batch's rows of a side table, replacing an earlier attempt's."""
    rows.write.mode("overwrite").parquet(attempt_path(path, run, batch_id))


def read_attempts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A side table with the run and batch of each row."""
    return read_current(spark, Attempts(path, schema))


def progress_table(path: str) -> Attempts:
    """Progress by batch; compaction keeps the furthest row of each partition."""
    return Attempts(path, PROGRESS, {}, newest_of(["job", *PARTITION], ["version", "next_offset"]))


def audit_table(path: str) -> Attempts:
    """Commit notes by batch, in a base by day."""
    return Attempts(path, COMMIT_AUDIT, {"day": "date(event_time)"})


def read_progress_table(spark: SparkSession, path: str) -> DataFrame:
    """Progress rows of batches that no compaction has absorbed, and the furthest of those before."""
    return read_current(spark, Attempts(path, PROGRESS))


def read_reject_table(spark: SparkSession, path: str) -> DataFrame:
    """All rejects of a table of attempts."""
    return read_attempts(spark, path, REJECTS)


def place_in_topic(
    events: DataFrame,
    topic: str,
    partitions: int,
    ends: DataFrame,
    target: Column | None = None,
    bucket: int = BUCKET,
) -> DataFrame:
    """Partition by event id (or by ``target``) and dense offsets that continue ``ends``.

    Records keep their source order inside a target partition. Numbering is cut into source
    buckets: rows are counted inside a bucket, and only the bucket sizes are summed in
    order, so no task sees a whole partition. Each record keeps its source position as src_topic,
    src_part and src_offset.
    """
    source = ["_src_topic", "_src_part", "_bucket"]
    if target is None:
        target = F.pmod(F.xxhash64("event_id"), F.lit(partitions))
    routed = events.withColumnsRenamed(
        {"topic": "_src_topic", "partition": "_src_part", "offset": "_src_offset"}
    ).withColumns(
        {
            "partition": target.cast("int"),
            "_bucket": F.floor(F.col("_src_offset") / bucket).cast("bigint"),
        }
    )
    earlier = (
        Window.partitionBy("partition").orderBy(*source).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        routed.groupBy("partition", *source)
        .agg(F.count("*").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .join(ends.select("partition", F.col("end").alias("_end")), "partition", "left")
        .select("partition", *source, (F.col("_start") + F.coalesce("_end", F.lit(0))).alias("_start"))
    )
    within = Window.partitionBy("partition", *source).orderBy("_src_offset")
    return (
        routed.withColumn("_rank", F.row_number().over(within))
        .join(starts, ["partition", *source])
        .withColumn("topic", F.lit(topic))
        .withColumn("offset", F.col("_start") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_start")
        .withColumnsRenamed({"_src_topic": "src_topic", "_src_part": "src_part", "_src_offset": "src_offset"})
    )


def write_topic(placed: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Adds a batch to a topic-log table, the source positions in columns of their own, which readers of
    the log leave alone."""
    sources = [name for name in LINEAGE.names if name not in POSITION]
    write_attempt(placed.select(*TOPIC_LOG.names, *sources), path, run, batch_id)


def read_attempt(
    spark: SparkSession, path: str, schema: T.StructType, run: str, batch_id: int
) -> DataFrame:
    """A side table's rows of one batch; fails if that batch was never written."""
    return spark.read.schema(schema).parquet(attempt_path(path, run, batch_id))


def dual_write(rows: DataFrame, old_path: str, new_path: str) -> None:
    """The same batch to the table readers use and to the one they will move to.

    The batch is computed once, into a scratch folder that both tables are filled from, so a clock or a
    rule cannot make them differ.
    """
    spark = rows.sparkSession
    held = f"{work_dir(spark, 'dual')}/batch"
    rows.write.parquet(held)
    for path in (old_path, new_path):
        append_fanout(spark.read.schema(SINK).parquet(held), path)
    delete_folder(spark, held)


def backfill(spark: SparkSession, old_path: str, new_path: str) -> None:
    """The old table's history into the new one; overlap with dual writes is absorbed
    by ``current_rows``."""
    append_fanout(spark.read.schema(SINK).parquet(old_path), new_path)


VERSION_KEY = ["sink_table", "event_id"]
VERSION_ORDER = ["produced_at", "src_topic", "src_part", "src_offset"]


def version_table(path: str, width: int = ID_RANGE) -> Attempts:
    """K3: a table that takes every version of an event and is compacted to the newest of each."""
    cells = {"sink_table": "sink_table", "id_range": f"floor(event_id / {width})"}
    return Attempts(path, SINK, cells, newest_of(VERSION_KEY, VERSION_ORDER))


def add_versions(rows: DataFrame, path: str, run: str, batch_id: int = 0) -> None:
    """K3: an attempt of a version table; written again it replaces itself, and readers see it at once."""
    write_batch_atomic(rows.select(*SINK_COLUMNS), path, run, batch_id)


def current_rows(versions: DataFrame, key: list[str] | None = None) -> DataFrame:
    """K3: one row per key of a table that stores every version: newest produced, then the
    furthest position."""
    return latest_version(versions, key or VERSION_KEY, VERSION_ORDER)


__all__ = [
    "OffsetGap",
    "JournalError",
    "RunTaken",
    "absent_rows",
    "append_fanout",
    "audit_rows",
    "backfill",
    "batch_ranges",
    "check_progress",
    "current_rows",
    "delivered_rows",
    "dual_write",
    "ensure_table",
    "guard",
    "insert_if_absent",
    "new_suffix",
    "own_run",
    "place_in_topic",
    "progress_rows",
    "repair_rejects",
    "split_rejects",
    "stored_progress",
    "write_batch_atomic",
    "write_topic",
]
