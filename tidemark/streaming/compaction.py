"""Compaction of tables that grow by attempts, behind a pointer that readers follow.

A table is a folder of attempts (``run=.../batch_id=...``). Compaction copies finished attempts into
a base, cut into cells by ``layout`` (say table and id range), and then writes one snapshot: which
version of every cell counts, and which attempts the base has absorbed. A snapshot is one small file
and comes last, so a reader sees the state before it or after it, never between: it reads the cells the
newest snapshot names, and the attempts that snapshot has not absorbed.

Only cells that new attempts touch are rewritten. ``reduce`` says what a cell keeps of its rows: with
``newest_of`` one row a key (K3), by default all. ``sweep`` deletes what the newest snapshot does not need;
call it when no reader of an older one is left.

    path/run=R/batch_id=B/...                    attempts, as their writers left them
    path-lists/cell_version=V/...                attempts that a compaction takes up
    path-base/cell_version=V/cell_<name>=.../... cells
    path-snapshots/snapshot=N/...                one file: cells with their version, absorbed attempts
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.versions import latest_version
from tidemark.streaming.places import delete_folder, exists, no_rows, read_table

ATTEMPT = T.StructType([T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())])
ATTEMPT_KEYS = ["run", "batch_id"]
CELL, VERSION = "cell", "cell_version"


@dataclass(frozen=True)
class Attempts:
    """A table of attempts: where it lies, its columns, and how its base is kept.

    ``layout`` names the cells, each by the SQL expression of a row's value; values are kept as text.
    ``reduce`` takes rows with run and batch and returns those to keep, of the same columns. It must give
    the same result over a cell as over all rows, and when applied again.
    """

    path: str
    schema: T.StructType
    layout: dict[str, str] = field(default_factory=dict)
    reduce: Callable[[DataFrame], DataFrame] | None = None

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def cells(self) -> list[str]:
        return [f"{CELL}_{name}" for name in self.layout]

    @property
    def base(self) -> str:
        return f"{self.path}-base"

    @property
    def lists(self) -> str:
        return f"{self.path}-lists"

    @property
    def snapshots(self) -> str:
        return f"{self.path}-snapshots"

    def base_schema(self) -> T.StructType:
        cells = [T.StructField(name, T.StringType()) for name in self.cells]
        return T.StructType([*self.schema.fields, *ATTEMPT.fields, T.StructField(VERSION, T.StringType()), *cells])

    def snapshot_schema(self) -> T.StructType:
        cells = [T.StructField(name, T.StringType()) for name in self.cells]
        return T.StructType([*cells, T.StructField(VERSION, T.StringType()), *ATTEMPT.fields, T.StructField("snapshot", T.LongType())])

    def in_cells(self, rows: DataFrame) -> DataFrame:
        """rows with the cell of each; null values have a cell of their own."""
        values = {cell: F.coalesce(F.expr(sql).cast("string"), F.lit("null")) for cell, sql in zip(self.cells, self.layout.values())}
        return rows.withColumns(values) if values else rows


def newest_of(key: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """K3: keeps one row per key, the newest by order, then by run and batch."""
    return lambda rows: latest_version(rows, key, [*order, *ATTEMPT_KEYS])


def written_attempts(spark: SparkSession, table: Attempts) -> DataFrame:
    """All attempts' rows with run and batch, whether absorbed or not."""
    return read_table(spark, table.path, T.StructType([*table.schema.fields, *ATTEMPT.fields]))


def newest_snapshot(spark: SparkSession, table: Attempts) -> tuple[int, DataFrame | None]:
    """Number and rows of the newest snapshot; 0 and nothing before the first."""
    if not exists(spark, table.snapshots):
        return 0, None
    every = read_table(spark, table.snapshots, table.snapshot_schema())
    number = every.agg(F.max("snapshot")).first()[0]
    return (0, None) if number is None else (number, every.where(F.col("snapshot") == number).drop("snapshot"))


def _tail(
    spark: SparkSession, table: Attempts, snapshot: DataFrame | None, finished: DataFrame | None, reach: DataFrame | None = None
) -> DataFrame:
    """Rows of finished attempts that the snapshot has not absorbed."""
    rows = written_attempts(spark, table)
    if reach is not None:
        rows = rows.join(reach, list(table.layout), "left_semi")
    if snapshot is not None:
        absorbed = snapshot.where(F.col("run").isNotNull()).select(*ATTEMPT_KEYS)
        rows = rows.join(absorbed, ATTEMPT_KEYS, "left_anti")
    return rows if finished is None else rows.join(finished.select(*ATTEMPT_KEYS).distinct(), ATTEMPT_KEYS, "left_semi")


def _base(spark: SparkSession, table: Attempts, snapshot: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """Rows of the cells that the snapshot names."""
    cells = snapshot.where(F.col(VERSION).isNotNull()).select(VERSION, *table.cells)
    rows = read_table(spark, table.base, table.base_schema())
    if reach is not None:
        rows = rows.join(table.in_cells(reach).select(*table.cells), table.cells, "left_semi")
    return rows.join(cells, [VERSION, *table.cells], "left_semi")


def read_current(
    spark: SparkSession, table: Attempts, finished: DataFrame | None = None, reach: DataFrame | None = None
) -> DataFrame:
    """The table's rows, with the run and batch that wrote them.

    ``finished`` (run, batch_id) names the attempts that count; those in the base always do. ``reach``
    holds values of the layout's columns: no other cells, and of attempts partitioned by these columns
    no other folders, are read (dynamic partition pruning, if it has a filter of its own).
    """
    names = [*table.columns, *ATTEMPT_KEYS]
    _, snapshot = newest_snapshot(spark, table)
    if snapshot is None and not exists(spark, table.path):
        return no_rows(spark, T.StructType([*table.schema.fields, *ATTEMPT.fields]))
    rows = _tail(spark, table, snapshot, finished, reach).select(*names)
    if snapshot is not None:
        rows = _base(spark, table, snapshot, reach).select(*names).unionByName(rows)
    return rows if table.reduce is None else table.reduce(rows)


def compact(spark: SparkSession, table: Attempts, finished: DataFrame | None = None, before_snapshot=None) -> int:
    """Absorbs the finished attempts into the base; the number of the snapshot that now counts.

    A job that dies before the snapshot is written leaves cells that no snapshot names. Two jobs at once
    write cells apart; the later snapshot counts, and what it does not name stays in its attempts. Run no
    ``sweep`` beside them. ``before_snapshot`` runs between the two, for tests of a crash there.
    """
    number, snapshot = newest_snapshot(spark, table)
    version = uuid.uuid4().hex
    taken = _tail(spark, table, snapshot, finished).select(*ATTEMPT_KEYS).distinct()
    # Written down first, so that an attempt that finishes meanwhile is neither copied nor absorbed.
    taken.coalesce(1).write.parquet(f"{table.lists}/{VERSION}={version}")
    new = spark.read.schema(ATTEMPT).parquet(f"{table.lists}/{VERSION}={version}")
    if new.isEmpty():
        return number
    fresh = table.in_cells(written_attempts(spark, table).join(new, ATTEMPT_KEYS, "left_semi"))
    names = [*table.columns, *ATTEMPT_KEYS]
    rows = fresh.select(*names)
    if snapshot is not None:
        old = _base(spark, table, snapshot)
        if table.cells:
            old = old.join(fresh.select(*table.cells).distinct(), table.cells, "left_semi")
        rows = old.select(*names).unionByName(rows)
    rows = table.in_cells(rows if table.reduce is None else table.reduce(rows))
    target = f"{table.base}/{VERSION}={version}"
    if table.cells:
        rows.hint("rebalance", *table.cells).write.partitionBy(*table.cells).parquet(target)
    else:
        rows.hint("rebalance").write.parquet(target)
    if before_snapshot is not None:
        before_snapshot()
    made = spark.read.schema(table.base_schema()).parquet(target)
    cells = made.select(*table.cells).distinct().withColumn(VERSION, F.lit(version)) if table.cells else made.limit(1).select(F.lit(version).alias(VERSION))
    entries, absorbed = cells, new
    if snapshot is not None:
        if table.cells:
            kept = snapshot.where(F.col(VERSION).isNotNull()).select(VERSION, *table.cells)
            entries = cells.unionByName(kept.join(cells.select(*table.cells), table.cells, "left_anti"))
        there = written_attempts(spark, table).select(*ATTEMPT_KEYS).distinct()
        before = snapshot.where(F.col("run").isNotNull()).select(*ATTEMPT_KEYS)
        absorbed = before.join(there, ATTEMPT_KEYS, "left_semi").union(new)
    names = [*table.cells, VERSION, *ATTEMPT_KEYS]
    entries = entries.unionByName(absorbed, allowMissingColumns=True).select(*names)
    entries.coalesce(1).write.mode("overwrite").parquet(f"{table.snapshots}/snapshot={number + 1}")
    return number + 1


def sweep(spark: SparkSession, table: Attempts) -> int:
    """Deletes absorbed attempts, cells' versions and snapshots that the newest snapshot does not need.

    Returns how many folders went. Names, not rows, come to the driver: one for each folder to delete.
    """
    number, snapshot = newest_snapshot(spark, table)
    if snapshot is None:
        return 0
    there = written_attempts(spark, table).select(*ATTEMPT_KEYS).distinct()
    attempts = snapshot.where(F.col("run").isNotNull()).select(*ATTEMPT_KEYS).join(there, ATTEMPT_KEYS, "left_semi")
    gone = [f"{table.path}/run={r.run}/batch_id={r.batch_id}" for r in attempts.toLocalIterator()]
    versions = read_table(spark, table.base, table.base_schema()).select(VERSION).distinct()
    unused = versions.join(snapshot.select(VERSION).distinct(), VERSION, "left_anti")
    gone += [f"{table.base}/{VERSION}={r[VERSION]}" for r in unused.toLocalIterator()]
    lists = read_table(spark, table.lists, T.StructType([T.StructField(VERSION, T.StringType())]))
    gone += [f"{table.lists}/{VERSION}={r[VERSION]}" for r in lists.distinct().toLocalIterator()]
    older = read_table(spark, table.snapshots, table.snapshot_schema()).where(F.col("snapshot") < number)
    gone += [f"{table.snapshots}/snapshot={r.snapshot}" for r in older.select("snapshot").distinct().toLocalIterator()]
    for folder in gone:
        delete_folder(spark, folder)
    return len(gone)
