"""Sink tables behind JDBC: the options of each write, and a writer for ``foreachBatch``.

Spark's JDBC writer appends; it can't skip rows that are there. So a batch goes to a staging table
first, marked with its run and number, and one statement for each table moves it on and leaves out
ids that the table holds. A replayed batch clears its own staged rows before it stages again, and the
transaction that moves them clears them too, so both steps may run any number of times and staging
stays small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import SINK
from tidemark.sources.vectors import pin_small
from tidemark.streaming.places import delete_folder, work_dir
from tidemark.streaming.sinks import batch_ranges, journal_positions, own_run

COLUMNS = [name for name in SINK.names if name != "sink_table"]
Save = Callable[[DataFrame, dict[str, str]], None]
Transact = Callable[[list[str]], None]


def write_options(url: str, table: str, parts: int = 8, batch_rows: int = 10_000) -> dict[str, str]:
    """K1: options of one appending write; ``parts`` bounds its connections."""
    return {
        "url": url, "dbtable": table, "numPartitions": str(parts), "batchsize": str(batch_rows),
        "isolationLevel": "READ_COMMITTED",
    }


def staging_table(table: str) -> str:
    return f"{table}_staging"


def clear_statement(table: str, run: str, batch_id: int) -> str:
    """Removes what an earlier attempt at a batch staged."""
    return f"DELETE FROM {staging_table(table)} WHERE run = {_text(run)} AND batch_id = {batch_id:d}"


def move_statement(table: str, run: str, batch_id: int, key: str = "event_id") -> str:
    """K2: moves a staged batch into its table, the first copy of each id that is not there yet."""
    listed = ", ".join(COLUMNS)
    return (
        f"INSERT INTO {table} ({listed}) SELECT {listed} FROM (SELECT s.*, row_number() OVER "
        f"(PARTITION BY {key} ORDER BY src_topic, src_part, src_offset) AS copy FROM {staging_table(table)} s "
        f"WHERE run = {_text(run)} AND batch_id = {batch_id:d}) t WHERE copy = 1 ON CONFLICT ({key}) DO NOTHING"
    )


PROGRESS_TABLE = "etl_progress"


def progress_statement(job: str, topic: str, partition: int, first: int, next_offset: int, gaps_allowed: bool = False) -> str:
    """K6: moves stored progress on, in the transaction that moves the rows.

    It changes no row, and so fails the check of ``progress_check``, if the batch starts past stored progress.
    """
    reach = "" if gaps_allowed else f" WHERE {PROGRESS_TABLE}.next_offset >= {first:d}"
    return (
        f"INSERT INTO {PROGRESS_TABLE} (job, topic, part, next_offset) VALUES "
        f"({_text(job)}, {_text(topic)}, {partition:d}, {next_offset:d}) ON CONFLICT (job, topic, part) DO UPDATE "
        f"SET next_offset = greatest({PROGRESS_TABLE}.next_offset, excluded.next_offset){reach}"
    )


def progress_check(job: str, topic: str, partition: int, next_offset: int) -> str:
    """Fails (division by zero) and so rolls the transaction back, unless progress reached the batch's end."""
    return (
        f"SELECT 1 / count(*) FROM {PROGRESS_TABLE} WHERE job = {_text(job)} AND topic = {_text(topic)} "
        f"AND part = {partition:d} AND next_offset >= {next_offset:d}"
    )


def position_options(url: str, job: str, topic: str) -> dict[str, str]:
    """Options that read a job's stored positions (topic, partition, next_offset) for ``from_stored``."""
    stored = f"SELECT topic, part AS partition, next_offset FROM {PROGRESS_TABLE}"
    return {"url": url, "query": f"{stored} WHERE job = {_text(job)} AND topic = {_text(topic)}"}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def save_jdbc(rows: DataFrame, options: dict[str, str]) -> None:
    rows.write.format("jdbc").options(**options).mode("append").save()


def batch_writer(
    url: str,
    tables: list[str],
    transact: Transact,
    owners: str,
    run: str | None = None,
    save: Save = save_jdbc,
    job: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for delivered rows: stages each table's rows, then moves them all at once.

    The batch is written down once, in a scratch folder, so that it is not computed again for each table.
    ``transact`` runs statements in one transaction of the database: the moves, the removal of what was
    staged and, with ``job``, the progress of each partition, so rows and progress are stored together or
    not at all. ``owners`` is the folder that binds a named run to its checkpoint (see ``own_run``).

    The function takes the positions (topic, partition, offset) of every record of the batch as a third
    argument; then a batch that starts past stored progress is refused. Without them progress follows the
    delivered rows, whose offsets may have gaps.
    """

    def write(rows: DataFrame, batch_id: int, positions: DataFrame | None = None) -> None:
        spark = rows.sparkSession
        name = own_run(spark, owners, run)
        held = f"{work_dir(spark, 'jdbc')}/batch"
        rows.select(*SINK.names).write.parquet(held)
        rows = spark.read.schema(SINK).parquet(held)
        transact([clear_statement(table, name, batch_id) for table in tables])
        for table in tables:
            part = rows.where(F.col("sink_table") == table).select(*COLUMNS)
            marked = part.withColumn("run", F.lit(name)).withColumn("batch_id", F.lit(batch_id).cast("long"))
            save(marked, write_options(url, staging_table(table)))
        statements = [move_statement(table, name, batch_id) for table in tables]
        statements += [clear_statement(table, name, batch_id) for table in tables]
        if job is not None:
            ranges = batch_ranges(journal_positions(rows) if positions is None else positions)
            for r in pin_small(ranges).collect():
                place = (job, r.topic, r.partition)
                statements.append(progress_statement(*place, r.first_offset, r.last_offset + 1, positions is None))
                statements.append(progress_check(*place, r.last_offset + 1))
        transact(statements)
        delete_folder(spark, held)

    return write
