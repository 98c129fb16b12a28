"""Health checks at a fixed clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixtures import JOB, TOPIC, now
from tidemark.operators import frontier as W
from tidemark.operators import health as M
from tidemark.registry.base import DAY_MS, NOW_MS, Fixtures, query
from tidemark.registry.resume import done_positions
from tidemark.schemas import TABLES
from tidemark.sources.logs import pinned_bounds
from tidemark.sources.tables import commit_ranges, read_progress, read_rejects

DAY_MINUTES = 1440


@query(
    "lag",
    """SELECT topic, "partition", "end", current_offset, "end" - coalesce(current_offset, "begin") AS lag
    FROM bounds LEFT JOIN (SELECT * FROM group_commits WHERE "partition" <> 2) USING (topic, "partition")""",
)
def lag(f: Fixtures) -> DataFrame:
    return M.lag(pinned_bounds(f.log), f.group_commits.where("partition != 2"))


@query(
    "stale_tables",
    f"""SELECT w.sink_table, {NOW_MS} - max(produced_at + 1000) AS age_ms,
      coalesce({NOW_MS} - max(produced_at + 1000) > 2880 * 60000, true) AS stale
    FROM (SELECT unnest(['t_a', 't_b', 't_rare', 't_new']) AS sink_table) w
    LEFT JOIN (SELECT * FROM clean WHERE sink_table <> 't_b' OR phase = 'before-outage') s USING (sink_table)
    GROUP BY w.sink_table""",
)
def stale_tables(f: Fixtures) -> DataFrame:
    """One table stopped at the outage, one never got a row."""
    sink = f.clean_sink.where("sink_table != 't_b' OR phase = 'before-outage'")
    return M.stale_tables(sink, [*TABLES, "t_new"], now(), 2 * DAY_MINUTES)


@query(
    "reject_rate",
    f"""SELECT 'writer' AS job, 'poison' AS reason, count(*) AS rejects FROM rejects
    WHERE produced_at > {NOW_MS - 15 * DAY_MS} AND produced_at <= {NOW_MS} GROUP BY ALL""",
)
def reject_rate(f: Fixtures) -> DataFrame:
    return M.reject_rate(f.rejects, now(), 15 * DAY_MINUTES)


@query(
    "rejects_since",
    f"""SELECT topic, "partition", "offset", CAST(event_id AS VARCHAR) AS event_id, value AS payload
    FROM rejects WHERE produced_at >= {NOW_MS - 15 * DAY_MS}""",
)
def rejects_since(f: Fixtures) -> DataFrame:
    since = F.timestamp_millis(F.lit(NOW_MS - 15 * DAY_MS))
    return read_rejects(f.rejects, JOB, since).select(
        "topic", "partition", "offset", "event_id", "payload"
    )


@query(
    "stalled_progress",
    f"""SELECT job, topic, "partition", next_offset, age_ms FROM (
      SELECT 'writer' AS job, topic, "partition", max(t) + 1 AS next_offset, {NOW_MS} - max(ms) AS age_ms
      FROM whole_ranges GROUP BY topic, "partition"
      UNION ALL SELECT 'other', topic, "partition", max("offset") + 1, {NOW_MS} - max(produced_at)
      FROM log GROUP BY topic, "partition")
    WHERE age_ms > 2880 * 60000""",
)
def stalled_progress(f: Fixtures) -> DataFrame:
    """The writer stopped at the outage; another job is up to date."""
    other = f.log.groupBy("topic", "partition").agg(
        (F.max("offset") + 1).alias("next_offset"),
        F.count("*").alias("rows_written"),
        F.timestamp_millis(F.max("produced_at")).alias("updated_at"),
    )
    rows = f.progress_rows.unionByName(other.withColumn("job", F.lit("other")))
    return M.stalled_progress(rows, now(), 2 * DAY_MINUTES)


@query(
    "retention_headroom",
    f"""SELECT topic, "partition", min("offset") AS oldest_needed,
      {NOW_MS} - arg_min(record_ts, "offset") AS age_ms,
      {25 * DAY_MS} - ({NOW_MS} - arg_min(record_ts, "offset")) AS headroom_ms
    FROM log JOIN (SELECT topic, "partition", min("offset") AS next_offset FROM clean
      WHERE event_id NOT IN (SELECT event_id FROM half) GROUP BY ALL) USING (topic, "partition")
    WHERE "offset" >= next_offset GROUP BY topic, "partition" """,
)
def retention_headroom(f: Fixtures) -> DataFrame:
    reached = W.frontier(f.log, done_positions(f))
    return M.retention_headroom(f.log, reached, 25 * DAY_MS, NOW_MS)


@query(
    "progress_crosscheck",
    """SELECT topic, "partition", next_offset, audit_next,
      CASE WHEN audit_next IS NULL THEN 'no-audit' WHEN next_offset IS NULL THEN 'no-progress'
        WHEN next_offset > audit_next THEN 'progress-ahead'
        WHEN next_offset < audit_next THEN 'progress-behind' ELSE 'agree' END AS status
    FROM (SELECT topic, "partition", max(t) + 1 AS next_offset FROM whole_ranges
          WHERE "partition" <> 2 GROUP BY ALL)
    FULL JOIN (SELECT topic, "partition", max(t) + 1 AS audit_next FROM flawed_ranges
          WHERE "partition" <> 1 OR k < 1 GROUP BY ALL) USING (topic, "partition")""",
)
def progress_crosscheck(f: Fixtures) -> DataFrame:
    """Partition 1's audit ends after its first range; partition 2 has no progress row."""
    progress = read_progress(f.progress_rows.where("partition != 2"), JOB, TOPIC)
    ranges = commit_ranges(f.commits("flawed")).where("partition != 1 OR from_offset < 50")
    return M.progress_crosscheck(progress, ranges)
