"""Retained history and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators import time_index as X
from tidemark.registry.base import DAY_MS, NOW_MS, Fixtures, query
from tidemark.sources.logs import pinned_bounds

# Half a day on either side of where the outage's clocks jump back.
LO, HI = NOW_MS - 43 * DAY_MS // 2, NOW_MS - 41 * DAY_MS // 2

PROFILE = """SELECT topic, "partition", min("offset") AS "begin", max("offset") + 1 AS "end",
  count(*) AS "records", arg_min(record_ts, "offset") AS first_offset_ts,
  arg_max(record_ts, "offset") AS last_offset_ts, min(record_ts) AS min_ts, max(record_ts) AS max_ts,
  max("offset") + 1 - min("offset") AS span, max("offset") + 1 - min("offset") - count(*) AS holes"""


@query(
    "history_profile",
    f"""SELECT b.topic, b."partition", b."begin", b."end", coalesce("records", 0) AS "records", first_offset_ts,
      last_offset_ts, min_ts, max_ts, b."end" - b."begin" AS span,
      b."end" - b."begin" - coalesce("records", 0) AS holes
    FROM (SELECT topic, "partition", "begin", "end" + 5 AS "end" FROM bounds
        UNION ALL SELECT 'events', 9, 0, 0) b
      LEFT JOIN ({PROFILE} FROM skewed WHERE event_id % 7 <> 3 GROUP BY topic, "partition") p
      USING (topic, "partition")""",
)
def history_profile(f: Fixtures) -> DataFrame:
    """A log with holes at every seventh record and clocks out of order. Its bounds know of five
    offsets past the last record, and of a partition without records."""
    found = pinned_bounds(f.log).withColumn("end", F.expr("end + 5"))
    empty = f.spark.sql("SELECT 'events' AS topic, 9 AS partition, 0L AS begin, 0L AS end")
    return H.history_profile(f.skewed_log.where("event_id % 7 != 3"), bounds=found.unionByName(empty))


@query(
    "interval_count",
    f"""SELECT *, greatest(to_offset - from_offset, 0) AS span FROM (
      SELECT topic, "partition",
        coalesce(min("offset") FILTER (WHERE record_ts >= {LO}), max("offset") + 1) AS from_offset,
        coalesce(min("offset") FILTER (WHERE record_ts >= {HI}), max("offset") + 1) AS to_offset,
        count(*) FILTER (WHERE record_ts >= {LO} AND record_ts < {HI}) AS "records"
      FROM skewed GROUP BY topic, "partition")""",
)
def interval_count(f: Fixtures) -> DataFrame:
    return H.interval_count(f.skewed_log, LO, HI)


@query(
    "interval_count_produced",
    f"""SELECT *, greatest(to_offset - from_offset, 0) AS span FROM (
      SELECT topic, "partition",
        coalesce(min("offset") FILTER (WHERE produced_at >= {LO}), max("offset") + 1) AS from_offset,
        coalesce(min("offset") FILTER (WHERE produced_at >= {HI}), max("offset") + 1) AS to_offset,
        count(*) FILTER (WHERE produced_at >= {LO} AND produced_at < {HI}) AS "records"
      FROM skewed GROUP BY topic, "partition")""",
)
def interval_count_produced(f: Fixtures) -> DataFrame:
    return H.interval_count(f.skewed_log, LO, HI, "produced_at")


@query(
    "interval_miss",
    f"""SELECT s.topic, s."partition", s."offset", s.record_ts FROM skewed s JOIN (
      SELECT "partition" AS p,
        coalesce(min("offset") FILTER (WHERE record_ts >= {LO}), max("offset") + 1) AS from_offset,
        coalesce(min("offset") FILTER (WHERE record_ts >= {HI}), max("offset") + 1) AS to_offset
      FROM skewed GROUP BY "partition") ON p = s."partition"
    WHERE record_ts >= {LO} AND record_ts < {HI} AND ("offset" < from_offset OR "offset" >= to_offset)""",
)
def interval_miss(f: Fixtures) -> DataFrame:
    return H.interval_miss(f.skewed_log, LO, HI)


@query(
    "time_index_miss",
    f"""SELECT s.topic, s."partition", s."offset", s.record_ts FROM skewed s JOIN (
      SELECT "partition" AS p,
        coalesce(min("offset") FILTER (WHERE record_ts >= {LO}), max("offset") + 1) AS from_offset,
        coalesce(min("offset") FILTER (WHERE record_ts >= {HI}), max("offset") + 1) AS to_offset
      FROM skewed GROUP BY "partition") ON p = s."partition"
    WHERE record_ts >= {LO} AND record_ts < {HI} AND ("offset" < from_offset OR "offset" >= to_offset)""",
)
def time_index_miss(f: Fixtures) -> DataFrame:
    """The same through an index of the clocks."""
    return X.interval_miss(f.skewed_log, X.build_index(f.skewed_log, block=256), LO, HI)


@query(
    "retention_estimate",
    f"""SELECT topic, "partition", bytes, size_window_ms,
      least(CAST({7 * DAY_MS} AS BIGINT), size_window_ms) AS window_ms,
      CASE WHEN size_window_ms < {7 * DAY_MS} THEN 'size' ELSE 'time' END AS bound_by
    FROM (SELECT *, CAST(floor(CAST(20000 AS DOUBLE) / bytes * (hi - lo)) AS BIGINT) AS size_window_ms
      FROM (SELECT topic, "partition", CAST(sum(strlen(value)) AS BIGINT) AS bytes, min(record_ts) AS lo,
        max(record_ts) AS hi FROM log GROUP BY topic, "partition"))""",
)
def retention_estimate(f: Fixtures) -> DataFrame:
    """Seven days or 20,000 bytes a partition."""
    return H.retention_estimate(H.history_profile(f.log, with_bytes=True), 7 * DAY_MS, 20_000)
