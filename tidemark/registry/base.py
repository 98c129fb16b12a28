"""Registration, and the fixture tables of ``tidemark.fixtures`` in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.fixtures import DAY_MS, NOW_MS, STRAY_ID, Fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PRELUDE = f"""
WITH ev AS (SELECT event_id, epoch_us(ts) // 1000 AS produced_at,
  concat_ws('|', event_type, props, CAST(user_id AS VARCHAR)) AS payload FROM events),
nn AS (SELECT max(event_id) + 1 AS n FROM ev),
ledger AS (
  SELECT event_id, produced_at,
    CASE WHEN event_id % 500 = 0 THEN 'rare' WHEN event_id % 97 = 0 THEN 'x'
         WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS route,
    CASE WHEN event_id < n / 3.0 THEN 'before-outage'
         WHEN event_id < n * 5 / 6.0 THEN 'during-outage' ELSE 'after-restart' END AS phase,
    produced_at AS record_ts, payload
  FROM ev, nn),
log AS (
  SELECT 'events' AS topic, CAST(event_id % 3 AS INTEGER) AS "partition",
    event_id // 3 AS "offset", record_ts, event_id, produced_at, route, phase,
    payload,
    event_id || chr(9) || produced_at || chr(9) || route || chr(9) || payload AS value,
    CASE route WHEN 'a' THEN 't_a' WHEN 'b' THEN 't_b' WHEN 'rare' THEN 't_rare' END AS sink_table
  FROM ledger),
skewed AS (
  SELECT * REPLACE (CASE WHEN phase = 'during-outage' THEN record_ts - {DAY_MS} ELSE record_ts END
                    AS record_ts) FROM log),
clean AS (SELECT * FROM log WHERE sink_table IS NOT NULL),
sink AS (
  SELECT * FROM clean WHERE event_id % 41 <> 0
  UNION ALL SELECT * FROM clean WHERE event_id % 41 <> 0 AND event_id % 53 = 0
  UNION ALL SELECT * REPLACE (event_id + {STRAY_ID} AS event_id) FROM clean WHERE event_id % 211 = 0),
half AS (
  SELECT * FROM clean WHERE phase <> 'after-restart'
    AND (sink_table <> 't_b' OR (phase = 'before-outage' AND "partition" <> 1))),
rejects AS (
  SELECT * FROM clean WHERE phase = 'during-outage' AND event_id % 10 = 0),
bounds AS (
  SELECT topic, "partition", min("offset") AS "begin", max("offset") + 1 AS "end"
  FROM log GROUP BY ALL),
group_commits AS (
  SELECT topic, "partition", max("offset") + 1 AS current_offset
  FROM log WHERE phase = 'before-outage' GROUP BY ALL),
whole_ranges AS (
  SELECT topic, "partition", "offset" // 50 AS k, min("offset") AS f, max("offset") AS t,
    count(*) AS written_rows, max(produced_at) AS ms
  FROM log WHERE phase = 'before-outage' GROUP BY ALL),
flawed_ranges AS (
  SELECT * FROM whole_ranges WHERE "partition" <> 0 OR k % 7 <> 1
  UNION ALL SELECT * FROM whole_ranges WHERE "partition" = 1 AND k % 7 = 1),
compared AS (
  SELECT sink_table, event_id, CAST(sum(e) AS BIGINT) AS expected_copies,
    CAST(sum(a) AS BIGINT) AS stored_copies
  FROM (SELECT sink_table, event_id, 1 AS e, 0 AS a FROM clean
        UNION ALL SELECT sink_table, event_id, 0, 1 FROM sink) GROUP BY ALL)
"""


def query(name: str, sql: str | None = None, tables: str = ""):
    """Registers a function of the fixtures as a query; ``tables`` adds SQL table
    expressions after the shared ones."""

    def register(build: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"{PRELUDE}{', ' + tables if tables else ''}\n{sql}"
        return build

    return register


__all__ = ["DAY_MS", "NOW_MS", "ORACLES", "QUERIES", "STRAY_ID", "Fixtures", "query"]
