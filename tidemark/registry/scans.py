"""Scans, wire format, routes and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixtures import JOB, TOPIC
from tidemark.functions import routes, rules, wire
from tidemark.registry.base import DAY_MS, NOW_MS, Fixtures, query
from tidemark.schemas import TOPIC_LOG
from tidemark.sources import logs, tables
from tidemark.sources.vectors import collect_vector
from tidemark.streaming.places import work_dir

PLACE = ["topic", "partition", "offset"]
EVENT = ["event_id", "produced_at", "route", "payload"]


@query(
    "topic_scan",
    """SELECT topic, "partition", "offset", record_ts, CAST(event_id AS VARCHAR) AS "key", value
    FROM log""",
)
def topic_scan(f: Fixtures) -> DataFrame:
    path = work_dir(f.spark, "topic-scan")
    f.log.select(*TOPIC_LOG.names).write.parquet(path)
    log = logs.topic_log(f.spark, path)
    return log.withColumns({c: F.col(c).cast("string") for c in ("key", "value")})


@query(
    "bounded_replay",
    """SELECT l.topic, l."partition", l."offset", l.event_id FROM log l
    JOIN group_commits g USING (topic, "partition")
    JOIN (SELECT topic, "partition", max("offset") + 1 AS stop FROM log
          WHERE phase <> 'after-restart' GROUP BY ALL) e USING (topic, "partition")
    WHERE l."offset" >= g.current_offset AND l."offset" < e.stop""",
)
def bounded_replay(f: Fixtures) -> DataFrame:
    """The outage's records: from the commits to where the log stood at the restart."""
    starts = collect_vector(f.group_commits, "current_offset")
    ends = collect_vector(logs.log_bounds(f.log.where("phase != 'after-restart'")), "end")
    bounds = logs.pinned_bounds(f.log)
    return logs.read_range(f.log, starts, ends, bounds).select(*PLACE, "event_id")


@query("ledger_scan", "SELECT event_id, produced_at, route, phase, record_ts FROM ledger")
def ledger_scan(f: Fixtures) -> DataFrame:
    path = work_dir(f.spark, "ledger")
    f.ledger.write.json(path)
    return tables.read_ledger(f.spark, path)


@query("sink_scan", "SELECT sink_table, event_id FROM sink WHERE sink_table IN ('t_a', 't_rare')")
def sink_scan(f: Fixtures) -> DataFrame:
    path = work_dir(f.spark, "sink-scan")
    f.sink.write.partitionBy("sink_table").parquet(path)
    return tables.read_sink(f.spark, path, ["t_a", "t_rare"], ["event_id"])


@query(
    "progress_scan",
    """SELECT 'writer' AS job, topic, "partition", arg_max(t + 1, (ms, t)) AS next_offset,
    arg_max(written_rows, (ms, t)) AS rows_written FROM whole_ranges GROUP BY topic, "partition" """,
)
def progress_scan(f: Fixtures) -> DataFrame:
    others = f.progress_rows.withColumn("topic", F.lit("events-routed"))
    every = f.progress_rows.unionByName(others)
    return tables.read_progress(every, JOB, TOPIC).drop("updated_at")


@query(
    "commit_audit",
    f"""SELECT ms AS event_ms, written_rows, topic, "partition", max(t) AS last_offset
    FROM flawed_ranges WHERE ms > {NOW_MS - 30 * DAY_MS} GROUP BY ALL
    ORDER BY ms DESC, topic, "partition", written_rows DESC LIMIT 50""",
)
def commit_audit(f: Fixtures) -> DataFrame:
    since = F.timestamp_millis(F.lit(NOW_MS - 30 * DAY_MS))
    newest = tables.read_commits(f.commits("flawed"), since, 50)
    return newest.select(
        F.unix_millis("event_time").alias("event_ms"), "written_rows", "topic", "partition", "last_offset"
    )


# Lines a producer should not have written, spread over the log by event id.
DIRTY_SQL = """dirty AS (
  SELECT topic, "partition", "offset", CASE
    WHEN event_id % 89 = 0 THEN event_id || chr(9) || produced_at || chr(9) || route
    WHEN event_id % 101 = 0 THEN ' ' || value
    WHEN event_id % 103 = 0 THEN event_id || chr(9) || 'x' || chr(9) || route || chr(9) || payload
    WHEN event_id % 107 = 0 THEN NULL
    WHEN event_id % 109 = 0 THEN value || chr(9) || 'fifth'
    WHEN event_id % 113 = 0 THEN event_id || chr(9) || produced_at || chr(9) || route || chr(9)
    WHEN event_id % 127 = 0 THEN '9' || '999999999999999999' || chr(9) || produced_at || chr(9) || route || chr(9) || payload
    ELSE value END AS value FROM log),
parts AS (SELECT *, string_split(value, chr(9)) AS p FROM dirty),
decoded AS (
  SELECT topic, "partition", "offset", value,
    CASE WHEN regexp_full_match(p[1], '[+-]?[0-9]+') THEN TRY_CAST(p[1] AS BIGINT) END AS event_id,
    CASE WHEN regexp_full_match(p[2], '[+-]?[0-9]+') THEN TRY_CAST(p[2] AS BIGINT) END AS produced_at,
    p[3] AS route, p[4] AS payload, len(p) AS fields FROM parts),
judged AS (
  SELECT *, CASE WHEN value IS NULL THEN 'empty' WHEN fields < 4 OR event_id IS NULL OR produced_at IS NULL
      THEN 'malformed' ELSE 'event' END AS how,
    CASE WHEN value IS NULL THEN NULL WHEN fields < 4 THEN 'fields' WHEN event_id IS NULL THEN 'event_id'
      WHEN produced_at IS NULL THEN 'produced_at' END AS why FROM decoded),
disposed AS (
  SELECT * EXCLUDE (how, why), CASE WHEN how <> 'event' THEN NULL WHEN route = 'a' THEN 't_a'
      WHEN route = 'b' THEN 't_b' WHEN route = 'rare' THEN 't_rare' END AS sink_table,
    CASE WHEN how <> 'event' THEN how WHEN route = 'rare' THEN 'filtered' WHEN route NOT IN ('a', 'b')
      THEN 'unrouted' WHEN event_id % 10 = 0 THEN 'rejected' ELSE 'delivered' END AS disposition,
    CASE WHEN how <> 'event' THEN why WHEN route IN ('a', 'b') AND event_id % 10 = 0 THEN 'poison' END AS reason
  FROM judged)"""


def dirty_log(f: Fixtures) -> DataFrame:
    eid, text = F.col("event_id"), F.col("value").cast("string")
    start = F.concat_ws(wire.TAB, eid.cast("string"), F.col("produced_at").cast("string"), "route")
    value = (
        F.when(eid % 89 == 0, start)
        .when(eid % 101 == 0, F.concat(F.lit(" "), text))
        .when(eid % 103 == 0, F.concat_ws(wire.TAB, eid.cast("string"), F.lit("x"), "route", "payload"))
        .when(eid % 107 == 0, F.lit(None).cast("string"))
        .when(eid % 109 == 0, F.concat(text, F.lit("\tfifth")))
        .when(eid % 113 == 0, F.concat(start, F.lit("\t")))
        .when(
            eid % 127 == 0,
            F.concat_ws(wire.TAB, F.lit("9" * 19), F.col("produced_at").cast("string"), "route", "payload"),
        )
        .otherwise(text)
    )
    return f.log.select(*PLACE, value.cast("binary").alias("value"))


@query(
    "wire_decode",
    """SELECT topic, "partition", "offset", event_id, produced_at, route, payload FROM judged
    WHERE how = 'event'""",
    DIRTY_SQL,
)
def wire_decode(f: Fixtures) -> DataFrame:
    return wire.events_only(wire.decode(dirty_log(f))).select(*PLACE, *EVENT)


@query(
    "malformed_records",
    """SELECT topic, "partition", "offset", why AS reason, value AS payload FROM judged
    WHERE how = 'malformed'""",
    DIRTY_SQL,
)
def malformed_records(f: Fixtures) -> DataFrame:
    return wire.malformed(wire.decode(dirty_log(f))).select(*PLACE, "reason", "payload")


@query(
    "wire_roundtrip",
    """SELECT "offset", "partition", CAST(event_id AS VARCHAR) AS "key",
    event_id || chr(9) || produced_at || chr(9) || route || chr(9) || payload AS value
    FROM judged WHERE how = 'event'""",
    DIRTY_SQL,
)
def wire_roundtrip(f: Fixtures) -> DataFrame:
    again = wire.encode(wire.events_only(wire.decode(dirty_log(f))))
    return again.select(
        "offset", "partition", F.col("key").cast("string"), F.col("value").cast("string")
    )


@query("route_filter", "SELECT event_id, route FROM ledger WHERE route <> 'rare'")
def route_filter(f: Fixtures) -> DataFrame:
    return routes.route_filter(f.ledger, "rare").select("event_id", "route")


@query("route_to_table", "SELECT event_id, route, sink_table FROM log")
def route_to_table(f: Fixtures) -> DataFrame:
    return routes.map_routes(f.ledger).select("event_id", "route", "sink_table")


@query(
    "route_assign",
    """SELECT event_id, CASE WHEN event_id % 500 = 0 THEN 'rare' WHEN event_id % 2 = 0 THEN 'a'
    ELSE 'b' END AS route FROM ev""",
)
def route_assign(f: Fixtures) -> DataFrame:
    return f.events.select("event_id", routes.route_of(F.col("event_id")).alias("route"))


@query(
    "phase_tag",
    f"""SELECT event_id, CASE WHEN produced_at < {NOW_MS - 20 * DAY_MS} THEN 'before-outage'
    WHEN produced_at < {NOW_MS - 5 * DAY_MS} THEN 'during-outage' ELSE 'after-restart' END AS phase
    FROM ev""",
)
def phase_tag(f: Fixtures) -> DataFrame:
    return routes.tag_phase(f.events, NOW_MS - 20 * DAY_MS, NOW_MS - 5 * DAY_MS).select("event_id", "phase")


@query(
    "validity_rules",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'poison' WHEN length(payload) > 11
    THEN 'too-long' END AS reason FROM log""",
)
def validity_rules(f: Fixtures) -> DataFrame:
    checks = [*rules.every_nth_is_bad(10), rules.Rule("too-long", F.length("payload") > 11)]
    return rules.apply_rules(f.log, checks).select("event_id", "reason")


@query(
    "disposition",
    """SELECT topic, "partition", "offset", sink_table, disposition, reason FROM disposed""",
    DIRTY_SQL,
)
def disposition(f: Fixtures) -> DataFrame:
    judged = rules.dispose(wire.decode(dirty_log(f)), rules.every_nth_is_bad(10), drop_route="rare")
    return judged.select(*PLACE, "sink_table", "disposition", "reason")
