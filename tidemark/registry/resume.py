"""Start positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixtures import JOB
from tidemark.operators.reconcile import positions_of
from tidemark.plans import resume as P
from tidemark.registry.base import Fixtures, query
from tidemark.registry.prefixes import outage_start
from tidemark.schemas import POSITION, TABLES
from tidemark.sources.logs import pinned_bounds
from tidemark.sources.vectors import pin_small

ROW = ["topic", "partition", "start", "rule", "skips_backlog"]


def labelled(plans: dict[str, DataFrame]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [plan.select(F.lit(name).alias("plan"), *ROW) for name, plan in plans.items()],
    )


@query(
    "resume_plan_basic",
    """SELECT 'earliest' AS plan, topic, "partition", "begin" AS start, 'begin' AS rule,
      false AS skips_backlog FROM bounds
    UNION ALL SELECT 'latest', topic, "partition", "end", 'end', true FROM bounds""",
)
def resume_plan_basic(f: Fixtures) -> DataFrame:
    bounds = pinned_bounds(f.log)
    return labelled({spec: P.resume_plan(bounds, spec) for spec in ("earliest", "latest")})


@query(
    "resume_committed",
    """SELECT 'committed-earliest' AS plan, topic, "partition", coalesce(h, "begin") AS start,
      CASE WHEN h IS NOT NULL THEN 'commit' WHEN c IS NULL THEN 'no-commit:begin'
        ELSE 'expired-commit:begin' END AS rule, false AS skips_backlog,
      CASE WHEN c < "begin" THEN 'expired' ELSE 'ok' END AS flag FROM held
    UNION ALL SELECT 'committed-latest', topic, "partition", coalesce(h, "end"),
      CASE WHEN h IS NOT NULL THEN 'commit' WHEN c IS NULL THEN 'no-commit:end'
        ELSE 'expired-commit:end' END, h IS NULL,
      CASE WHEN c < "begin" THEN 'expired' WHEN c IS NULL THEN 'skip-to-head' ELSE 'ok' END FROM held
    UNION ALL SELECT 'committed-none', topic, "partition", h,
      CASE WHEN h IS NOT NULL THEN 'commit' WHEN c IS NULL THEN 'error' ELSE 'expired-commit:error' END, false,
      CASE WHEN c < "begin" THEN 'expired' WHEN c IS NULL THEN 'no-start' ELSE 'ok' END FROM held""",
    """held AS (SELECT b.*, g.c, CASE WHEN g.c >= b."begin" THEN g.c END AS h
      FROM (SELECT topic, "partition", min("offset") AS "begin", max("offset") + 1 AS "end"
        FROM log WHERE event_id >= 30 GROUP BY ALL) b LEFT JOIN
      (SELECT topic, "partition", CASE WHEN "partition" = 1 THEN 4 ELSE current_offset END AS c
        FROM group_commits WHERE "partition" <> 2) g USING (topic, "partition"))""",
)
def resume_committed(f: Fixtures) -> DataFrame:
    """The log lost its first thirty records; the group's commit of partition 1 went with them,
    and it never committed partition 2."""
    bounds = pinned_bounds(f.log.where("event_id >= 30"))
    offset = F.when(F.col("partition") == 1, 4).otherwise(F.col("current_offset")).cast("bigint")
    commits = f.group_commits.where("partition != 2").withColumn("current_offset", offset)
    specs = ("committed-earliest", "committed-latest", "committed-none")
    plans = {s: P.resume_plan(bounds, s, group_commits=commits) for s in specs}
    flags = reduce(
        DataFrame.unionByName,
        [P.validate_plan(p, bounds).select(F.lit(s).alias("plan"), *ROW[:2], "flag") for s, p in plans.items()],
    )
    return labelled(plans).join(flags, ["plan", *ROW[:2]])


@query(
    "resume_timestamp",
    """SELECT plan, topic, "partition", coalesce(hit, CASE plan WHEN 'earliest' THEN "begin"
        WHEN 'end' THEN "end" END) AS start,
      CASE WHEN hit IS NOT NULL THEN 'timestamp' WHEN plan = 'error' THEN 'error'
        WHEN plan = 'earliest' THEN 'no-match:begin' ELSE 'no-match:end' END AS rule,
      hit IS NULL AND plan = 'end' AS skips_backlog
    FROM looked_up, (VALUES ('error'), ('earliest'), ('end')) v(plan)
    UNION ALL SELECT 'lead', b.topic, b."partition", min(s."offset"), 'timestamp', false
    FROM kept s, bounds_kept b, target WHERE s."partition" = b."partition"
      AND s.record_ts >= target.at_ms - 259200000 GROUP BY b.topic, b."partition" """,
    """kept AS (SELECT * FROM skewed WHERE phase <> 'after-restart'),
    bounds_kept AS (SELECT topic, "partition", min("offset") AS "begin", max("offset") + 1 AS "end"
      FROM kept GROUP BY ALL),
    target AS (SELECT max(record_ts) + 1 AS at_ms FROM kept),
    looked_up AS (SELECT b.*, hit FROM bounds_kept b, (SELECT "partition" AS p,
      min("offset") FILTER (WHERE record_ts >= at_ms) AS hit FROM kept, target GROUP BY "partition")
      WHERE p = b."partition")""",
)
def resume_timestamp(f: Fixtures) -> DataFrame:
    """At the restart the outage's clocks run a day late, so no record is as new as the
    target, unless it is aimed three days early."""
    log = f.skewed_log.where("phase != 'after-restart'")
    at = log.agg(F.max("record_ts")).first()[0] + 1
    bounds = pinned_bounds(log)
    spec = f"timestamp:{at}"
    plans = {p: P.resume_plan(bounds, spec, log=log, on_no_match=p) for p in P.NO_MATCH}
    plans["lead"] = P.resume_plan(bounds, spec, log=log, lead_ms=3 * 86_400_000)
    return labelled(plans)


@query(
    "resume_store",
    """SELECT topic, "partition", coalesce(n, "begin") AS start,
      CASE WHEN n IS NULL THEN 'no-row:begin' ELSE 'stored' END AS rule, false AS skips_backlog
    FROM bounds LEFT JOIN (SELECT topic, "partition", max(t) + 1 AS n FROM whole_ranges
      WHERE "partition" <> 1 GROUP BY ALL) USING (topic, "partition")""",
)
def resume_store(f: Fixtures) -> DataFrame:
    """Stored progress without a row for partition 1."""
    rows = f.progress_rows.where("partition != 1")
    stored = rows.groupBy("topic", "partition").agg(F.max("next_offset").alias("next_offset"))
    return P.from_stored(pinned_bounds(f.log), stored, "stored").select(*ROW)


@query(
    "resume_max",
    """SELECT topic, "partition", coalesce(n, "begin") AS start,
      CASE WHEN n IS NULL THEN 'no-row:begin' ELSE 'store-max' END AS rule, false AS skips_backlog
    FROM bounds LEFT JOIN (SELECT topic, "partition", max("offset") + 1 AS n FROM half
      WHERE sink_table = 't_a' GROUP BY ALL) USING (topic, "partition")""",
)
def resume_max(f: Fixtures) -> DataFrame:
    return P.resume_plan(pinned_bounds(f.log), "store-max:t_a", sink=f.half_starved_sink).select(*ROW)


@query(
    "resume_min_progress",
    """SELECT topic, "partition", coalesce(n, "begin") AS start,
      CASE WHEN n IS NULL THEN 'no-row:begin' ELSE 'store-frontier' END AS rule, false AS skips_backlog
    FROM bounds LEFT JOIN (SELECT topic, "partition", min(m) + 1 AS n FROM
      (SELECT topic, "partition", sink_table, max("offset") AS m FROM half GROUP BY ALL)
      GROUP BY topic, "partition") USING (topic, "partition")""",
)
def resume_min_progress(f: Fixtures) -> DataFrame:
    plan = P.resume_plan(pinned_bounds(f.log), "store-frontier", progress=f.branch_maxima, job=JOB)
    return plan.select(*ROW)


PREFIX_SQL = """branches AS (SELECT unnest(['t_a', 't_b', 't_rare']) AS sink_table),
  reached AS (
    SELECT l.topic, l."partition", l.sink_table,
      coalesce(min(CASE WHEN h.event_id IS NULL THEN l."offset" END), any_value(b."end")) AS next_offset
    FROM clean l LEFT JOIN half h USING (event_id) JOIN bounds b ON b."partition" = l."partition"
    GROUP BY l.topic, l."partition", l.sink_table HAVING count(h.event_id) > 0),
  prefix AS (
    SELECT b.topic, b."partition", min(coalesce(r.next_offset, b."begin")) AS start,
      CASE WHEN count(*) > count(r.next_offset) THEN 'absent-branch:begin' ELSE 'store-prefix' END AS rule
    FROM bounds b CROSS JOIN branches LEFT JOIN reached r
      ON r."partition" = b."partition" AND r.sink_table = branches.sink_table
    GROUP BY b.topic, b."partition")"""


@query("resume_prefix", "SELECT *, false AS skips_backlog FROM prefix", PREFIX_SQL)
def resume_prefix(f: Fixtures) -> DataFrame:
    plan = P.resume_plan(pinned_bounds(f.log), "store-prefix", progress=f.branch_prefixes, branches=TABLES)
    return plan.select(*ROW)


@query(
    "resume_validate",
    """SELECT coalesce(topic, 'events') AS topic, "partition", start, "begin", "end",
      CASE WHEN "begin" IS NULL THEN 'unknown-partition' WHEN start IS NULL THEN 'no-start'
        WHEN start < "begin" THEN 'expired' WHEN start > "end" THEN 'past-end'
        WHEN start = "end" AND "end" > "begin" THEN 'skip-to-head' ELSE 'ok' END AS flag
    FROM given FULL JOIN retained USING (topic, "partition")""",
    """retained AS (SELECT topic, "partition", min("offset") AS "begin", max("offset") + 1 AS "end"
      FROM log WHERE phase <> 'before-outage' GROUP BY ALL),
    given AS (SELECT 'events' AS topic, 0 AS "partition", CAST(0 AS BIGINT) AS start
      UNION ALL SELECT 'events', 1, "end" FROM retained WHERE "partition" = 1
      UNION ALL SELECT 'events', 7, 5)""",
)
def resume_validate(f: Fixtures) -> DataFrame:
    """Records from before the outage have expired; partition 1 would skip to the head, 2 is
    left out, and 7 does not exist."""
    bounds = pinned_bounds(f.log.where("phase != 'before-outage'"))
    head = bounds.where("partition = 1").select("end").first()[0]
    vector = {("events", 0): 0, ("events", 1): head, ("events", 7): 5}
    return P.validate_plan(P.resume_plan(bounds, vector), bounds)


@query(
    "resume_compare",
    """SELECT topic, "partition", plan, start, rule,
      CASE WHEN start IS NOT NULL THEN count("offset") FILTER (WHERE done AND "offset" >= start) END AS rows_reread,
      CASE WHEN start IS NOT NULL THEN count("offset") FILTER (WHERE NOT done AND "offset" >= start) END AS rows_recovered,
      CASE WHEN start IS NOT NULL THEN count("offset") FILTER (WHERE NOT done AND "offset" < start) END AS rows_lost
    FROM plans LEFT JOIN positions USING (topic, "partition") GROUP BY topic, "partition", plan, start, rule""",
    PREFIX_SQL
    + """, positions AS (SELECT topic, "partition", "offset",
      sink_table IS NULL OR event_id IN (SELECT event_id FROM half) AS done FROM log),
    silent AS (SELECT 'events' AS topic, 9 AS "partition", CAST(0 AS BIGINT) AS zero),
    plans AS (
      SELECT topic, "partition", 'earliest' AS plan, "begin" AS start, 'begin' AS rule FROM bounds
      UNION ALL SELECT topic, "partition", 'latest', "end", 'end' FROM bounds
      UNION ALL SELECT topic, "partition", 'committed-earliest', current_offset, 'commit' FROM group_commits
      UNION ALL SELECT topic, "partition", 'committed-none', NULL, 'error' FROM bounds
      UNION ALL SELECT topic, "partition", 'timestamp', min("offset"), 'timestamp' FROM log
        WHERE phase <> 'before-outage' GROUP BY topic, "partition"
      UNION ALL SELECT topic, "partition", 'store-max:t_a', max("offset") + 1, 'store-max' FROM half
        WHERE sink_table = 't_a' GROUP BY topic, "partition"
      UNION ALL SELECT topic, "partition", 'store-frontier', min(m) + 1, 'store-frontier'
        FROM (SELECT topic, "partition", sink_table, max("offset") AS m FROM half GROUP BY ALL)
        GROUP BY topic, "partition"
      UNION ALL SELECT topic, "partition", 'store-prefix', start, rule FROM prefix
      UNION ALL SELECT topic, "partition", plan, CASE WHEN plan <> 'committed-none' THEN zero END, rule
        FROM silent, (VALUES ('earliest', 'begin'), ('latest', 'end'), ('committed-earliest', 'no-commit:begin'),
          ('committed-none', 'error'), ('timestamp', 'empty'), ('store-max:t_a', 'no-row:begin'),
          ('store-frontier', 'no-row:begin'), ('store-prefix', 'absent-branch:begin')) v(plan, rule))""",
)
def resume_compare(f: Fixtures) -> DataFrame:
    """Every resolver against the sink with the starved branch; partition 9 holds no records,
    and ``committed-none`` has no commits to start from."""
    return P.compare_plans(every_plan(f), f.log, done_positions(f))


def every_plan(f: Fixtures) -> dict[str, DataFrame]:
    silent = f.spark.sql("SELECT 'events' AS topic, 9 AS partition, 0L AS begin, 0L AS end")
    bounds = pin_small(pinned_bounds(f.log).union(silent))
    given = {
        "earliest": {},
        "latest": {},
        "committed-earliest": {"group_commits": f.group_commits},
        "committed-none": {"group_commits": f.group_commits.where("false")},
        f"timestamp:{outage_start(f)}": {"log": f.log},
        "store-max:t_a": {"sink": f.half_starved_sink},
        "store-frontier": {"progress": f.branch_maxima, "job": JOB},
        "store-prefix": {"progress": f.branch_prefixes, "branches": TABLES},
    }
    return {
        "timestamp" if spec.startswith("timestamp") else spec: P.resume_plan(bounds, spec, **inputs)
        for spec, inputs in given.items()
    }


def done_positions(f: Fixtures) -> DataFrame:
    """Stored and unrouted positions of the half-starved sink."""
    stored = positions_of(f.half_starved_sink).select(*POSITION)
    return stored.unionByName(f.log.where("route = 'x'").select(*POSITION))


