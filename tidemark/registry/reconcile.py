"""Ledger against sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixtures import now
from tidemark.operators import reconcile as R
from tidemark.functions.routes import map_routes
from tidemark.plans import scenarios
from tidemark.registry.base import DAY_MS, NOW_MS, Fixtures, query
from tidemark.schemas import POSITION, TABLES
from tidemark.streaming.places import work_dir

COUNTS = """CAST(sum(CASE WHEN expected_copies > 0 THEN 1 ELSE 0 END) AS BIGINT) AS expected,
  CAST(sum(CASE WHEN stored_copies > 0 THEN 1 ELSE 0 END) AS BIGINT) AS actual_distinct,
  CAST(sum(stored_copies) AS BIGINT) AS "rows",
  CAST(sum(CASE WHEN expected_copies > 0 AND stored_copies = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing_count,
  CAST(sum(CASE WHEN expected_copies = 0 AND stored_copies > 0 THEN 1 ELSE 0 END) AS BIGINT) AS extra_count,
  CAST(sum(CASE WHEN stored_copies > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_count"""


def compared(f: Fixtures) -> DataFrame:
    return R.compare_ids(R.expected_rows(f.ledger), f.sink)


@query(
    "missing_ids",
    "SELECT sink_table, event_id FROM compared WHERE expected_copies > 0 AND stored_copies = 0",
)
def missing_ids(f: Fixtures) -> DataFrame:
    return R.missing_ids(compared(f))


@query(
    "extra_ids",
    "SELECT sink_table, event_id FROM compared WHERE expected_copies = 0 AND stored_copies > 0",
)
def extra_ids(f: Fixtures) -> DataFrame:
    return R.extra_ids(compared(f))


@query(
    "duplicate_ids",
    "SELECT sink_table, event_id, stored_copies FROM compared WHERE stored_copies > 1",
)
def duplicate_ids(f: Fixtures) -> DataFrame:
    return R.duplicate_ids(compared(f))


@query("table_verdict", f"SELECT sink_table, {COUNTS} FROM compared GROUP BY sink_table")
def table_verdict(f: Fixtures) -> DataFrame:
    return R.table_verdict(compared(f), TABLES)


@query(
    "verdict_samples",
    """SELECT sink_table, kind, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS sample
    FROM (SELECT *, row_number() OVER (PARTITION BY sink_table, kind ORDER BY event_id) AS r FROM (
      SELECT sink_table, event_id, 'missing' AS kind FROM compared
        WHERE expected_copies > 0 AND stored_copies = 0
      UNION ALL SELECT sink_table, event_id, 'extra' FROM compared
        WHERE expected_copies = 0 AND stored_copies > 0
      UNION ALL SELECT sink_table, event_id, 'duplicate' FROM compared WHERE stored_copies > 1))
    WHERE r <= 20 GROUP BY ALL""",
)
def verdict_samples(f: Fixtures) -> DataFrame:
    found = R.samples(compared(f))
    return found.withColumn("sample", F.array_join("sample", ","))


@query(
    "outage_window",
    """SELECT count(*) AS produced, count(*) FILTER (WHERE held) AS saved,
    count(*) FILTER (WHERE NOT held) AS lost
    FROM (SELECT DISTINCT event_id, event_id IN (SELECT event_id FROM sink) AS held
          FROM ledger WHERE phase = 'during-outage')""",
)
def outage_window(f: Fixtures) -> DataFrame:
    return R.outage(f.ledger, f.sink, TABLES)


@query(
    "verdict",
    f"""SELECT missing, extra, duplicate, missing = 0 AND extra = 0 AND duplicate = 0 AS "pass"
    FROM (SELECT CAST(sum(missing_count) AS BIGINT) AS missing, CAST(sum(extra_count) AS BIGINT) AS extra,
      CAST(sum(duplicate_count) AS BIGINT) AS duplicate
      FROM (SELECT sink_table, {COUNTS} FROM compared GROUP BY sink_table))""",
)
def verdict(f: Fixtures) -> DataFrame:
    return R.verdict(R.table_verdict(compared(f), TABLES), "no-loss", unique_required=True)


# Stored rows of each scenario, from its definition: what the first run kept, then all from the
# offset where the second one started.
STORED_BY_SCENARIO = """marks AS (
    SELECT "partition" AS p, min("offset") AS first_, max("offset") FILTER (WHERE phase = 'before-outage') + 1 AS stop_,
      max("offset") FILTER (WHERE phase <> 'after-restart') + 1 AS again_,
      min("offset") FILTER (WHERE phase <> 'before-outage') AS since_,
      max("offset") FILTER (WHERE sink_table = 't_a' AND phase <> 'after-restart') + 1 AS max_a,
      least(max("offset") FILTER (WHERE sink_table = 't_a' AND phase <> 'after-restart'),
        max("offset") FILTER (WHERE sink_table = 't_rare' AND phase <> 'after-restart')) + 1 AS least_
    FROM log GROUP BY "partition"),
  plans AS (SELECT * FROM (VALUES
    ('S01', 'no-loss', false, 'early', 'first'), ('S02', 'no-loss', false, 'early', 'stop'),
    ('S03', 'loss', false, 'nothing', 'again'), ('S04', 'loss', false, 'nothing', 'stop'),
    ('S12', 'loss', false, 'starved', 'max_a'), ('S13', 'no-loss', false, 'starved', 'least'),
    ('S13P', 'no-loss', false, 'starved', 'first'), ('S15', 'no-loss', true, 'nothing', 'first'),
    ('S21', 'no-loss', true, 'early', 'since'), ('S22', 'loss', false, 'early', 'again'),
    ('S22E', 'no-loss', false, 'early', 'first'), ('S23', 'loss', false, 'sound', 'never'),
    ('S24', 'loss', false, 'sound', 'never'), ('S24R', 'no-loss', true, 'nothing', 'first'))
    v(scenario, expect, unique_required, kept, start)),
  held AS (
    SELECT scenario, event_id, sink_table FROM clean, plans
    WHERE kept = 'early' AND phase = 'before-outage'
      OR kept = 'starved' AND phase <> 'after-restart' AND sink_table <> 't_b'
      OR kept = 'sound' AND event_id % 10 <> 0
    UNION ALL
    SELECT scenario, event_id, sink_table FROM clean JOIN marks ON p = "partition", plans
    WHERE "offset" >= CASE start WHEN 'first' THEN first_ WHEN 'stop' THEN stop_ WHEN 'again' THEN again_
      WHEN 'since' THEN since_ WHEN 'max_a' THEN max_a WHEN 'least' THEN least_ END),
  stored AS (SELECT scenario, event_id, sink_table, count(*) AS copies FROM held GROUP BY ALL)"""


@query(
    "scenario_summary",
    """SELECT scenario, expect, produced, saved, produced - saved AS lost, missing, duplicate, extra,
      CASE WHEN expect = 'loss' THEN missing > 0
           ELSE missing = 0 AND extra = 0 AND (duplicate = 0 OR NOT unique_required) END AS "pass"
    FROM (SELECT scenario, expect, unique_required,
        (SELECT count(*) FROM log WHERE phase = 'during-outage') AS produced,
        (SELECT count(DISTINCT event_id) FROM stored s JOIN log USING (event_id)
          WHERE s.scenario = plans.scenario AND phase = 'during-outage') AS saved,
        (SELECT count(*) FROM clean) - (SELECT count(*) FROM stored s WHERE s.scenario = plans.scenario) AS missing,
        (SELECT count(*) FROM stored s WHERE s.scenario = plans.scenario AND copies > 1) AS duplicate,
        CAST(0 AS BIGINT) AS extra FROM plans)""",
    STORED_BY_SCENARIO,
)
def scenario_summary(f: Fixtures) -> DataFrame:
    """Every exact scenario: jobs stopped, started again and run to the log's end, their tables counted
    against the one ledger."""
    outage = scenarios.Outage(work_dir(f.spark, "scenarios"), f.log, f.skewed_log, now)
    scenarios.live_through(outage)
    return R.scenario_summary(f.ledger, scenarios.sinks(outage), scenarios.specs(f.spark))


@query(
    "ledger_phases",
    """SELECT phase, count(*) AS events, min(event_id) AS min_id, max(event_id) AS max_id
    FROM ledger GROUP BY phase""",
)
def ledger_phases(f: Fixtures) -> DataFrame:
    return R.ledger_phases(f.ledger)


@query("route_split", "SELECT route, count(*) AS events FROM ledger GROUP BY route")
def route_split(f: Fixtures) -> DataFrame:
    return R.route_split(f.ledger)


@query(
    "dup_ratio",
    f"""SELECT count(*) AS "rows", count(DISTINCT event_id) AS distinct_ids,
    count(*) - count(DISTINCT event_id) AS surplus
    FROM sink WHERE produced_at >= {NOW_MS - 20 * DAY_MS}""",
)
def dup_ratio(f: Fixtures) -> DataFrame:
    return R.distinct_since(f.sink, "produced_at", NOW_MS - 20 * DAY_MS)


@query(
    "dup_ratio_sketched",
    f"""SELECT sink_table, count(*) AS "rows", true AS close
    FROM sink WHERE produced_at + 1000 >= {NOW_MS - 20 * DAY_MS} GROUP BY sink_table""",
)
def dup_ratio_sketched(f: Fixtures) -> DataFrame:
    """Rows since an hour from sketches by hour, of two parts; their distinct ids lie within 4 % of the true number."""
    half = F.col("event_id") % 2 == 0
    sketches = R.distinct_sketches(f.sink.where(half)).unionByName(R.distinct_sketches(f.sink.where(~half)))
    since = F.timestamp_millis(F.lit(NOW_MS - 20 * DAY_MS))
    true = f.sink.where(F.col("inserted_at") >= since).groupBy("sink_table").agg(F.count_distinct("event_id").alias("_true"))
    found = R.dup_ratio_sketched(sketches, since).join(true, "sink_table")
    return found.select("sink_table", "rows", (F.abs(F.col("distinct_ids") / F.col("_true") - 1) < 0.04).alias("close"))


@query(
    "content_diff",
    """SELECT sink_table, event_id, CASE WHEN event_id % 61 = 0 AND event_id % 67 = 0
      THEN 'produced_at,payload' WHEN event_id % 61 = 0 THEN 'produced_at' ELSE 'payload' END AS diff_columns
    FROM clean WHERE event_id % 61 = 0 OR event_id % 67 = 0""",
)
def content_diff(f: Fixtures) -> DataFrame:
    """The sink altered a clock in every 61st row and lost the payload of every 67th."""
    eid = F.col("event_id")
    altered = f.clean_sink.withColumns(
        {
            "produced_at": F.when(eid % 61 == 0, F.col("produced_at") + 1).otherwise(F.col("produced_at")),
            "payload": F.when(eid % 67 != 0, F.col("payload")),
        }
    )
    found = R.content_diff(
        f.clean_sink, altered, ["sink_table", "event_id"], ["produced_at", "route", "payload"]
    )
    return found.withColumn("diff_columns", F.array_join("diff_columns", ","))


@query(
    "multiplicity",
    """SELECT sink_table, event_id, expected_copies, stored_copies,
    stored_copies - expected_copies AS surplus FROM compared WHERE stored_copies <> expected_copies""",
)
def multiplicity(f: Fixtures) -> DataFrame:
    return R.multiplicity(compared(f))


@query(
    "branch_divergence",
    """SELECT topic, "partition", sink_table, last_offset, delivered, missing,
      max(last_offset) OVER (PARTITION BY topic, "partition") - coalesce(last_offset, -1) AS behind_leader
    FROM (SELECT l.topic, l."partition", l.sink_table, max(CASE WHEN h.event_id IS NOT NULL THEN l."offset" END) AS last_offset,
      count(h.event_id) AS delivered, count(*) - count(h.event_id) AS missing
      FROM clean l LEFT JOIN half h USING (event_id) GROUP BY ALL)""",
)
def branch_divergence(f: Fixtures) -> DataFrame:
    return R.branch_divergence(map_routes(f.log), f.half_starved_sink)


@query(
    "dup_cause",
    """SELECT sink_table, event_id, count(*) AS copies, count(DISTINCT ("partition", "offset")) AS sources,
      CASE WHEN count(DISTINCT ("partition", "offset")) = 1 THEN 'replay'
           WHEN count(DISTINCT ("partition", "offset")) = count(*) THEN 'producer' ELSE 'both' END AS cause
    FROM (SELECT sink_table, event_id, "partition", "offset" FROM sink
          UNION ALL SELECT sink_table, event_id, 0, 1000000000 + event_id FROM clean WHERE event_id % 59 = 0)
    GROUP BY sink_table, event_id HAVING count(*) > 1""",
)
def dup_cause(f: Fixtures) -> DataFrame:
    """The producer also sent every 59th event a second time."""
    again = f.clean_sink.where("event_id % 59 = 0").withColumns(
        {"src_part": F.lit(0), "src_offset": F.lit(1_000_000_000) + F.col("event_id")}
    )
    return R.dup_cause(f.sink.unionByName(again))


@query(
    "hop_reconcile",
    """SELECT hop, stage, reached, lost, unexpected, repeats FROM (
      SELECT 0 AS hop, 'ledger' AS stage, count(*) FILTER (WHERE s0 > 0) AS reached, CAST(0 AS BIGINT) AS lost,
        CAST(0 AS BIGINT) AS unexpected, CAST(coalesce(sum(greatest(s0 - 1, 0)), 0) AS BIGINT) AS repeats FROM hops
      UNION ALL SELECT 1, 'topic1', count(*) FILTER (WHERE s1 > 0), count(*) FILTER (WHERE s0 > 0 AND s1 = 0),
        count(*) FILTER (WHERE s1 > 0 AND s0 = 0), CAST(sum(greatest(s1 - 1, 0)) AS BIGINT) FROM hops
      UNION ALL SELECT 2, 'topic2', count(*) FILTER (WHERE s2 > 0), count(*) FILTER (WHERE s1 > 0 AND s2 = 0),
        count(*) FILTER (WHERE s2 > 0 AND s1 = 0), CAST(sum(greatest(s2 - 1, 0)) AS BIGINT) FROM hops
      UNION ALL SELECT 3, 'sink', count(*) FILTER (WHERE s3 > 0), count(*) FILTER (WHERE s2 > 0 AND s3 = 0),
        count(*) FILTER (WHERE s3 > 0 AND s2 = 0), CAST(sum(greatest(s3 - 1, 0)) AS BIGINT) FROM hops)""",
    """hops AS (SELECT event_id, count(*) AS s0, sum(CASE WHEN event_id % 37 <> 0 THEN 1 ELSE 0 END) AS s1,
      sum(CASE WHEN event_id % 37 = 0 OR event_id % 43 = 0 THEN 0 WHEN phase = 'before-outage' THEN 2
        ELSE 1 END) AS s2,
      sum(CASE WHEN sink_table IS NULL OR event_id % 37 = 0 THEN 0 ELSE 1 END) AS s3
      FROM log GROUP BY event_id)""",
)
def hop_reconcile(f: Fixtures) -> DataFrame:
    """Topic 1 lost every 37th event; the hop lost every 43rd and sent the time before the
    outage twice; the sink absorbed the repeats, and got the hop's losses from elsewhere."""
    topic1 = f.ledger.where("event_id % 37 != 0")
    routed = topic1.where("event_id % 43 != 0")
    topic2 = routed.unionByName(routed.where("phase = 'before-outage'"))
    stages = [
        ("ledger", f.ledger),
        ("topic1", topic1),
        ("topic2", topic2),
        ("sink", f.clean_sink.where("event_id % 37 != 0")),
    ]
    return R.hop_summary(R.hop_reconcile(stages), [name for name, _ in stages])


@query(
    "hop_last_stage",
    """SELECT CASE WHEN sink_table IS NOT NULL AND event_id % 43 <> 0 THEN 'sink'
      WHEN event_id % 43 <> 0 THEN 'topic2' ELSE 'ledger' END AS last_stage, count(*) AS events
    FROM log GROUP BY ALL""",
)
def hop_last_stage(f: Fixtures) -> DataFrame:
    kept = "event_id % 43 != 0"
    per_id = R.hop_reconcile(
        [("ledger", f.ledger), ("topic2", f.ledger.where(kept)), ("sink", f.clean_sink.where(kept))]
    )
    return per_id.groupBy("last_stage").agg(F.count("*").alias("events"))


@query(
    "reject_balance",
    """SELECT topic, "partition", count(*) AS produced,
      count(*) FILTER (WHERE saved) AS saved, count(*) FILTER (WHERE rejected) AS rejected,
      count(*) FILTER (WHERE sink_table IS NULL) AS unrouted,
      count(*) FILTER (WHERE NOT saved AND NOT rejected AND sink_table IS NOT NULL) AS outstanding,
      count(*) FILTER (WHERE saved AND rejected) AS conflicts, CAST(0 AS BIGINT) AS stray,
      count(*) FILTER (WHERE saved AND rejected) = 0 AS balanced
    FROM (SELECT *, sink_table IS NOT NULL AND event_id % 41 <> 0
        AND (phase <> 'during-outage' OR event_id % 10 <> 0 OR event_id % 3 = 0) AS saved,
        sink_table IS NOT NULL AND phase = 'during-outage' AND event_id % 10 = 0 AS rejected FROM log)
    GROUP BY topic, "partition" """,
)
def reject_balance(f: Fixtures) -> DataFrame:
    """Rejects of partition 0 were stored all the same: its books must not balance."""
    sink = f.sound(f.clean_sink).unionByName(f.poisoned(f.clean_sink).where("src_part = 0"))
    return R.balance(
        f.log,
        [
            ("saved", R.positions_of(sink.where("event_id % 41 != 0"))),
            ("rejected", f.rejects),
            ("unrouted", f.log.where("route = 'x'")),
        ],
    )


@query(
    "reject_conflicts",
    """SELECT topic, "partition", "offset" FROM rejects WHERE event_id % 30 = 0""",
)
def reject_conflicts(f: Fixtures) -> DataFrame:
    stored = f.sound(f.clean_sink).unionByName(f.poisoned(f.clean_sink).where("event_id % 30 = 0"))
    return R.conflicts(R.positions_of(stored), f.rejects).select(*POSITION)


def _sample_sql(kind: str, holds: str) -> str:
    return f"""coalesce((SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FROM (
        SELECT event_id FROM compared c WHERE c.sink_table = t.sink_table AND {holds} ORDER BY event_id LIMIT 20)), '')
      AS {kind}_sample"""


@query(
    "verdict_report",
    f"""SELECT 'nightly' AS scenario, t.*, o.produced AS outage_produced, o.saved AS outage_saved, o.lost AS outage_lost,
      {_sample_sql("missing", "expected_copies > 0 AND stored_copies = 0")},
      {_sample_sql("extra", "expected_copies = 0 AND stored_copies > 0")},
      {_sample_sql("duplicate", "stored_copies > 1")},
      sum(missing_count) OVER () = 0 AND sum(extra_count) OVER () = 0 AS "pass"
    FROM (SELECT sink_table, {COUNTS} FROM compared GROUP BY sink_table) t,
      (SELECT count(*) AS produced, count(*) FILTER (WHERE held) AS saved, count(*) FILTER (WHERE NOT held) AS lost
       FROM (SELECT DISTINCT event_id, event_id IN (SELECT event_id FROM sink) AS held
             FROM ledger WHERE phase = 'during-outage')) o""",
)
def verdict_report(f: Fixtures) -> DataFrame:
    """The whole report, its samples as text."""
    report = R.verdict_report(f.ledger, f.sink, "nightly")
    sample = lambda kind: F.array_join(f"{kind}_sample", ",").alias(f"{kind}_sample")
    return report.select(
        "scenario", "sink_table", "expected", "actual_distinct", "rows", "missing_count", "extra_count", "duplicate_count",
        *[F.col(f"outage.{c}").alias(f"outage_{c}") for c in ("produced", "saved", "lost")],
        *[sample(kind) for kind in ("missing", "extra", "duplicate")], "pass",
    )
