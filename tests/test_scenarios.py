"""The scenario corpus on its own 1,800 events. Exact where the outcome is a rule, and the
sign only where it depended on timing."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, wire
from tidemark.functions.routes import map_routes
from tidemark.operators import reconcile as R
from tidemark.operators.frontier import branch_frontier
from tidemark.operators.health import lag
from tidemark.plans import resume as P
from tidemark.plans import scenarios as S
from tidemark.schemas import AFTER, BEFORE, DURING, TABLES
from tidemark.sources.logs import log_bounds
from tidemark.sources.vectors import at_or_after
from tidemark.streaming import sinks as K
from tests.golden import DAY_MS, SIZES, START_MS, as_sink, golden_log
from tests.shapes import as_dict

# Produced, saved and lost of the outage; missing and duplicate over all phases;
# whether the prediction held.
OUTCOMES = {
    "S01": (900, 900, 0, 0, 600, True),
    "S02": (900, 900, 0, 0, 0, True),
    "S03": (900, 0, 900, 1500, 0, True),
    "S04": (900, 900, 0, 600, 0, True),
    "S15": (900, 900, 0, 0, 0, True),
    "S21": (900, 900, 0, 0, 0, True),
    "S22": (900, 0, 900, 900, 0, True),
    "S22E": (900, 900, 0, 0, 600, True),
    "S23": (900, 810, 90, 180, 0, True),
    "S24": (900, 810, 90, 180, 0, True),
    "S24R": (900, 900, 0, 0, 0, True),
}


@pytest.fixture(scope="module")
def log(spark):
    return golden_log(spark).cache()


def audit(log, stored):
    """(saved, lost, missing, duplicate, extra) of a sink against the whole ledger."""
    per_table = R.table_verdict(R.compare_ids(R.expected_rows(log), stored), TABLES)
    total, window = R.verdict(per_table).first(), R.outage(log, stored, TABLES).first()
    return window.saved, window.lost, total.missing, total.duplicate, total.extra


def upto(log, phase):
    return log if phase == AFTER else log.where(F.col("phase").isin(BEFORE, DURING) if phase == DURING else F.col("phase") == BEFORE)


def starts(plan):
    return [v for _, v in sorted(as_dict(plan, "partition", "start").items())]


def test_the_log_has_the_recorded_shape(log):
    for phase, sizes in SIZES.items():
        ends = as_dict(log_bounds(upto(log, phase)), "partition", "end")
        assert [ends[i] for i in range(3)] == sizes
    assert as_dict(R.route_split(log), "route", "events") == {"a": 897, "b": 900, "rare": 3}
    row = log.where("event_id = 500").first()
    assert (row.partition, row.offset) == (0, 194)
    phases = [(r.events, r.min_id, r.max_id) for r in R.ledger_phases(log).collect()]
    assert phases == [(600, 1, 600), (900, 601, 1500), (300, 1501, 1800)]


def test_scenarios_that_are_run_have_the_recorded_outcomes(spark, log, tmp_path):
    skewed = wire.encode(golden_log(spark, skew_outage=True))
    outage = S.Outage(str(tmp_path), wire.encode(log), skewed)
    S.live_through(outage)
    summary = R.scenario_summary(log, S.sinks(outage), S.specs(spark))
    cols = ["produced", "saved", "lost", "missing", "duplicate", "pass"]
    found = as_dict(summary, "scenario", cols)
    assert {name: found[name] for name in OUTCOMES} == OUTCOMES
    # The greatest offset of one table, or of the branches present, skips the starved table's
    # rows; the completed prefix of all expected branches does not.
    assert (found["S12"][3] > 0, found["S12"][5]) == (True, True)
    assert (found["S13"][3] > 0, found["S13"][5]) == (True, False)
    assert (found["S13P"][3], found["S13P"][5]) == (0, True)


def restart(log, plan, first_run=None):
    """What a sink holds that stored the time before the outage, then resumed by a plan."""
    later = at_or_after(log, P.start_vector(plan))
    return as_sink(upto(log, BEFORE) if first_run is None else first_run).unionByName(as_sink(later))


def test_earliest_doubles_the_time_before(log):
    stored = restart(log, P.resume_plan(log_bounds(upto(log, DURING)), "earliest"))
    assert audit(log, stored) == (900, 0, 0, 600, 0)
    fresh = K.absent_rows(stored, stored.limit(0), ["sink_table", "event_id"])
    assert audit(log, fresh) == (900, 0, 0, 0, 0)


def test_commits_resume_exactly(log):
    commits = log_bounds(upto(log, BEFORE)).withColumnRenamed("end", "current_offset")
    plan = P.resume_plan(log_bounds(upto(log, DURING)), "committed-earliest", group_commits=commits)
    assert starts(plan) == SIZES[BEFORE]
    assert audit(log, restart(log, plan)) == (900, 0, 0, 0, 0)


def test_latest_skips_backlogs(log):
    nothing = as_sink(log).limit(0)
    plan = P.resume_plan(log_bounds(upto(log, DURING)), "latest")
    assert audit(log, nothing.unionByName(as_sink(at_or_after(log, P.start_vector(plan))))) == (0, 900, 1500, 0, 0)
    # Without commits the first start of the other variant skips only what was there then.
    none = log_bounds(log).withColumn("current_offset", F.lit(1)).where("false")
    plan = P.resume_plan(log_bounds(upto(log, BEFORE)), "committed-latest", group_commits=none)
    assert audit(log, as_sink(at_or_after(log, P.start_vector(plan)))) == (900, 0, 600, 0, 0)


def test_expired_commits_fall_back_to_the_beginning(log):
    none = log_bounds(log).withColumn("current_offset", F.lit(1)).where("false")
    plan = P.resume_plan(log_bounds(upto(log, DURING)), "committed-earliest", group_commits=none)
    assert audit(log, restart(log, plan)) == (900, 0, 0, 600, 0)


def test_time_restart_on_the_broker_clock(log):
    at = START_MS + 601 * 17
    plan = P.resume_plan(log_bounds(upto(log, DURING)), f"timestamp:{at}", log=upto(log, DURING))
    assert starts(plan) == SIZES[BEFORE]
    assert audit(log, restart(log, plan)) == (900, 0, 0, 0, 0)
    early = P.resume_plan(log_bounds(upto(log, DURING)), f"timestamp:{at}", log=upto(log, DURING), lead_ms=1700)
    assert audit(log, restart(log, early)) == (900, 0, 0, 100, 0)


def test_time_restart_on_skewed_clocks(spark):
    log = golden_log(spark, skew_outage=True).cache()
    seen = upto(log, DURING)
    bounds, spec = log_bounds(seen), f"timestamp:{START_MS + 601 * 17}"
    silent = P.resume_plan(bounds, spec, log=seen, on_no_match="end")
    assert starts(silent) == SIZES[DURING]
    assert audit(log, restart(log, silent)) == (0, 900, 900, 0, 0)
    assert set(as_dict(P.validate_plan(silent, bounds), "partition", "flag").values()) == {"skip-to-head"}
    safe = P.resume_plan(bounds, spec, log=seen, on_no_match="earliest")
    assert audit(log, restart(log, safe)) == (900, 0, 0, 600, 0)
    with pytest.raises(P.ResumeError):
        P.start_vector(P.resume_plan(bounds, spec, log=seen))
    lead = P.resume_plan(bounds, spec, log=seen, lead_ms=2 * DAY_MS)
    assert audit(log, restart(log, lead))[:3] == (900, 0, 0)


def test_starved_branch_under_three_resolvers(log):
    """No b row was stored before the restart."""
    seen = upto(log, DURING)
    held = as_sink(seen).where("sink_table != 't_b'")
    bounds = log_bounds(seen)
    own = map_routes(seen)
    prefixes = branch_frontier(own, held.withColumnsRenamed(
        {"src_topic": "topic", "src_part": "partition", "src_offset": "offset"}))
    wrote = held.select(F.col("src_topic").alias("topic"), F.col("src_part").alias("partition"), "sink_table").distinct()
    maxima = (
        held.where("phase = 'before-outage'")
        .groupBy(F.lit("j").alias("job"), F.col("src_topic").alias("topic"), F.col("src_part").alias("partition"), "sink_table")
        .agg(F.max("src_offset").alias("max_offset"))
    )
    by_max = P.resume_plan(bounds, "store-max:t_a", sink=held)
    by_least = P.resume_plan(bounds, "store-frontier", progress=maxima, job="j")
    by_prefix = P.resume_plan(
        bounds, "store-prefix", branches=TABLES,
        progress=prefixes.join(wrote, ["topic", "partition", "sink_table"], "left_semi"),
    )
    assert audit(log, restart(log, by_max, seen.where("route != 'b'")))[2] > 0
    # The rare branch's event 500 (partition 0, offset 194) holds that partition back.
    assert starts(by_least)[0] == 195
    assert audit(log, restart(log, by_least, seen.where("route != 'b'")))[2] > 0
    assert starts(by_prefix) == [0, 0, 0]
    assert audit(log, restart(log, by_prefix, seen.where("route != 'b'")))[2] == 0


def test_swallowed_rows_show_although_there_is_no_lag(log):
    stored = as_sink(log).where("event_id <= 24")
    commits = log_bounds(log).withColumnRenamed("end", "current_offset")
    assert set(as_dict(lag(log_bounds(log), commits), "partition", "lag").values()) == {0}
    assert audit(log, stored) == (0, 900, 1776, 0, 0)


def test_poison_rows_are_rejected_not_lost(log):
    judged = rules.dispose(
        wire.decode(wire.encode(log).select("topic", "partition", "offset", "value")), rules.every_nth_is_bad(10)
    )
    saved = K.delivered_rows(judged)
    rejected = K.split_rejects(judged, "j", F.timestamp_millis(F.lit(0)))
    assert (saved.count(), rejected.count()) == (1620, 180)
    assert audit(log, saved) == (810, 90, 180, 0, 0)
    # A replay feeds the same rows to the same rule; a repair under a corrected rule ends it.
    assert K.absent_rows(saved, saved, ["sink_table", "event_id"]).count() == 0
    repaired = K.delivered_rows(K.repair_rejects(rejected, rules=[]))
    assert audit(log, saved.unionByName(repaired)) == (900, 0, 0, 0, 0)


def test_hop_repeats_hidden_by_the_sink(log):
    """The hop sent the time before the outage again: 2,400 records for 1,800 events."""
    hop = log.unionByName(upto(log, BEFORE))
    assert hop.count() == 2400
    stages = [("ledger", log), ("topic2", hop), ("sink", as_sink(log))]
    per_stage = R.hop_summary(R.hop_reconcile(stages), [n for n, _ in stages])
    assert as_dict(per_stage, "stage", ["lost", "repeats"]) == {
        "ledger": (0, 0), "topic2": (0, 600), "sink": (0, 0),
    }
