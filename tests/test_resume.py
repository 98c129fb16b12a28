import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.frontier import branch_frontier, frontier
from tidemark.plans import resume as P
from tidemark.sources import logs, vectors
from tests.shapes import as_dict, bounds_frame, log_frame, positions

BRANCHES = ["t_a", "t_b"]


def commits(spark, rows):
    return spark.createDataFrame(
        [("t", *r) for r in rows], "topic string, partition int, current_offset bigint"
    )


def starts(plan):
    return as_dict(plan, "partition", ["start", "rule"])


def test_bounds_and_latest_skip_flag(spark):
    bounds = bounds_frame(spark, [(0, 2, 9), (1, 4, 4)])
    assert starts(P.resume_plan(bounds, "earliest")) == {0: (2, "begin"), 1: (4, "begin")}
    latest = P.resume_plan(bounds, "latest")
    assert as_dict(latest, "partition", ["start", "skips_backlog"]) == {0: (9, True), 1: (4, False)}


def test_commits_and_their_fallbacks(spark):
    bounds = bounds_frame(spark, [(0, 5, 9), (1, 5, 9), (2, 5, 9), (3, 5, 5)])
    held = commits(spark, [(0, 7), (2, 3)])  # partition 2's commit has expired
    assert starts(P.resume_plan(bounds, "committed-earliest", group_commits=held)) == {
        0: (7, "commit"), 1: (5, "no-commit:begin"), 2: (5, "expired-commit:begin"), 3: (5, "no-commit:begin"),
    }
    late = P.resume_plan(bounds, "committed-latest", group_commits=held)
    assert as_dict(late, "partition", ["start", "skips_backlog"]) == {
        0: (7, False), 1: (9, True), 2: (9, True), 3: (5, False),
    }
    none = P.resume_plan(bounds, "committed-none", group_commits=held)
    assert starts(none)[1] == (None, "error")
    with pytest.raises(vectors.ResumeError):
        P.start_vector(none)


def test_timestamp_policies(spark):
    log = log_frame(spark, [(0, 0, 10), (0, 1, 20), (1, 0, 5)])
    bounds = bounds_frame(spark, [(0, 0, 2), (1, 0, 1), (2, 8, 8)])

    def plan(policy, lead=0):
        return P.resume_plan(bounds, "timestamp:15", log=log, on_no_match=policy, lead_ms=lead)

    assert starts(plan("end")) == {0: (1, "timestamp"), 1: (1, "no-match:end"), 2: (8, "empty")}
    assert starts(plan("earliest"))[1] == (0, "no-match:begin")
    assert starts(plan("error"))[1] == (None, "error")
    assert starts(plan("error", lead=10)) == {0: (0, "timestamp"), 1: (0, "timestamp"), 2: (8, "empty")}
    with pytest.raises(ValueError):
        plan("latest")


def test_flags_of_a_plan(spark):
    bounds = bounds_frame(spark, [(0, 5, 9), (1, 5, 9), (2, 5, 9), (3, 5, 9), (4, 3, 3), (5, 5, 9)])
    vector = {("t", 0): 4, ("t", 1): 10, ("t", 2): 9, ("t", 3): 5, ("t", 4): 3, ("t", 8): 1}
    plan = P.resume_plan(bounds, vector)
    assert as_dict(P.validate_plan(plan, bounds), "partition", "flag") == {
        0: "expired", 1: "past-end", 2: "skip-to-head", 3: "ok", 4: "ok", 5: "no-start",
        8: "unknown-partition",
    }
    with pytest.raises(vectors.ResumeError, match="expired"):
        P.start_vector(plan, bounds)
    sound = P.resume_plan(bounds, "earliest")
    assert P.start_vector(sound, bounds)[("t", 4)] == 3
    head = P.resume_plan(bounds, "latest")
    with pytest.raises(vectors.ResumeError, match="skip-to-head"):
        P.start_vector(head, bounds)
    assert P.start_vector(head, bounds, allow=("skip-to-head",))[("t", 0)] == 9


def test_json_and_kafka_options(spark):
    plan = P.resume_plan(bounds_frame(spark, [(1, 2, 9), (0, 0, 3)]), "earliest")
    assert json.loads(P.to_starting_offsets_json(plan)) == {"t": {"0": 0, "1": 2}}
    vector = P.start_vector(plan)
    bounded = logs.kafka_options("h:9092", "t", vector, {("t", 0): 3, ("t", 1): 9})
    assert json.loads(bounded["assign"]) == {"t": [0, 1]}
    assert json.loads(bounded["endingOffsets"]) == {"t": {"0": 3, "1": 9}}
    assert bounded["failOnDataLoss"] == "true" and "subscribe" not in bounded
    assert logs.kafka_options("h:9092", "t")["startingOffsets"] == "earliest"
    with pytest.raises(vectors.ResumeError):
        logs.kafka_options("h:9092", "t", vector, {("t", 0): 3})


def test_maximum_in_one_table_or_over_present_branches_loses(spark):
    """A starved table: the maximum of another one, and the least maximum of the branches
    that exist, both skip rows; the prefix over expected branches skips none."""
    log = positions(spark, [(0, i) for i in range(8)]).withColumn(
        "sink_table", F.when(F.col("offset") % 2 == 0, "t_a").otherwise("t_b")
    )
    held = log.where("sink_table = 't_a' AND offset < 7")
    bounds = logs.log_bounds(log)
    sink = held.withColumnsRenamed({"topic": "src_topic", "partition": "src_part", "offset": "src_offset"})
    maxima = held.groupBy("topic", "partition", "sink_table").agg(F.max("offset").alias("max_offset"))
    prefixes = branch_frontier(log, held).where("sink_table = 't_a'")
    plans = {
        "max": P.resume_plan(bounds, "store-max:t_a", sink=sink),
        "least": P.resume_plan(bounds, "store-frontier", progress=maxima.withColumn("job", F.lit("j")), job="j"),
        "prefix": P.resume_plan(bounds, "store-prefix", progress=prefixes, branches=BRANCHES),
    }
    found = as_dict(
        P.compare_plans(plans, log, held), "plan", ["start", "rows_reread", "rows_recovered", "rows_lost"]
    )
    assert found == {"max": (7, 0, 1, 3), "least": (7, 0, 1, 3), "prefix": (0, 4, 4, 0)}
    assert starts(plans["prefix"])[0][1] == "absent-branch:begin"


def test_topics_do_not_mix(spark):
    bounds = spark.createDataFrame(
        [("t", 0, 0, 9), ("u", 0, 0, 9)], "topic string, partition int, begin bigint, end bigint"
    )
    maxima = spark.createDataFrame(
        [("j", "t", 0, "t_a", 5), ("j", "u", 0, "t_a", 2)],
        "job string, topic string, partition int, sink_table string, max_offset bigint",
    )
    plan = P.resume_plan(bounds, "store-frontier", progress=maxima, job="j")
    assert as_dict(plan, "topic", "start") == {"t": 6, "u": 3}


@pytest.mark.parametrize("seed", range(5))
def test_prefix_restart_loses_nothing(spark, seed):
    rng = random.Random(seed)
    rows, kept = [], []
    for p in range(3):
        for o in range(3, 60):
            table = rng.choice(["t_a", "t_b", None])
            rows.append(("t", p, o, table))
            if table and rng.random() < rng.choice([0.2, 0.97, 1.0]):
                kept.append(("t", p, o, table))
    schema = "topic string, partition int, offset bigint, sink_table string"
    log, held = spark.createDataFrame(rows, schema), spark.createDataFrame(kept, schema)
    bounds = logs.log_bounds(log)
    wrote = held.select("topic", "partition", "sink_table").distinct()
    prefixes = branch_frontier(log, held).join(wrote, ["topic", "partition", "sink_table"], "left_semi")
    plan = P.resume_plan(bounds, "store-prefix", progress=prefixes, branches=BRANCHES)
    done = held.drop("sink_table").unionByName(log.where("sink_table IS NULL").drop("sink_table"))
    for row in P.compare_plans({"prefix": plan}, log, done).collect():
        assert row.rows_lost == 0
    reached = as_dict(frontier(log, done), "partition", "next_offset")
    for partition, start in as_dict(plan, "partition", "start").items():
        assert start <= reached[partition]


def test_unknown_or_incomplete_specs(spark):
    bounds = bounds_frame(spark, [(0, 0, 1)])
    with pytest.raises(ValueError, match="unknown start position"):
        P.resume_plan(bounds, "newest")
    with pytest.raises(ValueError, match="needs an input"):
        P.resume_plan(bounds, "committed-earliest")


def test_vectors_are_bounded_and_unique(spark):
    plan = P.resume_plan(bounds_frame(spark, [(0, 0, 1), (1, 0, 1)]), "earliest")
    with pytest.raises(vectors.ResumeError, match="more than 1"):
        vectors.collect_vector(plan, "start", max_rows=1)
    with pytest.raises(vectors.ResumeError, match="two values"):
        vectors.collect_vector(plan.unionByName(plan), "start")
    big = spark.range(50)
    with pytest.raises(vectors.ResumeError, match="more than 10"):
        vectors.pin_small(big, 10)
    assert vectors.pin_small(big, 50).count() == 50


@pytest.mark.parametrize("groups", [32, 1])
def test_range_reads_are_exact(spark, monkeypatch, groups):
    monkeypatch.setattr(vectors, "BOUNDS", groups)
    log = log_frame(spark, [(p, o) for p in range(3) for o in range(10)])
    bounds = logs.log_bounds(log)
    starts_, ends = {("t", 0): 2, ("t", 1): 5}, {("t", 0): 4, ("t", 1): 5}
    got = {(r.partition, r.offset) for r in logs.read_range(log, starts_, ends, bounds).collect()}
    assert got == {(0, 2), (0, 3)}
    followed = logs.stream_from(log, {("t", 0): 8, ("t", 1): 9})
    assert {(r.partition, r.offset) for r in followed.collect()} == {
        (0, 8), (0, 9), (1, 9), *[(2, o) for o in range(10)],
    }
    assert logs.read_range(log, {("t", 1): 5}, {("t", 1): 5}).count() == 0


def test_range_read_refuses_what_it_cannot_give(spark):
    log = log_frame(spark, [(0, o) for o in range(5, 10)])
    bounds = logs.log_bounds(log)
    with pytest.raises(vectors.ResumeError, match="no longer in the log"):
        logs.read_range(log, {("t", 0): 4}, {("t", 0): 6}, bounds)
    with pytest.raises(vectors.ResumeError, match="past the log"):
        logs.read_range(log, {("t", 0): 5}, {("t", 0): 11}, bounds)
    with pytest.raises(vectors.ResumeError, match="different partitions"):
        logs.read_range(log, {("t", 0): 5}, {("t", 1): 6})


def test_unnamed_partitions_are_read_whole_however_they_lie(spark):
    log = log_frame(spark, [(p, o) for p in range(8) for o in range(6)])
    followed = logs.stream_from(log, {("t", 2): 5, ("t", 5): 3, ("u", 1): 0})
    got = {(r.partition, r.offset) for r in followed.collect()}
    assert got == {(p, o) for p in range(8) for o in range(6) if o >= {2: 5, 5: 3}.get(p, 0)}


def test_an_expired_commit_is_flagged(spark):
    bounds = bounds_frame(spark, [(0, 50, 90), (1, 50, 90), (2, 0, 0)])
    commits = positions(spark, [(0, 20), (1, 60)]).withColumnRenamed("offset", "current_offset")
    for fallback, start in (("earliest", 50), ("latest", 90), ("none", None)):
        plan = P.resume_plan(bounds, f"committed-{fallback}", group_commits=commits)
        assert as_dict(plan, "partition", "start")[0] == start
        assert as_dict(plan, "partition", "rule")[0].startswith("expired-commit")
        assert as_dict(P.validate_plan(plan, bounds), "partition", "flag")[0] == "expired"
        with pytest.raises(vectors.ResumeError, match="expired"):
            P.start_vector(plan, bounds)


def test_a_plan_without_a_start_counts_nothing(spark):
    log = log_frame(spark, [(0, o) for o in range(4)])
    bounds = bounds_frame(spark, [(0, 0, 4), (1, 0, 0)])
    none = positions(spark, []).withColumnRenamed("offset", "current_offset")
    plans = {s: P.resume_plan(bounds, s, group_commits=none) for s in ("earliest", "committed-none")}
    got = P.compare_plans(plans, log, log.where("offset < 1"))
    counts = as_dict(got, ["plan", "partition"], ["rows_reread", "rows_recovered", "rows_lost"])
    assert counts == {
        ("earliest", 0): (1, 3, 0), ("earliest", 1): (0, 0, 0),
        ("committed-none", 0): (None, None, None), ("committed-none", 1): (None, None, None),
    }


def test_kafka_starts_by_time_and_limits_batches():
    options = logs.kafka_options("b:1", "t", start_ms=5, max_offsets=100, min_offsets=10, max_wait="5s")
    assert options["startingTimestamp"] == "5" and "startingOffsets" not in options
    assert options["startingOffsetsByTimestampStrategy"] == "error"
    assert (options["maxOffsetsPerTrigger"], options["minOffsetsPerTrigger"], options["maxTriggerDelay"]) == ("100", "10", "5s")
    options = logs.kafka_options("b:1", "t", start_ms={("t", 0): 5}, end_ms={("t", 0): 9}, on_no_match="end")
    assert options["startingOffsetsByTimestamp"] == '{"t": {"0": 5}}' and options["endingOffsetsByTimestamp"] == '{"t": {"0": 9}}'
    assert options["startingOffsetsByTimestampStrategy"] == "latest"
    with pytest.raises(ValueError):
        logs.kafka_options("b:1", "t", start_ms=5, on_no_match="earliest")
