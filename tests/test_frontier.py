import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import frontier as W
from tests.shapes import as_dict, bounds_frame, log_frame, positions


def brute_next(offsets, done):
    for offset in sorted(offsets):
        if offset not in done:
            return offset
    return max(offsets) + 1


def brute_runs(offsets):
    out = []
    for offset in sorted(offsets):
        if out and out[-1][1] + 1 == offset:
            out[-1][1] = offset
        else:
            out.append([offset, offset])
    return {tuple(r) for r in out}


@pytest.mark.parametrize("seed", range(4))
def test_frontier_and_gaps_against_a_loop(spark, seed):
    rng = random.Random(seed)
    logged, done = {}, {}
    for p in range(3):
        logged[p] = [o for o in range(5, 90) if rng.random() < (0.9 if seed % 2 else 1.0)]
        lost = rng.choice([0.0, 0.02, 0.5, 1.0])
        done[p] = {o for o in logged[p] if rng.random() >= lost}
    log = positions(spark, [(p, o) for p in logged for o in logged[p]])
    # Accounted positions may repeat, and may be older than the log.
    acc = [(p, o) for p in done for o in done[p]]
    accounted = positions(spark, acc + acc[:7] + [(0, 1), (9, 1)])
    found = as_dict(W.frontier(log, accounted), "partition", ["next_offset", "outstanding"])
    assert found == {
        p: (brute_next(logged[p], done[p]), len(set(logged[p]) - done[p])) for p in logged
    }
    for bucket in (1, 4, 16, 1 << 18):
        runs = {}
        for r in W.gap_ranges(log, accounted, bucket).collect():
            runs.setdefault(r.partition, set()).add((r.from_offset, r.to_offset))
            assert r["records"] == r.to_offset - r.from_offset + 1
        assert runs == {
            p: brute_runs(set(logged[p]) - done[p]) for p in logged if set(logged[p]) - done[p]
        }


def test_empty_partition_stands_at_its_begin(spark):
    bounds = bounds_frame(spark, [(0, 0, 3), (1, 40, 40)])
    log = positions(spark, [(0, 0), (0, 1), (0, 2)])
    found = as_dict(
        W.frontier(log, positions(spark, [(0, 0), (0, 2)]), bounds),
        "partition",
        ["next_offset", "outstanding", "naive_next"],
    )
    assert found == {0: (1, 1, 3), 1: (40, 0, None)}


def test_filtered_records_must_be_accounted(spark):
    log = positions(spark, [(0, i) for i in range(4)])
    delivered, filtered = positions(spark, [(0, 0), (0, 2)]), positions(spark, [(0, 1), (0, 3)])
    assert W.frontier(log, delivered).first().next_offset == 1
    assert W.frontier(log, delivered.unionByName(filtered)).first().next_offset == 4


def test_branches_have_their_own_prefix(spark):
    log = positions(spark, [(0, i) for i in range(10)]).withColumn(
        "sink_table", F.when(F.col("offset") == 9, None).when(F.col("offset") % 2 == 0, "t_a").otherwise("t_b")
    )
    held = log.where("sink_table = 't_a' OR offset IN (1, 7)")
    # A position stored by the wrong branch does not count.
    wrong = log.where("offset = 3").withColumn("sink_table", F.lit("t_a"))
    found = as_dict(
        W.branch_frontier(log, held.where("sink_table IS NOT NULL").unionByName(wrong)),
        "sink_table",
        ["next_offset", "outstanding"],
    )
    assert found == {"t_a": (10, 0), "t_b": (3, 2)}


def ranges_frame(spark, rows):
    return spark.createDataFrame(
        [("t", *r) for r in rows], "topic string, partition int, from_offset bigint, to_offset bigint"
    )


@pytest.mark.parametrize("bucket", [1, 8, 1 << 18])
def test_adjacency_sees_gaps_overlaps_and_second_writers(spark, bucket):
    rows = [
        (0, 0, 9), (0, 10, 19), (0, 25, 29), (0, 30, 39), (0, 32, 34), (0, 40, 49), (0, 40, 49),
        (1, 7, 7), (1, 8, 8),
    ]
    found = as_dict(
        W.range_adjacency(ranges_frame(spark, rows), bucket),
        ["partition", "from_offset"],
        ["copies", "expected_from", "status"],
    )
    assert found == {
        (0, 0): (1, None, "first"),
        (0, 10): (1, 10, "ok"),
        (0, 25): (1, 20, "gap"),
        (0, 30): (1, 30, "ok"),
        (0, 32): (1, 40, "overlap"),
        (0, 40): (2, 40, "overlap"),
        (1, 7): (1, None, "first"),
        (1, 8): (1, 8, "ok"),
    }


@pytest.mark.parametrize("seed", range(3))
def test_adjacency_does_not_depend_on_the_bucket(spark, seed):
    rng = random.Random(seed)
    rows = [(p, f, f + rng.randrange(12)) for p in range(2) for f in rng.choices(range(100), k=25)]
    frame = ranges_frame(spark, rows)
    results = [
        {tuple(r) for r in W.range_adjacency(frame, bucket).collect()} for bucket in (1, 7, 1000)
    ]
    assert results[0] == results[1] == results[2]


def test_first_offset_at_a_time_with_unordered_clocks(spark):
    log = log_frame(spark, [(0, 0, 10), (0, 1, 50), (0, 2, 20), (0, 3, 50), (1, 0, 1)])
    assert as_dict(W.offsets_for_times(log, 20), "partition", "first_offset") == {0: 1, 1: None}


@pytest.mark.parametrize("seed", range(4))
def test_interval_sets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    ranges = []
    for _ in range(rng.randint(0, 40)):
        low = rng.randint(0, 120)
        ranges.append(("t", rng.randint(0, 2), low, low + rng.randint(0, rng.choice([0, 3, 40]))))
    frame = spark.createDataFrame(ranges, "topic string, partition int, from_offset bigint, to_offset bigint")
    bounds = [("t", p, b, b + rng.randint(0, 160)) for p, b in ((0, 0), (1, 7), (2, 0))]
    bounds_frame = spark.createDataFrame(bounds, "topic string, partition int, begin bigint, end bigint")
    half = rng.randint(0, len(ranges))
    schema = frame.schema
    one, two = (W.merge_ranges(spark.createDataFrame(part, schema), 16) for part in (ranges[:half], ranges[half:]))
    runs = W.merge_ranges(one.unionByName(two), rng.choice([1, 16, 1 << 18]))
    covered = {p: sorted({o for _, q, a, b in ranges if q == p for o in range(a, b + 1)}) for p in range(3)}
    expected = []
    for p, offsets in covered.items():
        for o in offsets:
            if expected and expected[-1][0] == p and expected[-1][2] == o - 1:
                expected[-1][2] = o
            else:
                expected.append([p, o, o])
    assert sorted([r.partition, r.from_offset, r.to_offset] for r in runs.collect()) == expected
    got = {r.partition: (r.next_offset, r.outstanding, r.naive_next) for r in W.frontier_from_ranges(runs, bounds_frame).collect()}
    for _, p, begin, end in bounds:
        inside = [o for o in covered[p] if begin <= o < end]
        open_ = [o for o in range(begin, end) if o not in set(inside)]
        reached = open_[0] if open_ else end
        assert got[p] == (reached, len(open_), inside[-1] + 1 if inside else None)
