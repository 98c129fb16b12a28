import re

from pyspark.sql import functions as F

from tidemark.operators import reconcile as R
from tests.shapes import as_dict, positions

LEDGER = "event_id bigint, produced_at bigint, route string, phase string"
SINK = "sink_table string, event_id bigint, src_topic string, src_part int, src_offset bigint"


def ledger(spark, rows):
    return spark.createDataFrame([(i, i, r, p) for i, r, p in rows], LEDGER)


def sink(spark, rows):
    return spark.createDataFrame([(t, i, "t", 0, i) for t, i in rows], SINK)


BASIC = [
    (1, "b", "before-outage"),
    (2, "a", "during-outage"),
    (3, "b", "during-outage"),
    (4, "a", "during-outage"),
    (5, "zz", "during-outage"),
    (500, "rare", "after-restart"),
]


def compared(spark, stored, rows=BASIC):
    return R.compare_ids(R.expected_rows(ledger(spark, rows)), sink(spark, stored))


def test_verdict_counts_and_kinds(spark):
    cmp = compared(spark, [("t_b", 1), ("t_b", 1), ("t_a", 2), ("t_a", 3), ("t_a", 77)])
    per_table = as_dict(
        R.table_verdict(cmp, ["t_a", "t_b", "t_rare"]),
        "sink_table",
        ["expected", "actual_distinct", "rows", "missing_count", "extra_count", "duplicate_count"],
    )
    assert per_table == {
        "t_a": (2, 3, 3, 1, 2, 0),
        "t_b": (2, 1, 2, 1, 0, 1),
        "t_rare": (1, 0, 0, 1, 0, 0),
    }
    assert {(r.sink_table, r.event_id) for r in R.missing_ids(cmp).collect()} == {
        ("t_a", 4), ("t_b", 3), ("t_rare", 500),
    }
    assert {(r.sink_table, r.event_id) for r in R.extra_ids(cmp).collect()} == {("t_a", 3), ("t_a", 77)}
    assert [(r.event_id, r.stored_copies) for r in R.duplicate_ids(cmp).collect()] == [(1, 2)]


def test_empty_sides_still_give_every_table(spark):
    cmp = R.compare_ids(R.expected_rows(ledger(spark, [])), sink(spark, []))
    assert R.table_verdict(cmp, ["t_a", "t_b"]).count() == 2
    row = R.verdict(R.table_verdict(cmp, ["t_a"])).first()
    assert row["pass"] and row.missing == 0
    assert not R.verdict(R.table_verdict(cmp, ["t_a"]), "loss").first()["pass"]


def test_verdict_rule(spark):
    def passed(stored, **how):
        return R.verdict(R.table_verdict(compared(spark, stored)), **how).first()["pass"]

    whole = [("t_b", 1), ("t_a", 2), ("t_b", 3), ("t_a", 4), ("t_rare", 500)]
    assert passed(whole)
    assert passed(whole + whole[:1])
    assert not passed(whole + whole[:1], unique_required=True)
    assert not passed(whole + [("t_a", 9)])
    assert not passed(whole[1:])
    assert not passed(whole, expect="loss")
    # A loss scenario looks at missing rows only, whatever else is there.
    assert passed(whole[1:] + [("t_a", 9)], expect="loss")


def test_outage_is_blind_to_tables_and_counts_unknown_routes(spark):
    row = R.outage(ledger(spark, BASIC), sink(spark, [("t_a", 3), ("t_a", 3), ("t_a", 2)])).first()
    assert (row.produced, row.saved, row.lost) == (4, 2, 2)


def test_samples_are_the_least_ids_in_order(spark):
    many = ledger(spark, [(i, "a", "before-outage") for i in range(100, 0, -1)])
    cmp = R.compare_ids(R.expected_rows(many), sink(spark, [("t_a", 7), ("t_a", 7), ("t_a", 999)]))
    found = as_dict(R.samples(cmp, 20), ["sink_table", "kind"], "sample")
    assert found[("t_a", "missing")] == [i for i in range(1, 22) if i != 7]
    assert found[("t_a", "extra")] == [999]
    assert found[("t_a", "duplicate")] == [7]


def test_report_has_samples_outage_and_verdict(spark):
    rows = {
        r.sink_table: r
        for r in R.verdict_report(
            ledger(spark, BASIC), sink(spark, [("t_b", 1), ("t_a", 2)]), "nightly"
        ).collect()
    }
    assert rows["t_a"].missing_sample == [4] and rows["t_a"].extra_sample == []
    assert rows["t_rare"].outage.asDict() == {"produced": 4, "saved": 1, "lost": 3}
    assert not rows["t_b"]["pass"]


def test_scenarios_are_independent(spark):
    ledgers = ledger(spark, BASIC).withColumn("scenario", F.explode(F.lit(["S1", "S2"])))
    stored = sink(spark, [("t_b", 1), ("t_b", 1), ("t_a", 2), ("t_a", 5)]).withColumn(
        "scenario", F.lit("S1")
    )
    specs = spark.createDataFrame(
        [("S1", "loss", False), ("S2", "no-loss", True), ("S3", "no-loss", False)],
        "scenario string, expect string, unique_required boolean",
    )
    cols = ["produced", "saved", "lost", "missing", "duplicate", "extra", "pass"]
    found = as_dict(R.scenario_summary(ledgers, stored, specs), "scenario", cols)
    assert found["S1"] == (4, 2, 2, 3, 1, 1, True)
    assert found["S2"] == (4, 0, 4, 5, 0, 0, False)
    assert found["S3"] == (0, 0, 0, 0, 0, 0, True)


def test_tasks_of_the_summary_grow_with_the_stored_rows(spark, monkeypatch):
    rows = [("t_b", 1), *[("t_a", 2)] * 300, *[("t_a", 4 + 10 * i) for i in range(400)], ("t_b", 3), (None, 7), ("t_x", 7), ("t_a", None)]
    names = F.when(F.col("event_id") % 4 == 3, "S2").otherwise("S1")
    stored = sink(spark, rows).withColumn("scenario", names)
    specs = spark.createDataFrame([("S1", "loss", False), ("S2", "loss", False)], "scenario string, expect string, unique_required boolean")
    cols = ["produced", "saved", "lost", "missing", "duplicate", "extra", "pass"]
    expected = {"S1": (4, 2, 2, 2, 1, 400, True), "S2": (4, 1, 3, 4, 0, 0, True)}
    assert as_dict(R.scenario_summary(ledger(spark, BASIC), stored, specs), "scenario", cols) == expected
    monkeypatch.setattr(R, "ROWS_IN_TASK", 50)
    summary = R.scenario_summary(ledger(spark, BASIC), stored, specs)
    text = summary._jdf.queryExecution().executedPlan().toString()
    # 703 rows in audited tables; no setting and no size of shuffled bytes makes the tasks fewer.
    assert re.findall(r"hashpartitioning\(event_id#\d+L?, (?:_place#\d+L?, )?15\), REPARTITION_BY_NUM", text)
    assert "SortAggregate" not in text
    assert as_dict(summary, "scenario", cols) == expected


def test_one_id_with_most_of_the_rows(spark):
    hot = spark.range(20000).select(F.lit("t_a").alias("sink_table"), F.lit(2).cast("bigint").alias("event_id"))
    cmp = R.compare_ids(R.expected_rows(ledger(spark, BASIC)), hot)
    assert R.duplicate_ids(cmp).first().stored_copies == 20000
    assert R.multiplicity(cmp).where("event_id = 2").first().surplus == 19999


def test_content_diff_sees_nulls_and_any_copy(spark):
    schema = "id bigint, x string, y bigint"
    exp = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3), (4, "", 4), (5, "e", 5)], schema)
    act = spark.createDataFrame(
        [(1, "a", 1), (2, None, 2), (3, "c", 3), (3, "c", 9), (4, None, 4), (6, "e", 5)], schema
    )
    found = as_dict(R.content_diff(exp, act, ["id"], ["x", "y"]), "id", "diff_columns")
    assert found == {3: ["y"], 4: ["x"]}


def test_causes_of_duplicates(spark):
    rows = [("t_a", 1, 0, 1), ("t_a", 1, 0, 1), ("t_a", 2, 0, 2), ("t_a", 2, 1, 2),
            ("t_a", 3, 0, 3), ("t_a", 3, 0, 3), ("t_a", 3, 1, 3), ("t_a", 4, 0, 4)]
    df = spark.createDataFrame([(t, i, "t", p, o) for t, i, p, o in rows], SINK)
    assert as_dict(R.dup_cause(df), "event_id", "cause") == {1: "replay", 2: "producer", 3: "both"}


def test_hops_show_repeats_that_the_sink_absorbs(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "event_id bigint")
    stages = [("ledger", ids(1, 2, 3, 4)), ("hop", ids(1, 1, 2, 3)), ("sink", ids(1, 2, 9))]
    per_id = R.hop_reconcile(stages)
    assert as_dict(per_id, "event_id", "last_stage") == {1: "sink", 2: "sink", 3: "hop", 4: "ledger", 9: "sink"}
    rows = as_dict(
        R.hop_summary(per_id, [n for n, _ in stages]), "stage", ["reached", "lost", "unexpected", "repeats"]
    )
    assert rows == {"ledger": (4, 0, 0, 0), "hop": (3, 1, 0, 1), "sink": (3, 1, 1, 0)}


def test_books_balance_only_without_conflict_or_stray(spark):
    log = positions(spark, [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)])
    saved = positions(spark, [(0, 0), (1, 0), (2, 0), (2, 7)])
    rejected = positions(spark, [(0, 1), (1, 0)])
    rows = as_dict(
        R.balance(log, [("saved", saved), ("rejected", rejected)]),
        "partition",
        ["produced", "saved", "rejected", "outstanding", "conflicts", "stray", "balanced"],
    )
    assert rows == {
        0: (3, 1, 1, 1, 0, 0, True),
        1: (2, 1, 1, 1, 1, 0, False),
        2: (1, 1, 0, 0, 0, 1, False),
    }
    assert [tuple(r) for r in R.conflicts(saved, rejected).collect()] == [("t", 1, 0)]


def test_branches_trail_their_leader(spark):
    log = positions(spark, [(0, i) for i in range(6)]).withColumn(
        "sink_table", F.when(F.col("offset") % 2 == 0, "t_a").when(F.col("offset") < 5, "t_b")
    )
    stored = spark.createDataFrame(
        [("t_a", 0, "t", 0, 0), ("t_a", 4, "t", 0, 4), ("t_a", 4, "t", 0, 4)], SINK
    )
    rows = as_dict(
        R.branch_divergence(log, stored), "sink_table", ["last_offset", "delivered", "missing", "behind_leader"]
    )
    assert rows == {"t_a": (4, 2, 1, 0), "t_b": (None, 0, 2, 5)}


def test_phases_routes_and_surplus(spark):
    df = ledger(spark, BASIC)
    assert [(r.phase, r.events, r.min_id, r.max_id) for r in R.ledger_phases(df).collect()] == [
        ("before-outage", 1, 1, 1), ("during-outage", 4, 2, 5), ("after-restart", 1, 500, 500),
    ]
    assert as_dict(R.route_split(df), "route", "events") == {"a": 2, "b": 2, "rare": 1, "zz": 1}
    twice = df.unionByName(df.where("event_id < 3"))
    row = R.distinct_since(twice, "produced_at", 2).first()
    assert (row["rows"], row.distinct_ids, row.surplus) == (6, 5, 1)


def test_command_line_audit(spark, tmp_path):
    import json

    from tidemark import verify

    whole = [("t_b", 1), ("t_a", 2), ("t_b", 3), ("t_a", 4), ("t_rare", 500)]
    ledger(spark, BASIC).withColumn("record_ts", F.col("produced_at")).write.json(f"{tmp_path}/ledger")
    for name, rows in (("good", whole), ("bad", whole[1:])):
        sink(spark, rows).write.partitionBy("sink_table").parquet(f"{tmp_path}/{name}")

    def run(*audits):
        lines = [{"name": n, "ledger": f"{tmp_path}/ledger", "sink": f"{tmp_path}/{n}", **more} for n, more in audits]
        (tmp_path / "audits.json").write_text("\n".join(map(json.dumps, lines)))
        return verify.main([f"{tmp_path}/audits.json", f"{tmp_path}/out"])

    assert run(("good", {}), ("bad", {"expect": "loss"})) == 0
    assert run(("good", {"expect": "loss"}), ("bad", {}), ("good", {"tables": ["t_a"]})) == 2
    assert run(("bad", {}), ("never-created", {}), ("good", {})) == 2
    report = {(r.scenario, r.sink_table): r for r in spark.read.json(f"{tmp_path}/out").collect()}
    assert report["bad", "t_b"].missing_sample == [1] and report["bad", "t_a"].missing_count == 0
    assert report["never-created", "t_a"].missing_count == 2 and report["never-created", "t_a"].outage.saved == 0
