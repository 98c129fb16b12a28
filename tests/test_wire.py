import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, routes, wire
from tests.shapes import log_frame

LINES = [
    (0, 0, 0, "5\t100\ta\thello"),
    (0, 1, 0, None),
    (0, 2, 0, "5\t100\ta"),
    (0, 3, 0, "6\t100\tb\tx\ty"),
    (0, 4, 0, "7\t100\trare\t"),
    (0, 5, 0, " 5\t100\ta\tx"),
    (0, 6, 0, "x\t100\ta\tx"),
    (0, 7, 0, "8\t\ta\tx"),
    (0, 8, 0, "+9\t-1\tzzz\tx"),
    (0, 9, 0, "9999999999999999999\t1\ta\tx"),
    (0, 10, 0, ""),
    (0, 11, 0, "1.0\t1\ta\tx"),
]


def test_decode_classifies_every_line(spark):
    rows = {r.offset: r for r in wire.decode(log_frame(spark, LINES)).collect()}
    assert len(rows) == len(LINES)
    assert [rows[i].disposition for i in range(12)] == [
        "event", "empty", "malformed", "event", "event", "malformed", "malformed", "malformed",
        "event", "malformed", "malformed", "malformed",
    ]
    assert rows[2].reason == "fields" and rows[10].reason == "fields"
    assert rows[5].reason == rows[6].reason == rows[9].reason == rows[11].reason == "event_id"
    assert rows[7].reason == "produced_at"
    assert (rows[3].event_id, rows[3].payload) == (6, "x")
    assert rows[4].payload == ""
    assert (rows[8].event_id, rows[8].produced_at) == (9, -1)


def test_bad_bytes_are_replaced_not_fatal(spark):
    log = log_frame(spark, [(0, 0)]).withColumn(
        "value", F.concat(F.lit(b"1\t2\ta\tx"), F.unhex(F.lit("FF")), F.lit(b"y"))
    )
    assert wire.decode(log).first().payload == "x�y"


def test_roundtrip_drops_extra_fields(spark):
    again = wire.encode(wire.events_only(wire.decode(log_frame(spark, LINES))))
    texts = {r.offset: (bytes(r.key), bytes(r.value)) for r in again.collect()}
    assert texts[0] == (b"5", b"5\t100\ta\thello")
    assert texts[3] == (b"6", b"6\t100\tb\tx")
    assert texts[4] == (b"7", b"7\t100\trare\t")
    assert set(texts) == {0, 3, 4, 8}


def test_malformed_keeps_the_raw_text(spark):
    raw = {r.offset: r.payload for r in wire.malformed(wire.decode(log_frame(spark, LINES))).collect()}
    assert raw[2] == "5\t100\ta"
    assert raw[10] == ""
    assert len(raw) == 7


def test_dispositions_in_order(spark):
    lines = [
        (0, 0, 0, "1\t0\ta\tx"),
        (0, 1, 0, "10\t0\ta\tx"),
        (0, 2, 0, "10\t0\trare\tx"),
        (0, 3, 0, "10\t0\tq\tx"),
        (0, 4, 0, None),
        (0, 5, 0, "bad"),
    ]
    judged = rules.dispose(
        wire.decode(log_frame(spark, lines)), rules.every_nth_is_bad(10), drop_route="rare"
    )
    found = {r.offset: (r.disposition, r.reason, r.sink_table) for r in judged.collect()}
    assert found == {
        0: ("delivered", None, "t_a"),
        1: ("rejected", "poison", "t_a"),
        2: ("filtered", None, "t_rare"),
        3: ("unrouted", None, None),
        4: ("empty", None, None),
        5: ("malformed", "fields", None),
    }


def test_first_rule_names_the_reason_and_infra_fails(spark):
    df = spark.createDataFrame([(10,), (3,)], "event_id bigint")
    data = [rules.Rule("big", F.col("event_id") > 5), *rules.every_nth_is_bad(10)]
    assert {r.event_id: r.reason for r in rules.apply_rules(df, data).collect()} == {10: "big", 3: None}
    infra = rules.Rule("disk", F.col("event_id") == 10, kind="infra")
    with pytest.raises(Exception, match="not a data error"):
        rules.apply_rules(df, [infra]).collect()
    assert rules.apply_rules(df.where("event_id = 3"), [infra]).first().reason is None
    with pytest.raises(ValueError):
        rules.Rule("odd", F.lit(True), kind="whatever")


def test_routes_phases_windows(spark):
    df = spark.createDataFrame(
        [(1000, 5, "a"), (2, 10, None), (3, 20, "zz")], "event_id bigint, produced_at bigint, route string"
    )
    assert [r[0] for r in df.select(routes.route_of(F.col("event_id"))).collect()] == ["rare", "a", "b"]
    tagged = routes.tag_phase(df, 10, 20)
    assert [r.phase for r in tagged.collect()] == ["before-outage", "during-outage", "after-restart"]
    assert [r.sink_table for r in routes.map_routes(df).collect()] == ["t_a", None, None]
    assert [r.sink_table for r in routes.map_routes(df, {"zz": "z"}).collect()] == [None, None, "z"]
    assert routes.route_filter(df, "a").count() == 2
    assert routes.route_filter(df).count() == 3
    assert [r.event_id for r in routes.in_window(df, "produced_at", 5, 20).collect()] == [1000, 2]


def test_numbers_take_no_newline_and_null_fields_stay_in_place(spark):
    log = log_frame(spark, [(0, 0, 1, "5\n\t1\ta\tp"), (0, 1, 1, "+5\t-1\ta\tp"), (0, 2, 1, "5\t1\n\ta\tp")])
    got = {r.offset: (r.event_id, r.produced_at, r.reason) for r in wire.decode(log).collect()}
    assert got == {0: (None, 1, "event_id"), 1: (5, -1, None), 2: (5, None, "produced_at")}
    events = spark.createDataFrame([(7, 8, None, None)], "event_id long, produced_at long, route string, payload string")
    assert bytes(wire.encode(events).first().value) == b"7\t8\t\t"
