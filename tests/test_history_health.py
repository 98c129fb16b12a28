from datetime import datetime

from pyspark.sql import functions as F

from tidemark.fixtures import NOW_MS, now
from tidemark.operators import health as M
from tidemark.operators import history as H
from tidemark.operators.versions import latest_version
from tidemark.sources import tables
from tests.shapes import as_dict, bounds_frame, log_frame

MINUTE = 60_000


def test_profile_of_holes_and_unordered_clocks(spark):
    log = log_frame(spark, [(0, 100, 60), (0, 101, 10), (0, 159, 40), (1, 800, 5), (1, 819, 9)])
    cols = ["begin", "end", "span", "records", "holes", "first_offset_ts", "last_offset_ts", "min_ts", "max_ts"]
    assert as_dict(H.history_profile(log), "partition", cols) == {
        0: (100, 160, 60, 3, 57, 60, 40, 10, 60),
        1: (800, 820, 20, 2, 18, 5, 9, 5, 9),
    }


def test_interval_span_is_not_its_count(spark):
    log = log_frame(spark, [(0, 99, 1), (0, 100, 8), (0, 101, 8), (0, 102, 3), (0, 104, 8), (0, 105, 9)])
    row = H.interval_count(log, 8, 9).first()
    assert (row.from_offset, row.to_offset, row.span, row["records"]) == (100, 105, 5, 3)
    assert H.interval_miss(log, 8, 9).count() == 0


def test_interval_misses_records_behind_an_early_end(spark):
    log = log_frame(spark, [(0, 0, 8), (0, 1, 9), (0, 2, 8), (0, 3, 1)])
    assert [r.offset for r in H.interval_miss(log, 8, 9).collect()] == [2]


def test_retention_is_bound_by_size_or_time(spark):
    log = log_frame(spark, [(0, 0, 0, "x" * 50), (0, 1, 100, "x" * 50), (1, 0, 7, "x" * 10)])
    estimate = H.retention_estimate(H.history_profile(log, with_bytes=True), 1000, 500)
    assert as_dict(estimate, "partition", ["size_window_ms", "window_ms", "bound_by"]) == {
        0: (500, 500, "size"), 1: (None, 1000, "time"),
    }


def test_lag_without_commit_is_the_whole_log(spark):
    commits = spark.createDataFrame([("t", 0, 4)], "topic string, partition int, current_offset bigint")
    bounds = bounds_frame(spark, [(0, 1, 9), (1, 2, 5)])
    assert as_dict(M.lag(bounds, commits), "partition", "lag") == {0: 5, 1: 3}


def at(ms):
    return F.timestamp_millis(F.lit(ms))


def test_tables_without_rows_are_stale(spark):
    sink = spark.createDataFrame([("t_a", NOW_MS - 5 * MINUTE), ("t_b", NOW_MS - 11 * MINUTE)], "sink_table string, ms bigint")
    sink = sink.withColumn("inserted_at", F.timestamp_millis("ms"))
    found = as_dict(M.stale_tables(sink, ["t_a", "t_b", "t_c"], now(), 10), "sink_table", ["age_ms", "stale"])
    assert found == {"t_a": (5 * MINUTE, False), "t_b": (11 * MINUTE, True), "t_c": (None, True)}


def test_rejects_of_the_last_minutes(spark):
    rows = [("j", "poison", NOW_MS), ("j", "poison", NOW_MS - 4 * MINUTE), ("j", "long", NOW_MS - 6 * MINUTE),
            ("j", "poison", NOW_MS + 1)]
    rejects = spark.createDataFrame(rows, "job string, reason string, ms bigint").withColumn(
        "rejected_at", F.timestamp_millis("ms")
    )
    assert as_dict(M.reject_rate(rejects, now(), 5), "reason", "rejects") == {"poison": 2}
    assert tables.read_rejects(rejects, "j", datetime(2024, 1, 31)).count() == 2


def progress(spark, rows):
    df = spark.createDataFrame(rows, "job string, topic string, partition int, next_offset bigint, rows_written bigint, ms bigint")
    return df.withColumn("updated_at", F.timestamp_millis("ms")).drop("ms")


def test_progress_reads_the_latest_row_of_one_topic(spark):
    rows = progress(spark, [("j", "t", 0, 5, 1, 10), ("j", "t", 0, 9, 1, 20), ("j", "t", 0, 3, 1, 20),
                            ("j", "u", 0, 99, 1, 30), ("k", "t", 0, 98, 1, 30)])
    assert as_dict(tables.read_progress(rows, "j", "t"), "partition", "next_offset") == {0: 9}
    # A deliberate rewind is a newer row with a lower offset.
    rewound = rows.unionByName(progress(spark, [("j", "t", 0, 2, 0, 40)]))
    assert as_dict(tables.read_progress(rewound, "j", "t"), "partition", "next_offset") == {0: 2}


def test_stalled_partitions_only(spark):
    old, new = NOW_MS - 11 * MINUTE, NOW_MS - MINUTE
    rows = progress(spark, [("j", "t", 0, 5, 1, old), ("j", "t", 0, 6, 1, new), ("j", "t", 1, 5, 1, old)])
    assert as_dict(M.stalled_progress(rows, now(), 10), "partition", "age_ms") == {1: 11 * MINUTE}


def test_headroom_of_the_oldest_needed_record(spark):
    log = log_frame(spark, [(0, 0, 10), (0, 2, 30), (0, 3, 20), (1, 0, 5)])
    reached = spark.createDataFrame([("t", 0, 1), ("t", 1, 1)], "topic string, partition int, next_offset bigint")
    found = as_dict(M.retention_headroom(log, reached, 100, 50), "partition", ["oldest_needed", "age_ms", "headroom_ms"])
    assert found == {0: (2, 20, 80)}


def test_crosscheck_names_the_disagreement(spark):
    stored = spark.createDataFrame(
        [("t", 0, 10), ("t", 1, 10), ("t", 2, 10), ("t", 3, 10)], "topic string, partition int, next_offset bigint"
    )
    ranges = spark.createDataFrame(
        [("t", 0, 0, 9), ("t", 1, 0, 8), ("t", 2, 0, 12), ("t", 4, 0, 1)],
        "topic string, partition int, from_offset bigint, to_offset bigint",
    )
    assert as_dict(M.progress_crosscheck(stored, ranges), "partition", "status") == {
        0: "agree", 1: "progress-ahead", 2: "progress-behind", 3: "no-audit", 4: "no-progress",
    }


def test_commit_notes_skip_blank_and_old(spark):
    rows = [(100, 3, '{"job":"j","topic":"t","p":3,"from":10,"to":12}'), (200, 1, ""),
            (300, 2, '{"job":"j","topic":"t","p":1,"from":13,"to":14}'), (5, 9, '{"job":"j","topic":"t","p":1,"from":0,"to":8}')]
    commits = spark.createDataFrame(rows, "ms bigint, written_rows bigint, log_comment string").withColumn(
        "event_time", F.timestamp_millis("ms")
    )
    newest = tables.read_commits(commits, at(50), 50).collect()
    assert [(r.partition, r.last_offset, r.written_rows) for r in newest] == [(1, 14, 2), (3, 12, 3)]
    assert tables.read_commits(commits, at(50), 1).count() == 1


def test_ledger_lines_blank_and_broken(spark, tmp_path):
    path = tmp_path / "produced.jsonl"
    line = '{"event_id": 1, "produced_at": 2, "route": "a", "phase": "before-outage", "record_ts": 2}'
    path.write_text(f"{line}\n\n   \n{line.replace('1,', '2,', 1)}\n")
    assert [r.event_id for r in tables.read_ledger(spark, str(path)).collect()] == [1, 2]


def test_latest_version_of_a_hot_key(spark):
    rows = spark.range(30000).selectExpr("1 AS k", "id AS v").unionByName(spark.sql("SELECT 2 AS k, 5L AS v"))
    assert as_dict(latest_version(rows, ["k"], ["v"]), "k", "v") == {1: 29999, 2: 5}


def test_jdbc_slices():
    options = tables.jdbc_options("jdbc:postgresql://h/db", "t_a", 0, 1000, 8)
    assert options["partitionColumn"] == "src_offset" and options["numPartitions"] == "8"
    assert options["dbtable"] == "t_a" and options["upperBound"] == "1000"
