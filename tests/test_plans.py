"""The physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.fixtures import Fixtures
from tidemark.operators import frontier as W
from tidemark.operators import reconcile as R
from tidemark.plans import resume as P
from tidemark.schemas import SINK
from tidemark.sources import logs, tables
from tidemark.streaming import sinks as K

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", text)


def stored_log(spark, tmp_path):
    f = Fixtures(spark, SF)
    path = f"{tmp_path}/log"
    f.log.select("topic", "partition", "offset", "record_ts", "key", "value").write.parquet(path)
    return logs.topic_log(spark, path)


def test_range_and_start_vectors_reach_the_scan(spark, tmp_path):
    log = stored_log(spark, tmp_path)
    text = plan(logs.read_range(log, {("events", 0): 5, ("events", 1): 7}, {("events", 0): 9, ("events", 1): 9}))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(offset,5)" in pushed and "LessThan(offset,9)" in pushed
    assert exchanges(text) == []


@pytest.mark.parametrize("partitions", [2, 65, 5_000])
def test_start_vectors_of_any_size_reach_the_scan(spark, tmp_path, partitions):
    log = stored_log(spark, tmp_path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1_000_000)
    text = plan(logs.stream_from(log, {("events", p): 5 + p for p in range(partitions)}))
    spark.conf.set("spark.sql.maxMetadataStringLength", 5_000)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(offset,5)" in pushed and exchanges(text) == []


def test_headroom_reads_from_the_frontier_on(spark, tmp_path):
    from tidemark.operators import health

    frontiers = spark.createDataFrame([("events", p, 7 + p) for p in range(3)], "topic string, partition int, next_offset long")
    text = plan(health.retention_headroom(stored_log(spark, tmp_path), frontiers, 1, 1))
    assert "GreaterThanOrEqual(offset,7)" in re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)


def test_profiles_read_no_payload(spark, tmp_path):
    text = plan(logs.log_bounds(stored_log(spark, tmp_path)))
    assert "ReadSchema: struct<topic:string,partition:int,offset:bigint>" in text


def test_frontier_needs_no_window_and_two_exchanges(spark):
    f = Fixtures(spark, SF)
    text = plan(W.frontier(f.log, f.log.where("event_id % 41 != 0")))
    assert "Window" not in text and "Join" not in text
    assert len(exchanges(text)) == 2
    assert text.count("partial_max") >= 2


def test_reconcile_has_one_large_exchange_and_combines_before_it(spark):
    f = Fixtures(spark, SF)
    cmp = R.compare_ids(R.expected_rows(f.ledger), f.sink)
    text = plan(cmp)
    assert exchanges(text) == ["hashpartitioning"] and "partial_sum" in text
    assert "Join" not in text


def test_samples_are_cut_before_the_shuffle(spark):
    f = Fixtures(spark, SF)
    text = plan(R.samples(R.compare_ids(R.expected_rows(f.ledger), f.sink)))
    assert re.search(r"WindowGroupLimit.*row_number\(\), 20, Partial", text)


def test_the_ledger_of_all_scenarios_is_not_multiplied(spark):
    f = Fixtures(spark, SF)
    specs = spark.createDataFrame([("x", "loss", False), ("y", "loss", False)], "scenario string, expect string, unique_required boolean")
    sinks = f.sink.withColumn("scenario", F.when(F.col("event_id") % 2 == 0, "x").otherwise("y"))
    text = plan(R.scenario_summary(f.ledger, sinks.select("scenario", "event_id", "sink_table"), specs))
    assert "BroadcastNestedLoopJoin" not in text or text.count("Generate") <= 1
    assert text.count("partial_count") >= 2


def test_plans_are_compared_in_one_pass_with_pinned_starts(spark):
    f = Fixtures(spark, SF)
    bounds = logs.pinned_bounds(f.log)
    plans = {spec: P.resume_plan(bounds, spec) for spec in ("earliest", "latest")}
    text = plan(P.compare_plans(plans, f.log, f.log.where("event_id % 41 != 0")))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert text.count("FileScan") == 2


def test_insert_reads_only_touched_folders(spark, tmp_path):
    rows = spark.range(100).selectExpr(
        "id AS event_id", "id AS produced_at", "'a' AS route", "'p' AS payload", "'t' AS src_topic",
        "0 AS src_part", "id AS src_offset", "current_timestamp() AS inserted_at", "'t_a' AS sink_table",
    )
    path = f"{tmp_path}/t"
    K.insert_if_absent(rows, path, width=10)
    text = plan(K.unstored_rows(rows.where("event_id BETWEEN 35 AND 47"), path, "next", 0, 10))
    # Only the key index is read, and of it the folders that the batch touches, found while it runs.
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and f"{path}-keys" in line]
    assert scans and all("dynamicpruning" in line for line in scans)
    assert f"{path}/" not in text.replace(f"{path}-", "")
    K.insert_if_absent(rows.where("event_id BETWEEN 35 AND 47"), path, width=10)
    assert K.read_inserted(spark, path).count() == 100


def test_sink_scan_prunes_folders_and_columns(spark, tmp_path):
    path = f"{tmp_path}/sink"
    Fixtures(spark, SF).sink.write.partitionBy("sink_table").parquet(path)
    text = plan(tables.read_sink(spark, path, ["t_a"], ["event_id"]))
    assert "ReadSchema: struct<event_id:bigint>" in text
    assert re.search(r"PartitionFilters: \[.*sink_table", text)


def test_latest_version_keeps_one_row_per_key_before_the_shuffle(spark):
    from tidemark.operators.versions import latest_version

    text = plan(latest_version(Fixtures(spark, SF).clean_sink, ["event_id"], ["produced_at", "src_offset"]))
    assert re.search(r"WindowGroupLimit.*row_number\(\), 1, Partial", text)
