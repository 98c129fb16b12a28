import random
import time

import pytest
from pyspark.sql import functions as F

from tests.shapes import as_dict, log_frame, positions
from tests.test_streams import add
from tidemark.functions import wire
from tidemark.operators import history as H
from tidemark.operators import reconcile as R
from tidemark.operators import time_index as X
from tidemark.operators.health import stale_tables
from tidemark.sources import footers, logs
from tidemark.streaming import guards as G
from tidemark.streaming import pipelines as T
from tidemark.streaming import sinks as K


def test_keyed_state_judges_as_the_set_based_guard(spark, tmp_path):
    """Over batches and a restart: stored progress on one side, state on the other."""
    batches = [
        [(0, 5, 10), (1, 0, 4)], [(0, 10, 15), (1, 2, 6)], [(0, 16, 20), (1, 0, 3)], [(0, 15, 18), (0, 19, 20)], [(0, 15, 18), (2, 3, 4)],
        [(0, 2, 20)], [(1, 6, 8), (1, 6, 7)],
    ]
    covered, expected = {}, []
    for number, ranges in enumerate(batches):
        add(spark, f"{tmp_path}/log", ranges)
        with G.rocksdb_state(spark):
            stream = G.contiguity_stream(logs.topic_log(spark, f"{tmp_path}/log", streaming=True))
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out")
            query = query.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = positions(spark, [(p, o) for p, low, high in ranges for o in range(low, high)])
        stored = [("t", p, a, b) for p, (a, b) in covered.items()]
        stored = spark.createDataFrame(stored, "topic string, partition int, from_offset bigint, next_offset bigint")
        for r in K.check_progress(rows, stored).collect():
            expected.append(r.asDict())
            if r.status not in ("gap", "early"):
                covered[r.partition] = (r.from_offset, r.new_next)
    found = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    order = lambda rows: sorted((tuple(sorted(r.items())) for r in rows), key=str)
    assert order(found) == order(expected)
    assert {r["status"] for r in found} == {"first", "ok", "overlap", "gap", "early", "replayed"}


def test_silence_raises_alerts_without_new_data(spark, tmp_path):
    def arrive(table):
        spark.createDataFrame([(table,)], "sink_table string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    arrive("t_a")
    rows = spark.readStream.schema("sink_table string").parquet(f"{tmp_path}/in")
    with G.rocksdb_state(spark):
        alerts = G.silence_alerts(rows, "sink_table", ["t_a", "t_b"], 4_000)
        query = (
            alerts.writeStream.format("parquet").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
        )
    try:
        deadline = time.time() + 90
        found = []
        while time.time() < deadline and {r.name for r in found} != {"t_a", "t_b"}:
            time.sleep(0.5)
            found = spark.read.schema(G.ALERT).parquet(f"{tmp_path}/out").collect()
    finally:
        query.stop()
    assert {r.name for r in found} == {"t_a", "t_b"}
    first = {r.name: r for r in sorted(found, key=lambda r: -r.alert_ms)}
    assert first["t_b"].last_seen_ms is None
    assert first["t_a"].alert_ms - first["t_a"].last_seen_ms >= 4_000
    # The batch check says the same of that moment.
    seen = spark.createDataFrame([("t_a", first["t_a"].last_seen_ms)], "sink_table string, ms bigint")
    seen = seen.select("sink_table", F.timestamp_millis("ms").alias("inserted_at"))
    moment = spark.sql(f"SELECT timestamp_millis({first['t_a'].alert_ms + 60_000})").first()[0]
    assert as_dict(stale_tables(seen, ["t_a", "t_b"], moment, 1), "sink_table", "stale") == {"t_a": True, "t_b": True}


@pytest.mark.parametrize("seed", range(3))
def test_time_index_equals_the_full_scan(spark, seed, tmp_path):
    rng = random.Random(seed)
    rows = [(p, o, 1000 + 10 * o + rng.choice([0, 0, 0, -900, 700]), None) for p in range(2) for o in range(3, 120)]
    log = log_frame(spark, rows).cache()
    half = F.col("offset") < 50
    index = X.merge_index(*[X.build_index(log.where(part), block=16) for part in (half, ~half)]).cache()
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, X.build_index(log, block=16).collect()))
    for lo, hi in ((0, 10_000), (1200, 1500), (2100, 2101), (5000, 6000), (rng.randint(900, 2300), 2300)):
        at = as_dict(X.offsets_for_times(log, index, lo), "partition", "first_offset")
        assert at == {p: min((o for q, o, t, _ in rows if q == p and t >= lo), default=None) for p in range(2)}
        found, slow = (sorted(map(tuple, d.collect())) for d in (X.interval_miss(log, index, lo, hi), H.interval_miss(log, lo, hi)))
        assert found == slow


def test_lookups_by_index_read_few_records(spark, tmp_path):
    log = spark.range(200_000).selectExpr(
        "'t' AS topic", "0 AS partition", "id AS offset", "id * 10 AS record_ts", "cast(null AS binary) AS key", "cast(null AS binary) AS value"
    )
    log.sort("offset").write.option("parquet.block.size", 64 * 1024).parquet(f"{tmp_path}/log")
    log = logs.topic_log(spark, f"{tmp_path}/log")
    index = X.build_index(log, block=1024).cache()
    found = X.offsets_for_times(log, index, 1_234_567)
    assert as_dict(found, "partition", "first_offset") == {0: 123_457}
    assert "GreaterThanOrEqual(offset,122880)" in found._jdf.queryExecution().toString()


def test_footers_give_the_bounds_of_the_rows(spark, tmp_path):
    path = f"{tmp_path}/log"
    for ranges in ([(0, 5, 20), (2, 0, 3)], [(0, 20, 31), (1, 7, 8)]):
        rows = [(p, o, 1000 + o, f"{o}\t{o}\ta\tx") for p, low, high in ranges for o in range(low, high)]
        footers.write_laid_out(log_frame(spark, rows).withColumn("key", F.lit(None).cast("binary")), path)
    log = spark.read.schema(footers.LAID_OUT).parquet(path)
    bounds = footers.pinned_footer_bounds(spark, path)
    assert sorted(map(tuple, bounds.collect())) == sorted(map(tuple, logs.pinned_bounds(log).collect()))
    profile = footers.footer_profile(spark, path)
    plan = profile._jdf.queryExecution().toString()
    assert "PushedAggregation: [MIN(offset), MAX(offset), COUNT(*), MIN(record_ts), MAX(record_ts)]" in plan
    assert as_dict(profile, "partition", ["records", "min_ts", "max_ts"])[0] == (26, 1005, 1030)
    assert wire.events_only(wire.decode(log)).count() == 30


def test_limited_runs_cut_by_offset_and_go_on(spark, tmp_path):
    add(spark, f"{tmp_path}/log", [(0, 3, 28), (1, 0, 4)])
    log = logs.topic_log(spark, f"{tmp_path}/log")
    crashes = []

    def crash_once(batch_id):
        if batch_id == 1 and not crashes:
            crashes.append(batch_id)
            raise RuntimeError("stopped")

    delivery = T.Delivery(T.Store(f"{tmp_path}/s"), before_progress=crash_once)
    with pytest.raises(RuntimeError):
        T.run_limited(log, delivery, "limited", 10)
    add(spark, f"{tmp_path}/log", [(1, 4, 6)])
    log = logs.topic_log(spark, f"{tmp_path}/log")
    assert T.run_limited(log, delivery, "limited", 10) == 3  # the open batch keeps its ranges
    store = delivery.store
    assert sorted(r.event_id for r in store.read_data(spark).collect()) == [*range(3, 28), *range(1000, 1006)]
    assert as_dict(store.read_progress(spark), "partition", ["from_offset", "next_offset"]) == {0: (3, 28), 1: (0, 6)}
    assert T.run_limited(log, delivery, "limited", 10) == 3
    sizes = store.read_audit(spark).select("written_rows").collect()
    assert max(r.written_rows for r in sizes) == 10


def test_lineage_names_repeats_by_source_position(spark, tmp_path):
    add(spark, f"{tmp_path}/log", [(0, 0, 10), (1, 0, 5)])
    router = T.Router(f"{tmp_path}/t2", partitions=2)
    log = logs.topic_log(spark, f"{tmp_path}/log", streaming=True)
    T.run_router(log, router, f"{tmp_path}/c1").awaitTermination()
    add(spark, f"{tmp_path}/log", [(0, 10, 12)])
    T.run_router(log, router, f"{tmp_path}/c2").awaitTermination()
    found = R.hop_lineage(router.read_lineage(spark)).collect()
    assert {(r.src_part, r.src_offset): r.copies for r in found} == {
        **{(0, o): 2 for o in range(10)}, **{(1, o): 2 for o in range(5)}, (0, 10): 1, (0, 11): 1
    }


def test_sketches_merge(spark):
    rows = spark.range(30_000).selectExpr(
        "id % 20000 AS event_id", "'t_a' AS sink_table", "timestamp_millis(id * 1000) AS inserted_at"
    )
    parts = [R.distinct_sketches(rows.where(f"event_id % 3 = {k}")) for k in range(3)]
    found = R.dup_ratio_sketched(parts[0].unionByName(parts[1]).unionByName(parts[2])).first()
    assert found.rows == 30_000 and abs(found.distinct_ids / 20_000 - 1) < 0.04
    assert R.dup_ratio_sketched(parts[0], F.timestamp_millis(F.lit(10**12))).count() == 0
