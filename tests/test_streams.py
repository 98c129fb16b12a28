import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, wire
from tidemark.operators.frontier import range_adjacency
from tidemark.operators.health import progress_crosscheck
from tidemark.operators.reconcile import balance, positions_of
from tidemark.plans import resume as P
from tidemark.schemas import TOPIC_LOG
from tidemark.sources import logs, tables
from tidemark.streaming import pipelines as T
from tidemark.streaming import sinks
from tests.shapes import as_dict, log_frame


def add(spark, path, ranges, route="a"):
    """Appends one file of records; ids say partition * 1000 + offset."""
    rows = [(p, o, 1000 + o, f"{p * 1000 + o}\t{o}\t{route}\tx") for p, lo, hi in ranges for o in range(lo, hi)]
    log = log_frame(spark, rows).withColumn("key", F.lit(None).cast("binary"))
    log.select(*TOPIC_LOG.names).coalesce(1).write.mode("append").parquet(path)


def start(spark, path, delivery, checkpoint, **options):
    log = logs.topic_log(spark, path, streaming=True, **options)
    query = T.run_direct(log, delivery, checkpoint)
    query.awaitTermination()
    return query


def ids(spark, store):
    return sorted(r.event_id for r in store.read_data(spark).collect())


@pytest.fixture
def place(tmp_path):
    return str(tmp_path)


def test_restart_on_its_checkpoint(spark, place):
    delivery = T.Delivery(T.Store(f"{place}/s"), rules=rules.every_nth_is_bad(10))
    add(spark, f"{place}/log", [(0, 0, 15), (1, 0, 5)])
    start(spark, f"{place}/log", delivery, f"{place}/c")
    add(spark, f"{place}/log", [(0, 15, 25)])
    # Partition 2 shows up later and is read from its beginning.
    add(spark, f"{place}/log", [(2, 0, 4)])
    start(spark, f"{place}/log", delivery, f"{place}/c")
    everything = [*range(25), *range(1000, 1005), *range(2000, 2004)]
    assert ids(spark, delivery.store) == [i for i in everything if i % 10]
    progress = delivery.store.read_progress(spark)
    assert as_dict(progress, "partition", ["from_offset", "next_offset"]) == {0: (0, 25), 1: (0, 5), 2: (0, 4)}
    log = logs.topic_log(spark, f"{place}/log")
    rejects = delivery.store.read_rejects(spark)
    books = balance(log, [("saved", positions_of(delivery.store.read_data(spark))), ("rejected", rejects)])
    assert all(r.balanced and r.outstanding == 0 for r in books.collect())
    ranges = tables.commit_ranges(delivery.store.read_audit(spark))
    assert {r.status for r in range_adjacency(ranges).collect()} <= {"first", "ok"}
    assert {r.status for r in progress_crosscheck(progress, ranges).collect()} == {"agree"}


@pytest.mark.parametrize("mode", [T.ATOMIC, T.IF_ABSENT])
def test_crash_between_data_and_progress_replays(spark, place, mode):
    crashes = []

    def crash_once(batch_id):
        if batch_id == 1 and not crashes:
            crashes.append(batch_id)
            raise RuntimeError("lost between data and progress")

    delivery = T.Delivery(T.Store(f"{place}/s"), mode=mode, before_progress=crash_once)
    add(spark, f"{place}/log", [(0, 0, 10)])
    start(spark, f"{place}/log", delivery, f"{place}/c")
    add(spark, f"{place}/log", [(0, 10, 20)])
    with pytest.raises(Exception, match="lost between"):
        start(spark, f"{place}/log", delivery, f"{place}/c")
    # Progress is behind the data, never ahead.
    assert as_dict(delivery.store.read_progress(spark), "partition", "next_offset") == {0: 10}
    # A batch that owns a folder shows once it is finished; inserted rows show at once.
    assert ids(spark, delivery.store) == list(range(10 if mode == T.ATOMIC else 20))
    start(spark, f"{place}/log", delivery, f"{place}/c")
    assert ids(spark, delivery.store) == list(range(20))
    assert as_dict(delivery.store.read_progress(spark), "partition", "next_offset") == {0: 20}


def test_failing_sink_fails_the_batch_and_replays(spark, place):
    broken = []

    def hook(rows):
        if not broken:
            broken.append(1)
            raise RuntimeError("sink is down")
        return rows

    delivery = T.Delivery(T.Store(f"{place}/s"), hook=hook)
    add(spark, f"{place}/log", [(0, 0, 10)])
    with pytest.raises(Exception, match="sink is down"):
        start(spark, f"{place}/log", delivery, f"{place}/c")
    assert ids(spark, delivery.store) == []
    start(spark, f"{place}/log", delivery, f"{place}/c")
    assert ids(spark, delivery.store) == list(range(10))


def test_gap_stops_the_job_before_it_writes(spark, place):
    delivery = T.Delivery(T.Store(f"{place}/s"))
    add(spark, f"{place}/log", [(0, 0, 10)])
    start(spark, f"{place}/log", delivery, f"{place}/c")
    add(spark, f"{place}/log", [(0, 12, 20)])
    with pytest.raises(Exception, match="expected 10 without a hole"):
        start(spark, f"{place}/log", delivery, f"{place}/c")
    assert ids(spark, delivery.store) == list(range(10))
    lenient = T.Delivery(T.Store(f"{place}/s2"), gaps_allowed=True)
    start(spark, f"{place}/log", lenient, f"{place}/c2")
    assert ids(spark, lenient.store) == [*range(10), *range(12, 20)]


def test_log_read_out_of_order_is_refused(spark, place):
    delivery = T.Delivery(T.Store(f"{place}/s"))
    add(spark, f"{place}/log", [(0, 50, 60)])
    start(spark, f"{place}/log", delivery, f"{place}/c")
    add(spark, f"{place}/log", [(0, 40, 50)])
    with pytest.raises(Exception, match="early"):
        start(spark, f"{place}/log", delivery, f"{place}/c")


@pytest.mark.parametrize("mode", [T.ATOMIC, T.IF_ABSENT])
def test_lost_checkpoint_resumes_from_the_store(spark, place, mode):
    store = T.Store(f"{place}/s")
    add(spark, f"{place}/log", [(0, 0, 10), (1, 0, 3)])
    start(spark, f"{place}/log", T.Delivery(store, mode=mode), f"{place}/c0")
    add(spark, f"{place}/log", [(0, 10, 20), (1, 3, 5), (2, 0, 2)])
    bounds = logs.log_bounds(logs.topic_log(spark, f"{place}/log"))
    plan = P.from_stored(bounds, store.read_progress(spark), "stored")
    vector = P.start_vector(plan, bounds)
    assert vector == {("t", 0): 10, ("t", 1): 3, ("t", 2): 0}
    log = logs.stream_from(logs.topic_log(spark, f"{place}/log", streaming=True), vector)
    T.run_direct(log, T.Delivery(store, mode=mode), f"{place}/c1").awaitTermination()
    everything = [*range(20), *range(1000, 1005), *range(2000, 2002)]
    assert ids(spark, store) == everything
    # A third run that rereads everything brings nothing new.
    start(spark, f"{place}/log", T.Delivery(store, mode=mode), f"{place}/c2")
    assert ids(spark, store) == everything


def test_plain_insert_doubles_what_it_rereads(spark, place):
    store = T.Store(f"{place}/s")
    add(spark, f"{place}/log", [(0, 0, 10)])
    for run in ("run-0", "run-1"):
        delivery = T.Delivery(store, mode=T.APPEND, run=run, guarded=False)
        start(spark, f"{place}/log", delivery, f"{place}/{run}")
    assert ids(spark, store) == sorted([*range(10)] * 2)


def test_small_batches_leave_no_tail(spark, place):
    for i in range(5):
        add(spark, f"{place}/log", [(0, i * 7, i * 7 + 7)])
    delivery = T.Delivery(T.Store(f"{place}/s"), mode=T.IF_ABSENT, guarded=False)
    query = start(spark, f"{place}/log", delivery, f"{place}/c", max_files_per_trigger=2)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    assert ids(spark, delivery.store) == list(range(35))


def test_two_hops_with_one_hop_replayed(spark, place):
    add(spark, f"{place}/log", [(0, 0, 10), (1, 0, 10)])
    router = T.Router(f"{place}/t2", partitions=2)
    delivery = T.Delivery(T.Store(f"{place}/s"))
    log = logs.topic_log(spark, f"{place}/log", streaming=True)
    with pytest.raises(ValueError):
        T.run_two_hop(log, router, delivery, (f"{place}/c", f"{place}/c"))
    T.run_two_hop(log, router, delivery, (f"{place}/c1", f"{place}/c2"))
    add(spark, f"{place}/log", [(0, 10, 15)])
    # The hop lost its checkpoint and sends everything again; the insert-if-absent sink holds.
    again = T.Router(f"{place}/t2", partitions=2)
    T.run_router(log, again, f"{place}/c3").awaitTermination()
    hop = router.read(spark)
    assert hop.count() == 20 + 25
    dense = hop.groupBy("partition").agg(F.count("*").alias("n"), (F.max("offset") + 1).alias("end"))
    assert all(r.n == r.end for r in dense.collect())
    absent = T.Delivery(T.Store(f"{place}/s2"), mode=T.IF_ABSENT)
    T.run_direct(router.read_stream(spark), absent, f"{place}/c4").awaitTermination()
    assert ids(spark, absent.store) == [*range(15), *range(1000, 1010)]
    # The first sink continues on its own checkpoint and stores the repeats.
    T.run_direct(router.read_stream(spark), delivery, f"{place}/c2").awaitTermination()
    assert len(ids(spark, delivery.store)) == 45


def test_dedup_within_a_stream(spark, place):
    add(spark, f"{place}/log", [(0, 0, 10)])
    add(spark, f"{place}/log", [(0, 5, 12)])
    log = logs.topic_log(spark, f"{place}/log", streaming=True)
    events = wire.events_only(wire.decode(log)).select("event_id", "record_ts")
    query = (
        T.dedup_stream(events, ["event_id"], "record_ts", "1 hour")
        .writeStream.format("parquet")
        .option("path", f"{place}/out")
        .option("checkpointLocation", f"{place}/c")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(f"{place}/out").collect())
    assert got == list(range(12))


def test_unknown_mode():
    with pytest.raises(ValueError):
        T.Delivery(T.Store("/nowhere"), mode="sometimes")


def test_a_named_run_belongs_to_its_first_checkpoint(spark, place):
    add(spark, f"{place}/log", [(0, 0, 10)])
    named = T.Delivery(T.Store(f"{place}/s"), run="nightly")
    start(spark, f"{place}/log", named, f"{place}/c0")
    add(spark, f"{place}/log", [(0, 10, 20)])
    start(spark, f"{place}/log", named, f"{place}/c0")
    with pytest.raises(Exception, match="belongs to checkpoint"):
        start(spark, f"{place}/log", named, f"{place}/c1")
    assert ids(spark, named.store) == list(range(20))
    hop = T.Router(f"{place}/t2", run="nightly")
    log = logs.topic_log(spark, f"{place}/log", streaming=True)
    T.run_router(log, hop, f"{place}/c2").awaitTermination()
    with pytest.raises(Exception, match="belongs to checkpoint"):
        T.run_router(log, hop, f"{place}/c3").awaitTermination()
    assert hop.read(spark).count() == 20


def test_one_store_may_change_its_way_of_writing(spark, place):
    store = T.Store(f"{place}/s")
    for number, mode in enumerate((T.ATOMIC, T.IF_ABSENT, T.APPEND)):
        add(spark, f"{place}/log-{number}", [(0, number * 10, number * 10 + 10)])
        start(spark, f"{place}/log-{number}", T.Delivery(store, mode=mode), f"{place}/c{number}")
    assert ids(spark, store) == list(range(30))


def test_an_unfinished_batch_is_not_read(spark, place):
    add(spark, f"{place}/log", [(0, 0, 10)])

    def crash(batch_id):
        raise RuntimeError("stopped between data and progress")

    store = T.Store(f"{place}/s")
    with pytest.raises(Exception, match="stopped between"):
        start(spark, f"{place}/log", T.Delivery(store, before_progress=crash), f"{place}/c")
    assert ids(spark, store) == []
    start(spark, f"{place}/log", T.Delivery(store), f"{place}/c")
    assert ids(spark, store) == list(range(10))


def test_stale_tables_reads_what_the_pipeline_stores(spark, place):
    from tidemark.operators.health import stale_tables

    add(spark, f"{place}/log", [(0, 0, 10)])
    store = T.Store(f"{place}/s")
    start(spark, f"{place}/log", T.Delivery(store, clock=lambda: F.timestamp_millis(F.lit(60_000))), f"{place}/c")
    stored = store.read_data(spark)
    tables = [r.sink_table for r in stored.select("sink_table").distinct().collect()]
    moment = spark.sql("SELECT timestamp_millis(360000)").first()[0]
    found = as_dict(stale_tables(stored, [*tables, "t_none"], moment, 4), "sink_table", ["age_ms", "stale"])
    assert found == {**dict.fromkeys(tables, (300_000, True)), "t_none": (None, True)}


def at(ms):
    return lambda: F.timestamp_millis(F.lit(ms))


def lines(spark, partition, low, high):
    rows = [(partition, o, 1000 + o, f"{partition * 1000 + o}\t{o}\ta\tx") for o in range(low, high)]
    return log_frame(spark, rows).withColumn("key", F.lit(None).cast("binary")).select(*TOPIC_LOG.names)


def test_batch_jobs_do_not_replace_each_other(spark, place):
    store = T.Store(f"{place}/s")
    with pytest.raises(sinks.RunTaken, match="needs a run"):
        T.Delivery(store).write(lines(spark, 0, 0, 100), 0)
    T.Delivery(store, run="one").write(lines(spark, 0, 0, 100), 0)
    with pytest.raises(sinks.RunTaken, match="is stored"):
        T.Delivery(store, run="one").write(lines(spark, 0, 100, 150), 0)
    assert ids(spark, store) == list(range(100))
    T.Delivery(store, run="two").write(lines(spark, 0, 100, 150), 0)
    T.Delivery(store, run="two").write(lines(spark, 0, 150, 160), 1)
    assert ids(spark, store) == list(range(160))
    assert as_dict(store.read_progress(spark), "partition", ["from_offset", "next_offset"]) == {0: (0, 160)}

    def crash(batch_id):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        T.Delivery(store, run="three", before_progress=crash).write(lines(spark, 0, 160, 170), 0)
    T.Delivery(store, run="three").write(lines(spark, 0, 160, 170), 0)  # an unfinished batch may be written again
    assert ids(spark, store) == list(range(170))
    hop = T.Router(f"{place}/t2", run="one")
    hop.write(lines(spark, 0, 0, 10), 0)
    with pytest.raises(sinks.RunTaken):
        hop.write(lines(spark, 0, 10, 20), 0)
    assert hop.read(spark).count() == 10


def test_a_batch_reads_its_records_once(spark, place, monkeypatch):
    """Counted by an accumulator that each record passes."""
    passed = spark.sparkContext.accumulator(0)

    def count(i):
        passed.add(1)
        return i

    counted = F.udf(count, "bigint").asNondeterministic()
    for mode in (T.ATOMIC, T.IF_ABSENT, T.APPEND):
        before = passed.value
        batch = lines(spark, 0, 0, 50).withColumn("offset", counted("offset")).select(*TOPIC_LOG.names)
        T.Delivery(T.Store(f"{place}/{mode}"), run="r", mode=mode, rules=rules.every_nth_is_bad(10)).write(batch, 0)
        assert passed.value - before == 50


@pytest.mark.parametrize("mode", [T.ATOMIC, T.IF_ABSENT, T.APPEND])
def test_a_hook_changes_rows_but_not_progress(spark, place, mode):
    store = T.Store(f"{place}/s")
    hook = lambda rows: rows.where("event_id % 2 = 0").withColumn("payload", F.lit("seen"))
    T.Delivery(store, run="r", mode=mode, hook=hook).write(lines(spark, 0, 0, 10), 0)
    assert {(r.event_id, r.payload) for r in store.read_data(spark).collect()} == {(i, "seen") for i in range(0, 10, 2)}
    assert as_dict(store.read_progress(spark), "partition", "next_offset") == {0: 10}


def test_a_store_is_compacted_while_its_job_goes_on(spark, place):
    delivery = T.Delivery(T.Store(f"{place}/s"), rules=rules.every_nth_is_bad(10), clock=at(60_000))
    store = delivery.store
    for number in range(3):
        add(spark, f"{place}/log", [(0, number * 10, number * 10 + 10)])
        start(spark, f"{place}/log", delivery, f"{place}/c")
    held, rejects, progress = ids(spark, store), store.read_rejects(spark).count(), store.read_progress(spark).collect()
    audit = store.read_audit(spark).count()
    store.compact(spark)
    assert store.sweep(spark) > 0
    assert (ids(spark, store), store.read_rejects(spark).count(), store.read_audit(spark).count()) == (held, rejects, audit)
    assert store.read_progress(spark).collect() == progress
    add(spark, f"{place}/log", [(0, 30, 40)])
    start(spark, f"{place}/log", delivery, f"{place}/c")
    assert ids(spark, store) == [i for i in range(40) if i % 10]
    # A new checkpoint resumes from what compaction left of progress.
    add(spark, f"{place}/log", [(0, 40, 45)])
    start(spark, f"{place}/log", T.Delivery(store), f"{place}/c2")
    assert ids(spark, store) == [*(i for i in range(40) if i % 10), *range(40, 45)]
    store.compact(spark)
    store.sweep(spark)
    assert as_dict(store.read_progress(spark), "partition", ["from_offset", "next_offset"]) == {0: (0, 45)}


def test_an_insert_store_is_compacted_too(spark, place):
    store = T.Store(f"{place}/s")
    for number in range(3):
        T.Delivery(store, run="r", mode=T.IF_ABSENT).write(lines(spark, 0, number * 10, number * 10 + 10), number)
    store.compact(spark)
    store.sweep(spark)
    assert ids(spark, store) == list(range(30))
    T.Delivery(store, run="again", mode=T.IF_ABSENT, guarded=False).write(lines(spark, 0, 5, 35), 0)
    assert ids(spark, store) == list(range(35))
