import pytest
from pyspark.sql import functions as F

from tidemark.fixtures import now
from tidemark.functions import rules, wire
from tidemark.schemas import SINK
from tidemark.streaming import compaction as C
from tidemark.streaming import sinks as K
from tidemark.streaming.places import read_table, work_dir
from tests.shapes import as_dict, log_frame, positions


def rows_of(spark, ids, table="t_a", part=0, payload="p"):
    data = [(i, i, "a", payload, "t", part, i, None, table) for i in ids]
    return spark.createDataFrame(data, SINK)


def stored_ids(spark, path):
    return sorted(r.event_id for r in spark.read.schema(SINK).parquet(path).collect())


def progress(spark, rows):
    return spark.createDataFrame(
        [("t", *r) for r in rows], "topic string, partition int, from_offset bigint, next_offset bigint"
    )


def inserted_ids(spark, path):
    return sorted(r.event_id for r in K.read_inserted(spark, path).collect())


def test_append_doubles_and_atomic_does_not(spark, tmp_path):
    rows = rows_of(spark, range(5))
    for _ in range(2):
        K.append_fanout(rows, f"{tmp_path}/a")
        K.write_batch_atomic(rows, f"{tmp_path}/b", "r", 0)
    assert len(stored_ids(spark, f"{tmp_path}/a")) == 10
    assert stored_ids(spark, f"{tmp_path}/b") == [0, 1, 2, 3, 4]
    # A replay with fewer tables leaves nothing of the first attempt behind.
    K.write_batch_atomic(rows_of(spark, [9], "t_b"), f"{tmp_path}/b", "r", 0)
    assert stored_ids(spark, f"{tmp_path}/b") == [9]
    # A new checkpoint counts from zero again without touching the old run.
    K.write_batch_atomic(rows, f"{tmp_path}/b", "s", 0)
    assert len(stored_ids(spark, f"{tmp_path}/b")) == 6


def test_insert_if_absent_across_ranges(spark, tmp_path):
    path = f"{tmp_path}/t"
    K.insert_if_absent(rows_of(spark, range(0, 20)), path, width=8)
    K.insert_if_absent(rows_of(spark, [*range(10, 30), 25, 25], payload="later"), path, width=8)
    K.insert_if_absent(rows_of(spark, [5], table="t_b"), path, width=8)
    K.insert_if_absent(rows_of(spark, []), path, width=8)
    assert inserted_ids(spark, path) == sorted([*range(30), 5])
    first = K.read_inserted(spark, path).where("event_id = 15").first()
    assert first.payload == "p"


def test_insert_keeps_the_first_copy_of_a_hot_id(spark, tmp_path):
    hot = spark.range(5000).selectExpr(
        "7L AS event_id", "id AS produced_at", "'a' AS route", "cast(id AS string) AS payload",
        "'t' AS src_topic", "0 AS src_part", "5000 - id AS src_offset", "current_timestamp() AS inserted_at",
        "'t_a' AS sink_table",
    )
    K.insert_if_absent(hot, f"{tmp_path}/t")
    row = K.read_inserted(spark, f"{tmp_path}/t").collect()
    assert [(r.event_id, r.src_offset) for r in row] == [(7, 1)]


def test_progress_statuses(spark):
    batch = positions(
        spark,
        [(0, o) for o in range(10, 15)]
        + [(1, o) for o in range(10, 15)] * 2
        + [(2, o) for o in range(10, 15)]
        + [(3, 10), (3, 12)]
        + [(4, o) for o in range(10, 15)]
        + [(5, 10)]
        + [(6, o) for o in range(10, 15)],
    )
    stored = progress(spark, [(0, 0, 10), (1, 0, 12), (2, 0, 8), (3, 0, 10), (5, 0, 40), (6, 12, 15)])
    checked = K.check_progress(batch, stored)
    cols = ["status", "from_offset", "new_next", "records"]
    assert as_dict(checked, "partition", cols) == {
        0: ("ok", 0, 15, 5),
        1: ("overlap", 0, 15, 10),
        2: ("gap", 0, 15, 5),
        3: ("gap", 0, 13, 2),
        4: ("first", 10, 15, 5),
        5: ("replayed", 0, 40, 1),
        6: ("early", 10, 15, 5),
    }
    with pytest.raises(K.OffsetGap, match="t-"):
        K.guard(checked)
    fine = checked.where("status NOT IN ('gap', 'early')")
    assert K.guard(fine) == {("t", 1): 12, ("t", 5): 40}
    fresh = K.new_suffix(batch.where("partition IN (1, 5)"), K.guard(fine))
    assert sorted({(r.partition, r.offset) for r in fresh.collect()}) == [(1, 12), (1, 13), (1, 14)]
    lenient = as_dict(K.check_progress(batch, stored, gaps_allowed=True), "partition", "status")
    assert lenient[3] == "ok" and lenient[2] == "gap"


def test_progress_carries_idle_partitions(spark):
    stored = progress(spark, [(0, 0, 5), (1, 0, 7)]).selectExpr(
        "'j' AS job", "topic", "partition", "from_offset", "next_offset", "1L AS rows_written",
        "4L AS version", "timestamp_millis(0) AS updated_at",
    )
    checked = K.check_progress(positions(spark, [(0, 5), (0, 6)]), stored)
    rows = K.progress_rows(checked, stored, "j", now())
    assert as_dict(rows, "partition", ["next_offset", "version"]) == {0: (7, 5), 1: (7, 4)}


def test_rejects_keep_text_and_can_be_repaired(spark, tmp_path):
    lines = [(0, 0, 0, "10\t1\ta\tx\ty"), (0, 1, 0, "bad\t1\ta\tx"), (0, 2, 0, "11\t1\tb\tx"), (0, 3, 0, None)]
    judged = rules.dispose(wire.decode(log_frame(spark, lines)), rules.every_nth_is_bad(10))
    bad = K.split_rejects(judged, "j", now())
    assert as_dict(bad, "offset", ["event_id", "reason", "payload"]) == {
        0: ("10", "poison", "10\t1\ta\tx\ty"),
        1: (None, "event_id", "bad\t1\ta\tx"),
    }
    again = K.repair_rejects(bad, rules=[])
    assert as_dict(again, "offset", "disposition") == {0: "delivered", 1: "malformed"}
    for _ in range(2):
        K.insert_if_absent(K.delivered_rows(again), f"{tmp_path}/t")
    row = K.read_inserted(spark, f"{tmp_path}/t").collect()
    assert [(r.event_id, r.src_offset) for r in row] == [(10, 0)]


@pytest.mark.parametrize("bucket", [1, 7, 1 << 18])
def test_next_topic_is_dense_and_in_source_order(spark, bucket):
    log = positions(spark, [(p, o) for p in range(3) for o in range(40)])
    events = log.withColumn("event_id", F.col("offset") * 3 + F.col("partition"))
    ends = spark.createDataFrame([(0, 5)], "partition int, end bigint")
    placed = K.place_in_topic(events, "u", 2, ends, bucket=bucket)
    by_part = {}
    for r in placed.collect():
        by_part.setdefault(r.partition, []).append((r.offset, r.event_id))
    assert sum(map(len, by_part.values())) == 120
    for partition, rows in by_part.items():
        start = 5 if partition == 0 else 0
        rows.sort()
        assert [o for o, _ in rows] == list(range(start, start + len(rows)))
        source = [(e % 3, e // 3) for _, e in rows]
        assert source == sorted(source)


def test_backfill_overlap_is_absorbed(spark, tmp_path):
    old, new = f"{tmp_path}/old", f"{tmp_path}/new"
    K.append_fanout(rows_of(spark, range(5)), old)
    K.dual_write(rows_of(spark, range(5, 9)), old, new)
    K.backfill(spark, old, new)
    both = read_table(spark, new, SINK)
    assert both.count() == 13
    assert sorted(r.event_id for r in K.current_rows(both).collect()) == list(range(9))


def test_work_dir_prefers_the_shared_folder(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    try:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path))
    except Exception:
        # A static setting; then the session's own value must be in use.
        assert before is None or work_dir(spark, "x").startswith(before)
        return
    try:
        assert work_dir(spark, "x").startswith(f"{tmp_path}/x-")
    finally:
        if before is None:
            spark.conf.unset("spark.checkpoint.dir")
        else:
            spark.conf.set("spark.checkpoint.dir", before)


def test_jdbc_writer_stages_and_moves_each_table(spark, tmp_path):
    from tidemark.streaming import jdbc

    done, saved = [], []

    def save(rows, options):
        saved.append((options["dbtable"], sorted((r.event_id, r.run, r.batch_id) for r in rows.collect())))

    write = jdbc.batch_writer("jdbc:x", ["t_a", "t_b"], done.extend, f"{tmp_path}/owners", "it's", save)
    write(rows_of(spark, [1, 2]).unionByName(rows_of(spark, [3], "t_b")), 4)
    assert saved == [("t_a_staging", [(1, "it's", 4), (2, "it's", 4)]), ("t_b_staging", [(3, "it's", 4)])]
    assert [s.split(" WHERE ")[0].split(" (")[0] for s in done] == [
        "DELETE FROM t_a_staging", "DELETE FROM t_b_staging", "INSERT INTO t_a", "INSERT INTO t_b",
        "DELETE FROM t_a_staging", "DELETE FROM t_b_staging",
    ]
    assert all("run = 'it''s' AND batch_id = 4" in s for s in done)
    assert done[2].endswith("ON CONFLICT (event_id) DO NOTHING")
    options = jdbc.write_options("jdbc:x", "t", parts=3)
    assert (options["numPartitions"], options["dbtable"]) == ("3", "t")


def test_jdbc_rows_and_progress_move_together(spark, tmp_path):
    """The statements run in this process's own DuckDB."""
    import duckdb

    from tidemark.streaming import jdbc

    db = duckdb.connect()
    columns = "event_id BIGINT, produced_at BIGINT, route VARCHAR, payload VARCHAR, src_topic VARCHAR, src_part INT, src_offset BIGINT, inserted_at TIMESTAMP"
    db.sql(f"CREATE TABLE t_a ({columns}, UNIQUE (event_id))")
    db.sql(f"CREATE TABLE t_a_staging ({columns}, run VARCHAR, batch_id BIGINT)")
    db.sql(f"CREATE TABLE {jdbc.PROGRESS_TABLE} (job VARCHAR, topic VARCHAR, part INT, next_offset BIGINT, PRIMARY KEY (job, topic, part))")

    def transact(statements):
        db.execute("BEGIN")
        try:
            for statement in statements:
                if statement.startswith("SELECT 1 / "):  # division by zero is null here, an error in other databases
                    assert db.execute(statement).fetchone()[0] == 1.0, "progress"
                else:
                    db.execute(statement)
            db.execute("COMMIT")
        except BaseException:
            db.execute("ROLLBACK")
            raise

    def save(rows, options):
        data = [tuple(r) for r in rows.collect()]
        if data:
            db.executemany(f"INSERT INTO {options['dbtable']} VALUES ({', '.join('?' * len(rows.columns))})", data)

    write = jdbc.batch_writer("jdbc:x", ["t_a"], transact, f"{tmp_path}/owners", "r", save, job="j")
    at = lambda low, high: positions(spark, [(0, o) for o in range(low, high)])
    stored = lambda: (db.execute("SELECT count(*) FROM t_a").fetchone()[0], db.execute(f"SELECT next_offset FROM {jdbc.PROGRESS_TABLE}").fetchone()[0])
    write(rows_of(spark, range(5)), 0, at(0, 10))
    assert stored() == (5, 10)
    write(rows_of(spark, range(3, 8)), 1, at(8, 12))
    assert stored() == (8, 12)
    with pytest.raises(AssertionError, match="progress"):
        write(rows_of(spark, range(20, 25)), 2, at(15, 20))
    assert stored() == (8, 12)
    write(rows_of(spark, range(20, 25)), 2, at(12, 20))
    assert stored() == (13, 20) and db.execute("SELECT count(*) FROM t_a_staging").fetchone()[0] == 0
    assert "job = 'j'" in jdbc.position_options("jdbc:x", "j", "t")["query"]


def test_versions_are_compacted_behind_a_snapshot(spark, tmp_path):
    table = K.version_table(f"{tmp_path}/t", width=8)
    rows = lambda ids, at, name="t_a": rows_of(spark, ids, name).withColumn("produced_at", F.lit(at).cast("long"))
    current = lambda: sorted((r.event_id, r.sink_table, r.produced_at) for r in C.read_current(spark, table).collect())
    K.add_versions(rows(range(20), 1), table.path, "r", 0)
    K.add_versions(rows(range(5), 2), table.path, "r", 1)
    before = current()
    assert before == [(i, "t_a", 2 if i < 5 else 1) for i in range(20)]
    assert C.compact(spark, table) == 1 and current() == before
    assert C.compact(spark, table) == 1  # nothing new
    cells = {r["cell_id_range"]: r["cell_version"] for r in C.newest_snapshot(spark, table)[1].where("run IS NULL").collect()}
    # A crash before the snapshot changes nothing; the next compaction starts anew.
    K.add_versions(rows([4, 5, 30], 3), table.path, "s", 0)
    K.add_versions(rows([1], 9, "t_b"), table.path, "s", 1)
    now_held = current()
    assert len(now_held) == 22 and (4, "t_a", 3) in now_held

    def crash():
        raise RuntimeError("lost before the snapshot")

    with pytest.raises(RuntimeError):
        C.compact(spark, table, before_snapshot=crash)
    assert current() == now_held and C.newest_snapshot(spark, table)[0] == 1
    assert C.compact(spark, table) == 2 and current() == now_held
    # Only touched cells were rewritten.
    after = {(r["cell_sink_table"], r["cell_id_range"]): r["cell_version"] for r in C.newest_snapshot(spark, table)[1].where("run IS NULL").collect()}
    assert after["t_a", "1"] == cells["1"] and after["t_a", "0"] != cells["0"] and ("t_b", "0") in after
    # A writer may add beside a compaction: what finishes meanwhile stays in its attempt.
    K.add_versions(rows([41], 1), table.path, "s", 2)
    added = lambda: K.add_versions(rows([42], 1), table.path, "late", 0)
    assert C.compact(spark, table, before_snapshot=added) == 3
    assert {41, 42} <= {i for i, _, _ in current()}
    held = current()
    # Sweeping keeps what counts, and the number of folders no longer grows with the attempts.
    assert C.sweep(spark, table) > 0 and current() == held
    for number in range(3):
        K.add_versions(rows([50 + number], 1), table.path, "more", number)
        C.compact(spark, table)
        C.sweep(spark, table)
    folders = lambda p: sum(1 for _ in tmp_path.glob(p))
    assert folders("t/run=*/batch_id=*") <= 1 and folders("t-snapshots/snapshot=*") == 1
    assert {50, 51, 52} <= {i for i, _, _ in current()} and set(held) <= set(current())


def test_a_compacted_key_index_still_refuses_what_is_stored(spark, tmp_path):
    path = f"{tmp_path}/t"
    K.insert_if_absent(rows_of(spark, range(-3, 20)), path, width=8192)
    K.insert_if_absent(rows_of(spark, range(10, 40_000, 7)), path, width=8192)
    once = sorted({*range(-3, 20), *range(10, 40_000, 7)})
    assert inserted_ids(spark, path) == once
    K.compact_inserted(spark, path)
    K.insert_if_absent(rows_of(spark, [*range(30), *range(10, 40_000, 7), 5, 39_999]), path, width=8192)
    assert inserted_ids(spark, path) == sorted({*once, *range(30), 39_999})


def test_an_insert_written_again_replaces_itself(spark, tmp_path):
    path = f"{tmp_path}/t"
    for ids in (range(10), range(10)):
        K.insert_if_absent(rows_of(spark, ids), path, "r", 0, width=8)
    K.insert_if_absent(rows_of(spark, range(5, 15)), path, "r", 1, width=8)
    assert inserted_ids(spark, path) == list(range(15))
    # An insert that died before its commit is not read, and does not hold its ids.
    K.unstored_rows(rows_of(spark, [99]), path, "dead", 0, 8).write.partitionBy(*K.LAYOUT).parquet(K.attempt_path(path, "dead", 0))
    assert inserted_ids(spark, path) == list(range(15))
    K.insert_if_absent(rows_of(spark, [99]), path, width=8)
    assert inserted_ids(spark, path) == [*range(15), 99]


def test_both_tables_of_a_dual_write_hold_the_same(spark, tmp_path):
    rows = rows_of(spark, range(50)).withColumn("payload", F.uuid())
    K.dual_write(rows, f"{tmp_path}/old", f"{tmp_path}/new")
    old, new = (sorted(map(tuple, spark.read.schema(SINK).parquet(f"{tmp_path}/{n}").collect())) for n in ("old", "new"))
    assert old == new and len(old) == 50


def test_offsets_of_a_batch_are_counted_exactly(spark):
    rows = [(0, o) for o in range(100_000) if o % 3] + [(0, 1)] * 50 + [(1, 7), (1, 7), (2, 0)]
    got = as_dict(K.batch_ranges(positions(spark, rows)), "partition", ["first_offset", "last_offset", "offsets", "records"])
    assert got == {0: (1, 99_998, 66_666, 66_716), 1: (7, 7, 1, 2), 2: (0, 0, 1, 1)}
