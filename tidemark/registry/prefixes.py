"""Frontiers, gaps, ranges and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.routes import map_routes
from tidemark.operators import frontier as W
from tidemark.operators import time_index as X
from tidemark.operators.reconcile import positions_of
from tidemark.operators.versions import latest_version as newest
from tidemark.registry.base import Fixtures, query
from tidemark.schemas import POSITION
from tidemark.sources.footers import pinned_footer_bounds, write_laid_out
from tidemark.sources.logs import pinned_bounds
from tidemark.sources.tables import commit_ranges
from tidemark.streaming.places import work_dir


def accounted(f: Fixtures) -> DataFrame:
    """Delivered and unrouted positions; every 41st routed record is outstanding."""
    stored = positions_of(f.clean_sink.where("event_id % 41 != 0")).select(*POSITION)
    return stored.unionByName(f.log.where("route = 'x'").select(*POSITION))


OPEN = """open_rows AS (SELECT * FROM clean WHERE event_id % 41 = 0)"""


@query(
    "frontier",
    """SELECT b.topic, b."partition", coalesce(min(o."offset"), b."end") AS next_offset,
      count(o."offset") AS outstanding, any_value(d.naive_next) AS naive_next
    FROM bounds b LEFT JOIN open_rows o USING (topic, "partition")
    JOIN (SELECT topic, "partition", max("offset") + 1 AS naive_next FROM log
          WHERE sink_table IS NULL OR event_id % 41 <> 0 GROUP BY ALL) d USING (topic, "partition")
    GROUP BY b.topic, b."partition", b."end" """,
    OPEN,
)
def frontier(f: Fixtures) -> DataFrame:
    return W.frontier(f.log, accounted(f), pinned_bounds(f.log))


@query(
    "frontier_from_ranges",
    """SELECT b.topic, b."partition", coalesce(min(o."offset"), b."end") AS next_offset,
      count(o."offset") AS outstanding, any_value(d.naive_next) AS naive_next
    FROM bounds b LEFT JOIN open_rows o USING (topic, "partition")
    JOIN (SELECT topic, "partition", max("offset") + 1 AS naive_next FROM log
          WHERE sink_table IS NULL OR event_id % 41 <> 0 GROUP BY ALL) d USING (topic, "partition")
    GROUP BY b.topic, b."partition", b."end" """,
    OPEN,
)
def frontier_from_ranges(f: Fixtures) -> DataFrame:
    """The same frontier from what batches committed: two halves of the log as interval sets, the second
    overlapping the first, merged as a store would."""
    done = accounted(f)
    cut = F.col("offset") % 200
    halves = [W.merge_ranges(W.runs(done.where(part)).drop("records")) for part in (cut < 120, cut >= 80)]
    return W.frontier_from_ranges(W.merge_ranges(halves[0].unionByName(halves[1])), pinned_bounds(f.log))


@query(
    "branch_frontier",
    """SELECT l.topic, l."partition", l.sink_table,
      coalesce(min(CASE WHEN h.event_id IS NULL THEN l."offset" END), any_value(b."end")) AS next_offset,
      count(*) - count(h.event_id) AS outstanding
    FROM clean l LEFT JOIN half h USING (event_id) JOIN bounds b ON b."partition" = l."partition"
    GROUP BY l.topic, l."partition", l.sink_table""",
)
def branch_frontier(f: Fixtures) -> DataFrame:
    return W.branch_frontier(map_routes(f.log), positions_of(f.half_starved_sink))


@query(
    "gap_ranges",
    """SELECT topic, "partition", min("offset") AS from_offset, max("offset") AS to_offset,
      count(*) AS "records"
    FROM (SELECT *, "offset" - row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") AS run
          FROM clean WHERE event_id NOT IN (SELECT event_id FROM half))
    GROUP BY topic, "partition", run""",
)
def gap_ranges(f: Fixtures) -> DataFrame:
    """What a starved branch and a whole unread tail leave open, as runs of offsets."""
    done = positions_of(f.half_starved_sink).select(*POSITION)
    unrouted = f.log.where("route = 'x'").select(*POSITION)
    return W.gap_ranges(f.log, done.unionByName(unrouted))


@query(
    "range_adjacency",
    """SELECT topic, "partition", f AS from_offset, t AS to_offset, copies, expected_from,
      CASE WHEN copies > 1 THEN 'overlap' WHEN expected_from IS NULL THEN 'first'
        WHEN f > expected_from THEN 'gap' WHEN f < expected_from THEN 'overlap' ELSE 'ok' END AS status
    FROM (SELECT *, max(t) OVER (PARTITION BY topic, "partition" ORDER BY f, t
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS expected_from
      FROM (SELECT topic, "partition", f, t, count(*) AS copies FROM flawed_ranges
            GROUP BY topic, "partition", f, t))""",
)
def range_adjacency(f: Fixtures) -> DataFrame:
    return W.range_adjacency(commit_ranges(f.commits("flawed")))


@query(
    "offsets_for_times",
    """SELECT topic, "partition", min("offset") FILTER (WHERE record_ts >= mid) AS first_offset
    FROM skewed, (SELECT min(produced_at) AS mid FROM log WHERE phase = 'during-outage')
    GROUP BY topic, "partition" """,
)
def offsets_for_times(f: Fixtures) -> DataFrame:
    return W.offsets_for_times(f.skewed_log, outage_start(f))


@query(
    "time_index_offsets",
    """SELECT topic, "partition", min("offset") FILTER (WHERE record_ts >= mid) AS first_offset
    FROM skewed, (SELECT min(produced_at) AS mid FROM log WHERE phase = 'during-outage')
    GROUP BY topic, "partition" """,
)
def time_index_offsets(f: Fixtures) -> DataFrame:
    """The same lookup through an index, merged from those of two parts of the log."""
    early = F.col("phase") == "before-outage"
    index = X.merge_index(*[X.build_index(f.skewed_log.where(part), block=256) for part in (early, ~early)])
    return X.offsets_for_times(f.skewed_log, index, outage_start(f))


@query("footer_bounds", 'SELECT topic, "partition", "begin", "end" FROM bounds')
def footer_bounds(f: Fixtures) -> DataFrame:
    """Bounds of a log in folders, from its files' footers."""
    path = f"{work_dir(f.spark, 'footers')}/log"
    for phase in ("before-outage", "during-outage", "after-restart"):
        write_laid_out(f.log.where(F.col("phase") == phase), path)
    return pinned_footer_bounds(f.spark, path)


def outage_start(f: Fixtures) -> int:
    """When the outage's first event was produced."""
    return f.ledger.where("phase = 'during-outage'").agg(F.min("produced_at")).first()[0]


@query(
    "latest_version",
    """SELECT event_id, arg_max(sink_table, v) AS sink_table, max(v) AS version FROM (
      SELECT event_id, sink_table, "offset" * 2 AS v FROM clean
      UNION ALL SELECT event_id, 't_moved', "offset" * 2 + 1 FROM clean WHERE event_id % 7 = 0
      UNION ALL SELECT event_id, 't_old', "offset" * 2 - 1 FROM clean WHERE event_id % 5 = 0)
    GROUP BY event_id""",
)
def latest_version(f: Fixtures) -> DataFrame:
    def at(rows: DataFrame, shift: int, table: str | None = None) -> DataFrame:
        return rows.select(
            "event_id",
            (F.lit(table) if table else F.col("sink_table")).alias("sink_table"),
            (F.col("src_offset") * 2 + shift).alias("version"),
        )

    rows = f.clean_sink
    every = (
        at(rows, 0)
        .unionByName(at(rows.where("event_id % 7 = 0"), 1, "t_moved"))
        .unionByName(at(rows.where("event_id % 5 = 0"), -1, "t_old"))
    )
    return newest(every, ["event_id"], ["version"])
