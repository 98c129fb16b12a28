"""The failure scenarios that have an exact outcome, each run by jobs that write tables.

All scenarios live through one outage of one topic log. Jobs follow the log up to the outage and stop;
the log grows; each scenario resolves, from what its first job stored, where a second job on a new
checkpoint starts; the log grows again, and the second job reads to its end. Nothing states a
scenario's outcome: ``reconcile.scenario_summary`` counts it in the tables that were written.

Jobs that wait for the same part of the log run side by side. Scenarios whose first job is the same share
its store and read it beside their own; a scenario whose second job must see the first one's rows
(insert-if-absent) has both in one store.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.rules import Rule, every_nth_is_bad
from tidemark.functions.wire import decode, events_only
from tidemark.functions.routes import map_routes
from tidemark.operators.frontier import branch_frontier
from tidemark.operators.reconcile import positions_of
from tidemark.plans.resume import resume_plan, start_vector
from tidemark.schemas import AFTER, BEFORE, DURING, PARTITION, SINK, TABLES, TOPIC_LOG
from tidemark.sources.logs import pinned_bounds, stream_from, topic_log
from tidemark.sources.vectors import Vector
from tidemark.streaming import pipelines as T
from tidemark.streaming.sinks import delivered_rows, insert_if_absent, repair_rejects

JOB = "writer"
EARLY, STARVED, JUDGED = "early", "starved", "judged"
#: Small driver-side jobs (plans, listings) at a time.
SIDE_BY_SIDE = 8


def without_table_b(rows: DataFrame) -> DataFrame:
    """A writer that loses the rows of one table without an error."""
    return rows.where("sink_table <> 't_b'")


@dataclass
class Outage:
    """A topic log in three parts, plain and with late record clocks, and the stores of its jobs."""

    root: str
    log: DataFrame
    skewed: DataFrame
    clock: Callable[[], Column] = F.current_timestamp
    running: list[StreamingQuery] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.log.sparkSession

    def path(self, skewed: bool) -> str:
        return f"{self.root}/{'skewed' if skewed else 'plain'}-log"

    def grow(self, phase: str) -> None:
        """Appends the records of a phase to both logs."""
        for skewed, log in ((False, self.log), (True, self.skewed)):
            part = log.where(F.col("phase") == phase).select(*TOPIC_LOG.names)
            part.write.mode("append").parquet(self.path(skewed))

    def topic(self, skewed: bool = False, streaming: bool = False) -> DataFrame:
        return topic_log(self.spark, self.path(skewed), streaming)

    def store(self, name: str) -> T.Store:
        return T.Store(f"{self.root}/{name}", JOB)

    def follow(self, name: str, checkpoint: str, starts: Vector | None = None, skewed: bool = False, **how) -> None:
        """Starts a job that delivers what the log holds; ``wait`` for its end."""
        log = self.topic(skewed, streaming=True)
        delivery = T.Delivery(self.store(name), clock=self.clock, **how)
        source = log if starts is None else stream_from(log, starts)
        self.running.append(T.run_direct(source, delivery, f"{self.root}/{name}/{checkpoint}"))

    def wait(self) -> None:
        for query in self.running:
            query.awaitTermination()
        self.running.clear()

    @cached_property
    def stopped(self) -> DataFrame:
        """The log's bounds when the first jobs stop; asked for before the log grows."""
        return pinned_bounds(self.topic())

    @cached_property
    def found(self) -> DataFrame:
        """The log's bounds when the second jobs start, before it grows further."""
        return pinned_bounds(self.topic())

    @cached_property
    def commits(self) -> DataFrame:
        """The consumer group's commits at the stop: what the first job stored as its progress."""
        return self.store(EARLY).read_progress(self.spark).select(
            *PARTITION, F.col("next_offset").alias("current_offset")
        )

    @cached_property
    def starved(self) -> DataFrame:
        return self.store(STARVED).read_data(self.spark)

    @cached_property
    def maxima(self) -> DataFrame:
        """Progress of the starved sink as a maximum per branch; the starved one has no row."""
        branches = positions_of(self.starved).groupBy(*PARTITION, "sink_table")
        return branches.agg(F.max("offset").alias("max_offset")).withColumn("job", F.lit(JOB))

    @cached_property
    def prefixes(self) -> DataFrame:
        """Progress of the starved sink as completed prefixes, where a branch wrote at all."""
        held = positions_of(self.starved)
        wrote = held.select(*PARTITION, "sink_table").distinct()
        own = map_routes(events_only(decode(self.topic())))
        return branch_frontier(own, held).join(wrote, [*PARTITION, "sink_table"], "left_semi")

    @cached_property
    def first_times(self) -> dict[str, int]:
        """The first producer clock of each phase."""
        rows = self.log.groupBy("phase").agg(F.min("produced_at").alias("at")).collect()
        return {row.phase: row["at"] for row in rows}

    def since(self, phase: str) -> str:
        return f"timestamp:{self.first_times[phase]}"


Plan = Callable[[Outage], DataFrame]


def plan(spec: str) -> Plan:
    return lambda o: resume_plan(o.found, spec)


def timed(phase: str, skewed: bool = False, **how) -> Plan:
    return lambda o: resume_plan(o.found, o.since(phase), log=o.topic(skewed), **how)


@dataclass(frozen=True)
class Scenario:
    """``first``: a first job's store that the scenario continues, or ``own`` for one in its own store.

    ``start`` plans where the second job begins; without it there is none. ``skewed``: the outage's record
    clocks run late. ``judged``: a rule refuses every tenth event. ``repaired``: what it refused is stored in
    the end, under a corrected rule.
    """

    name: str
    expect: str
    start: Plan | None
    first: str | None = None
    unique_required: bool = False
    skewed: bool = False
    repaired: bool = False
    mode: str = T.ATOMIC
    judged: bool = False

    def options(self) -> dict:
        # A replay into a store with progress is left to its sink.
        return {"mode": self.mode, "rules": poison() if self.judged else [], "guarded": self.first != "own"}


def poison() -> list[Rule]:
    """The rule of the judged scenarios: every tenth event cannot be written."""
    return every_nth_is_bad(10)


# Names, predictions and whether repeats break them.
SCENARIOS = [
    Scenario("S01", "no-loss", plan("earliest"), EARLY),
    Scenario("S02", "no-loss", lambda o: resume_plan(o.found, "committed-earliest", group_commits=o.commits), EARLY),
    Scenario("S03", "loss", plan("latest")),
    Scenario("S04", "loss", lambda o: resume_plan(
        o.stopped, "committed-latest", group_commits=o.commits.where("false"))),
    Scenario("S12", "loss", lambda o: resume_plan(o.found, "store-max:t_a", sink=o.starved), STARVED),
    Scenario("S13", "no-loss", lambda o: resume_plan(o.found, "store-frontier", progress=o.maxima, job=JOB), STARVED),
    Scenario("S13P", "no-loss", lambda o: resume_plan(
        o.found, "store-prefix", progress=o.prefixes, branches=TABLES), STARVED),
    Scenario("S15", "no-loss", plan("earliest"), "own", unique_required=True, mode=T.IF_ABSENT),
    Scenario("S21", "no-loss", timed(DURING), EARLY, unique_required=True),
    Scenario("S22", "loss", timed(AFTER, skewed=True, on_no_match="end"), EARLY, skewed=True),
    Scenario("S22E", "no-loss", timed(AFTER, skewed=True, on_no_match="earliest"), EARLY, skewed=True),
    Scenario("S23", "loss", None, JUDGED),
    Scenario("S24", "loss", plan("earliest"), "own", mode=T.IF_ABSENT, judged=True),
    Scenario("S24R", "no-loss", None, "own", unique_required=True, repaired=True, mode=T.IF_ABSENT, judged=True),
]


def specs(spark: SparkSession, scenarios: list[Scenario] = SCENARIOS) -> DataFrame:
    """(scenario, expect, unique_required)."""
    rows = [(s.name, s.expect, s.unique_required) for s in scenarios]
    return spark.createDataFrame(rows, "scenario string, expect string, unique_required boolean")


def live_through(outage: Outage, scenarios: list[Scenario] = SCENARIOS) -> None:
    """Runs the jobs of all scenarios; their rows are then in the stores."""
    own = [s for s in scenarios if s.first == "own"]
    outage.grow(BEFORE)
    outage.stopped.count()
    outage.follow(EARLY, "first")
    for s in own:
        outage.follow(s.name, "first", **s.options())
    outage.wait()

    outage.grow(DURING)
    outage.found.count()
    outage.follow(STARVED, "first", hook=without_table_b)
    outage.wait()
    # The inputs that several plans share are made before their jobs run side by side.
    for shared in ("commits", "maxima", "prefixes", "first_times"):
        getattr(outage, shared)
    planned = [s for s in scenarios if s.start is not None]
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        starts = dict(zip([s.name for s in planned], pool.map(lambda s: start_vector(s.start(outage)), planned)))

    outage.grow(AFTER)
    outage.follow(JUDGED, "first", rules=poison())
    for s in scenarios:
        if s.start is not None:
            outage.follow(s.name, "second", starts[s.name], s.skewed, **s.options())
        elif s.first == "own":  # it goes on where it stopped
            outage.follow(s.name, "first", **s.options())
    outage.wait()
    for s in scenarios:
        if s.repaired:
            store = outage.store(s.name)
            fixed = repair_rejects(store.read_rejects(outage.spark), rules=[])
            insert_if_absent(delivered_rows(fixed, outage.clock()), store.data(T.IF_ABSENT))


def sinks(outage: Outage, scenarios: list[Scenario] = SCENARIOS) -> DataFrame:
    """The stored rows of each scenario, tagged with its name; run ``live_through`` first."""
    tagged = []
    shared = {s.first for s in scenarios} - {None, "own"}
    for name in sorted(shared):
        users = [s.name for s in scenarios if s.first == name]
        tagged.append((outage.store(name), F.explode(F.lit(users))))
    tagged += [(outage.store(s.name), F.lit(s.name)) for s in scenarios if s.first == "own" or s.start is not None]
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        rows = list(pool.map(lambda pair: pair[0].read_data(outage.spark), tagged))
    stored = [r.select(who.alias("scenario"), *SINK.names) for r, (_, who) in zip(rows, tagged)]
    return reduce(DataFrame.unionByName, stored)
