"""Start-position resolvers: one row per (topic, partition) with start and rule.

All joins here are between frames of one row per partition (or per partition and branch);
the large tables enter only through aggregates. ``compare_plans`` is the exception and says
how it scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.frontier import account, offsets_for_times
from tidemark.operators.reconcile import positions_of
from tidemark.schemas import PARTITION
from tidemark.sources.logs import log_bounds
from tidemark.sources.vectors import (
    ResumeError,
    Vector,
    collect_vector,
    offsets_json,
    pin_small,
    vector_frame,
)

NO_MATCH = ("error", "earliest", "end")


def from_bounds(bounds: DataFrame, spec: str) -> DataFrame:
    """``earliest`` or ``latest``. The latter skips whatever is waiting."""
    if spec == "earliest":
        return bounds.select(
            *PARTITION, F.col("begin").alias("start"), F.lit("begin").alias("rule"),
            F.lit(False).alias("skips_backlog"),
        )
    return bounds.select(
        *PARTITION, F.col("end").alias("start"), F.lit("end").alias("rule"),
        (F.col("end") > F.col("begin")).alias("skips_backlog"),
    )


def from_commits(bounds: DataFrame, group_commits: DataFrame, otherwise: str) -> DataFrame:
    """The group's commit, else ``earliest``, ``latest`` or ``none`` (an error row).

    A consumer treats a commit outside the retained log as absent. The plan does the same, under
    a rule of its own (``expired-commit:...``), which ``validate_plan`` flags: the records between
    the commit and the log's begin are gone.
    """
    commits = group_commits.select(*PARTITION, "current_offset")
    commit = F.col("current_offset")
    held = (commit >= F.col("begin")) & (commit <= F.col("end"))
    fallback = {
        "earliest": (F.col("begin"), "begin"),
        "latest": (F.col("end"), "end"),
        "none": (F.lit(None).cast("bigint"), "error"),
    }
    start, place = fallback[otherwise]
    absent = "error" if otherwise == "none" else f"no-commit:{place}"
    rule = F.when(held, "commit").when(commit.isNotNull(), f"expired-commit:{place}").otherwise(absent)
    skips = F.lit(otherwise == "latest") & (F.col("end") > F.col("begin"))
    return bounds.join(commits, PARTITION, "left").select(
        *PARTITION,
        F.when(held, commit).otherwise(start).alias("start"),
        rule.alias("rule"),
        (~F.coalesce(held, F.lit(False)) & skips).alias("skips_backlog"),
    )


def from_timestamp(
    bounds: DataFrame, log: DataFrame, at: int, on_no_match: str = "error", lead_ms: int = 0
) -> DataFrame:
    """First offset at or past ``at - lead_ms`` of the record clock.

    Where no record qualifies the policy decides: ``error`` (as Spark's Kafka source does),
    ``earliest``, or ``end``, which silently skips the partition's backlog.
    """
    if on_no_match not in NO_MATCH:
        raise ValueError(f"unknown policy {on_no_match!r}")
    looked_up = offsets_for_times(log, at - lead_ms)
    start = {"error": F.lit(None).cast("bigint"), "earliest": F.col("begin"), "end": F.col("end")}
    rule = {"error": "error", "earliest": "no-match:begin", "end": "no-match:end"}
    matched = F.col("first_offset").isNotNull()
    empty = F.col("begin") == F.col("end")
    return bounds.join(looked_up, PARTITION, "left").select(
        *PARTITION,
        F.when(matched, F.col("first_offset"))
        .when(empty, F.col("end"))
        .otherwise(start[on_no_match])
        .alias("start"),
        F.when(matched, "timestamp").when(empty, "empty").otherwise(rule[on_no_match]).alias("rule"),
        (~matched & ~empty & F.lit(on_no_match == "end")).alias("skips_backlog"),
    )


def from_stored(bounds: DataFrame, stored: DataFrame, rule: str) -> DataFrame:
    """A stored next_offset per partition; a partition without one starts at the
    beginning, never at the end. An expired position is kept for ``validate_plan`` to flag."""
    return bounds.join(stored.select(*PARTITION, "next_offset"), PARTITION, "left").select(
        *PARTITION,
        F.coalesce("next_offset", "begin").alias("start"),
        F.when(F.col("next_offset").isNull(), "no-row:begin").otherwise(rule).alias("rule"),
        F.lit(False).alias("skips_backlog"),
    )


def from_table_maximum(bounds: DataFrame, sink: DataFrame, table: str) -> DataFrame:
    """One past the greatest offset of one table. Loses what other tables, or earlier
    batches, still lack; for comparison only."""
    highest = (
        positions_of(sink.where(F.col("sink_table") == table))
        .groupBy(*PARTITION)
        .agg((F.max("offset") + 1).alias("next_offset"))
    )
    return from_stored(bounds, highest, "store-max")


def from_progress_maximum(bounds: DataFrame, progress: DataFrame, job: str) -> DataFrame:
    """Least of the branches' greatest offsets + 1, over branches that have a row.

    Loses the gaps a branch skipped and ignores a branch that never wrote; for comparison
    only. Unlike the bare query it is named after, it keeps topics apart.
    """
    lowest = (
        progress.where(F.col("job") == job)
        .groupBy(*PARTITION)
        .agg((F.min("max_offset") + 1).alias("next_offset"))
    )
    return from_stored(bounds, lowest, "store-frontier")


def from_prefix(
    bounds: DataFrame, branch_progress: DataFrame, branches: list[str]
) -> DataFrame:
    """Least completed prefix over the *expected* branches of each partition.

    ``branch_progress`` is (topic, partition, sink_table, next_offset) where next_offset was
    advanced contiguously (``branch_frontier`` or guarded progress rows). A branch without a
    row has completed nothing, so it holds its partition at the beginning.
    """
    wanted = bounds.withColumn("sink_table", F.explode(F.lit(branches)))
    reached = branch_progress.select(*PARTITION, "sink_table", "next_offset")
    per_branch = wanted.join(reached, [*PARTITION, "sink_table"], "left").withColumn(
        "_absent", F.col("next_offset").isNull()
    )
    return per_branch.groupBy(*PARTITION).agg(
        F.min(F.coalesce("next_offset", "begin")).alias("start"),
        F.when(F.bool_or("_absent"), "absent-branch:begin").otherwise("store-prefix").alias("rule"),
        F.lit(False).alias("skips_backlog"),
    )


def explicit(bounds: DataFrame, vector: Vector) -> DataFrame:
    """P10: given numbers. Run ``validate_plan`` on the result."""
    rows = vector_frame(bounds.sparkSession, vector, "start")
    return rows.withColumns({"rule": F.lit("explicit"), "skips_backlog": F.lit(False)})


def resume_plan(
    bounds: DataFrame,
    spec: str | Vector,
    *,
    log: DataFrame | None = None,
    group_commits: DataFrame | None = None,
    sink: DataFrame | None = None,
    progress: DataFrame | None = None,
    branches: list[str] | None = None,
    job: str | None = None,
    on_no_match: str = "error",
    lead_ms: int = 0,
) -> DataFrame:
    """The plan of a spec: ``earliest``, ``latest``, ``committed-earliest``,
    ``committed-latest``, ``committed-none``, ``timestamp:<ms>``, ``store-max:<table>``,
    ``store-frontier``, ``store-prefix``, or a vector."""
    if isinstance(spec, dict):
        return explicit(bounds, spec)
    name, _, argument = spec.partition(":")
    if name in ("earliest", "latest"):
        return from_bounds(bounds, name)
    if name in ("committed-earliest", "committed-latest", "committed-none"):
        return from_commits(bounds, _given(group_commits, spec), name.removeprefix("committed-"))
    if name == "timestamp":
        return from_timestamp(bounds, _given(log, spec), int(argument), on_no_match, lead_ms)
    if name == "store-max":
        return from_table_maximum(bounds, _given(sink, spec), argument)
    if name == "store-frontier":
        return from_progress_maximum(bounds, _given(progress, spec), _given(job, spec))
    if name == "store-prefix":
        return from_prefix(bounds, _given(progress, spec), _given(branches, spec))
    raise ValueError(f"unknown start position {spec!r}")


def _given(value, spec: str):
    if value is None:
        raise ValueError(f"{spec!r} needs an input that was not passed")
    return value


def validate_plan(plan: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each partition of the plan or the log with what is wrong with its start.

    ``expired`` below the log, or resolved from a commit that is; ``past-end`` beyond it,
    ``skip-to-head`` at the end of a log that holds records, ``no-start`` for a partition the
    plan leaves out or could not resolve, ``unknown-partition`` for one the log does not have.
    """
    lost = F.col("rule").startswith("expired-commit")
    starts = plan.select(*PARTITION, "start", lost.alias("_lost"))
    return starts.join(bounds, PARTITION, "full_outer").withColumn(
        "flag",
        F.when(F.col("begin").isNull(), "unknown-partition")
        .when(F.col("_lost"), "expired")
        .when(F.col("start").isNull(), "no-start")
        .when(F.col("start") < F.col("begin"), "expired")
        .when(F.col("start") > F.col("end"), "past-end")
        .when((F.col("start") == F.col("end")) & (F.col("end") > F.col("begin")), "skip-to-head")
        .otherwise("ok"),
    ).drop("_lost")


def compare_plans(
    plans: dict[str, DataFrame], log: DataFrame, accounted: DataFrame
) -> DataFrame:
    """Per plan and partition the records read again, newly read and lost for good.

    Every partition of any plan has a row for each plan: one without records counts zero, and
    where a plan has no start, as with an error row, the counts are null and the rule says why.
    One pass over the log serves all plans: the plans become one wide row per partition,
    pinned to every task.
    """
    names = list(plans)
    wide = pin_small(
        reduce(
            lambda x, y: x.join(y, PARTITION, "full_outer"),
            [
                plans[n].select(
                    *PARTITION, F.col("start").alias(f"_start{i}"), F.col("rule").alias(f"_rule{i}")
                )
                for i, n in enumerate(names)
            ],
        )
    )
    starts = wide.select(*PARTITION, *[f"_start{i}" for i in range(len(names))])
    done, open_ = F.col("done") == 1, F.col("done") == 0
    counts = []
    for i in range(len(names)):
        start = F.col(f"_start{i}")
        counts += [
            F.count_if(done & (F.col("offset") >= start)).alias(f"reread{i}"),
            F.count_if(open_ & (F.col("offset") >= start)).alias(f"fresh{i}"),
            F.count_if(open_ & (F.col("offset") < start)).alias(f"loses{i}"),
        ]
    counted = account(log, accounted).join(starts, PARTITION).groupBy(*PARTITION).agg(*counts)
    per_partition = wide.join(counted, PARTITION, "left")

    def count(name: str, i: int) -> Column:
        return F.when(F.col(f"_start{i}").isNotNull(), F.coalesce(f"{name}{i}", F.lit(0)))

    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("plan"),
                F.col(f"_start{i}").alias("start"),
                F.coalesce(f"_rule{i}", F.lit("no-row")).alias("rule"),
                count("reread", i).alias("rows_reread"),
                count("fresh", i).alias("rows_recovered"),
                count("loses", i).alias("rows_lost"),
            )
            for i, name in enumerate(names)
        ]
    )
    return per_partition.select(*PARTITION, F.inline(rows))


def start_vector(plan: DataFrame, bounds: DataFrame | None = None, allow: tuple[str, ...] = ()) -> Vector:
    """The plan as a vector; raises on an error row and, with ``bounds``, on any flag that
    is not listed in ``allow``."""
    if bounds is not None:
        flagged = validate_plan(plan, bounds).where(~F.col("flag").isin("ok", *allow))
        found = flagged.orderBy(*PARTITION).limit(5).collect()
        if found:
            raise ResumeError(f"start positions refused: {[tuple(r) for r in found]}")
    return collect_vector(plan, "start")


def to_starting_offsets_json(plan: DataFrame) -> str:
    """The plan as the Kafka source's ``startingOffsets``."""
    return offsets_json(start_vector(plan))


__all__ = [
    "compare_plans",
    "explicit",
    "from_bounds",
    "from_commits",
    "from_prefix",
    "from_progress_maximum",
    "from_stored",
    "from_table_maximum",
    "from_timestamp",
    "log_bounds",
    "resume_plan",
    "start_vector",
    "to_starting_offsets_json",
    "validate_plan",
]
