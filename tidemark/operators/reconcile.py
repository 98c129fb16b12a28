"""Ledger against sink tables: what is missing, extra, repeated or changed.

Everything starts from a tagged union reduced by key. Copies of one key collapse inside the
map tasks, so a key holding a large share of all rows costs no more than any other, and no
side is ever broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.routes import map_routes
from tidemark.schemas import BEFORE, AFTER, DURING, PARTITION, POSITION, TABLES

KINDS = ["missing", "extra", "duplicate"]
#: Stored rows that a task of the scenario summary takes, about 200 bytes each while it holds them.
ROWS_IN_TASK = 300_000
#: Tasks that copies of one id are dealt over before they are counted.
PLACES = 32


def is_missing() -> Column:
    return (F.col("expected_copies") > 0) & (F.col("stored_copies") == 0)


def is_extra() -> Column:
    return (F.col("expected_copies") == 0) & (F.col("stored_copies") > 0)


def is_duplicate() -> Column:
    return F.col("stored_copies") > 1


def positions_of(sink: DataFrame) -> DataFrame:
    """Sink rows with their source position under the log's own column names."""
    return sink.withColumnsRenamed(
        {"src_topic": "topic", "src_part": "partition", "src_offset": "offset"}
    )


def expected_rows(
    ledger: DataFrame, route_map: dict[str, str] | None = None, tables: list[str] | None = None
) -> DataFrame:
    """Ledger rows whose route leads to one of the audited tables."""
    routed = map_routes(ledger, route_map).where(F.col("sink_table").isNotNull())
    return routed if tables is None else routed.where(F.col("sink_table").isin(tables))


def compare_ids(
    expected: DataFrame, actual: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """One row per key with how often each side holds it."""
    keys = keys or ["sink_table", "event_id"]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tagged = expected.select(*keys, one.alias("_e"), none.alias("_a")).unionByName(
        actual.select(*keys, none.alias("_e"), one.alias("_a"))
    )
    return tagged.groupBy(*keys).agg(
        F.sum("_e").alias("expected_copies"), F.sum("_a").alias("stored_copies")
    )


def missing_ids(compared: DataFrame) -> DataFrame:
    """Expected keys that no table row carries."""
    return compared.where(is_missing()).drop("expected_copies", "stored_copies")


def extra_ids(compared: DataFrame) -> DataFrame:
    """Stored keys that nobody expected."""
    return compared.where(is_extra()).drop("expected_copies", "stored_copies")


def duplicate_ids(compared: DataFrame) -> DataFrame:
    """Keys stored more than once, with their copies."""
    return compared.where(is_duplicate()).drop("expected_copies")


def multiplicity(compared: DataFrame) -> DataFrame:
    """Keys stored another number of times than expected."""
    return compared.where(F.col("expected_copies") != F.col("stored_copies")).withColumn(
        "surplus", F.col("stored_copies") - F.col("expected_copies")
    )


def table_verdict(
    compared: DataFrame, tables: list[str] | None = None, by: list[str] | None = None
) -> DataFrame:
    """G1: per table the expected, distinct, stored, missing, extra and duplicate counts.

    A table named in ``tables`` shows up with zeros even if neither side has a row for it;
    one that is not named is left out. ``by`` adds grouping columns, such as a scenario.
    """
    flags = compared.select(
        *(by or []),
        "sink_table",
        (F.col("expected_copies") > 0).cast("bigint").alias("expected"),
        (F.col("stored_copies") > 0).cast("bigint").alias("actual_distinct"),
        F.col("stored_copies").alias("rows"),
        is_missing().cast("bigint").alias("missing_count"),
        is_extra().cast("bigint").alias("extra_count"),
        is_duplicate().cast("bigint").alias("duplicate_count"),
    )
    counts = ["expected", "actual_distinct", "rows", *(f"{kind}_count" for kind in KINDS)]
    if tables is not None:
        flags = flags.where(F.col("sink_table").isin(tables))
        if not by:
            blank = compared.sparkSession.createDataFrame([(t,) for t in tables], "sink_table string")
            zero = F.lit(0).cast("bigint")
            flags = flags.unionByName(blank.select("sink_table", *[zero.alias(c) for c in counts]))
    return flags.groupBy(*(by or []), "sink_table").agg(*[F.sum(c).alias(c) for c in counts])


def samples(compared: DataFrame, k: int = 20) -> DataFrame:
    """The k least ids of each kind per table, as a sorted array.

    The rank limit is applied inside each task before the shuffle, so a table that lost
    everything still sends only k rows per task.
    """
    kinds = F.array(
        F.when(is_missing(), F.lit("missing")),
        F.when(is_extra(), F.lit("extra")),
        F.when(is_duplicate(), F.lit("duplicate")),
    )
    least_first = Window.partitionBy("sink_table", "kind").orderBy("event_id")
    return (
        compared.where(is_missing() | is_extra() | is_duplicate())
        .select("sink_table", "event_id", F.explode(F.array_compact(kinds)).alias("kind"))
        .withColumn("_rank", F.row_number().over(least_first))
        .where(F.col("_rank") <= k)
        .groupBy("sink_table", "kind")
        .agg(F.sort_array(F.collect_list("event_id")).alias("sample"))
    )


def outage(
    ledger: DataFrame,
    sink: DataFrame,
    tables: list[str] | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Distinct events of the outage, and how many any audited table holds."""
    keys = [*(by or []), "event_id"]
    if tables is not None:
        sink = sink.where(F.col("sink_table").isin(tables))
    asked = ledger.where(F.col("phase") == DURING).select(
        *keys, F.lit(1).alias("_asked"), F.lit(0).alias("_held")
    )
    held = sink.select(*keys, F.lit(0).alias("_asked"), F.lit(1).alias("_held"))
    per_id = (
        asked.unionByName(held)
        .groupBy(*keys)
        .agg(F.max("_asked").alias("_asked"), F.max("_held").alias("_held"))
    )
    was_asked, was_held = F.col("_asked") == 1, F.col("_held") == 1
    return per_id.groupBy(*(by or [])).agg(
        F.count_if(was_asked).alias("produced"),
        F.count_if(was_asked & was_held).alias("saved"),
        F.count_if(was_asked & ~was_held).alias("lost"),
    )


def passes(
    expect: Column, unique_required: Column, missing: Column, extra: Column, duplicate: Column
) -> Column:
    """``no-loss`` wants nothing missing or extra (nor repeated where ids must be
    unique); ``loss`` wants something missing and looks at nothing else."""
    return F.when(expect == "loss", missing > 0).otherwise(
        (missing == 0) & (extra == 0) & ((duplicate == 0) | ~unique_required)
    )


def verdict(per_table: DataFrame, expect: str = "no-loss", unique_required: bool = False) -> DataFrame:
    """One row: the totals over all tables and whether the prediction held."""
    if expect not in ("no-loss", "loss"):
        raise ValueError(f"unknown expectation {expect!r}")
    totals = per_table.agg(
        *[F.coalesce(F.sum(f"{kind}_count"), F.lit(0)).alias(kind) for kind in KINDS]
    )
    return totals.withColumn(
        "pass",
        passes(
            F.lit(expect), F.lit(unique_required),
            F.col("missing"), F.col("extra"), F.col("duplicate"),
        ),
    )


def scenario_summary(
    ledgers: DataFrame,
    sinks: DataFrame,
    specs: DataFrame,
    tables: list[str] | None = None,
    route_map: dict[str, str] | None = None,
) -> DataFrame:
    """One row per scenario: outage counts, all-phase counts and the verdict.

    ``sinks`` carries a scenario column and ``specs`` is (scenario, expect, unique_required).
    ``ledgers`` carries one too, or is the one ledger of all scenarios: it is then read once and
    not multiplied, since what a scenario lacks is what was wanted less what it holds.

    The stored rows are counted first, and as many tasks taken that each gets about ``ROWS_IN_TASK``:
    left to the size of the shuffled bytes, which compress well, a task's rows grow with the input.
    Copies of one id are counted in ``PLACES`` tasks, by what else tells them apart, before they meet.
    """
    tables = tables or TABLES
    own = ["scenario"] if "scenario" in ledgers.columns else []
    sinks = sinks.where(F.col("sink_table").isin(tables))
    tasks = -(-sinks.count() // ROWS_IN_TASK) or 1
    # Tables by number, in the order of their names: all that is grouped has a fixed width.
    numbered = F.array_position(F.array(*[F.lit(t) for t in sorted(tables)]), F.col("sink_table"))
    wanted = F.when(F.col("sink_table").isin(tables), numbered)
    events = (
        map_routes(ledgers, route_map)
        .groupBy(*own, "event_id")
        .agg(F.max(wanted).alias("_wanted"), F.max((F.col("phase") == DURING).cast("int")).alias("_o"))
    )
    totals = events.groupBy(*own).agg(
        F.count_if(F.col("_o") == 1).alias("produced"), F.count("_wanted").alias("_total")
    )
    here = F.col("_wanted").eqNullSafe(F.col("_table"))
    apart = [c for c in ("scenario", "sink_table", "src_topic", "src_part", "src_offset") if c in sinks.columns]
    place = F.pmod(F.xxhash64(*apart), F.lit(PLACES))
    per_scenario = (
        sinks.select("scenario", "event_id", numbered.alias("_table"), place.alias("_place"))
        .repartition(tasks, "event_id", "_place")
        .groupBy("scenario", "event_id", "_table", "_place")
        .agg(F.count("*").alias("_copies"))
        .repartition(tasks, *own, "event_id")
        .groupBy("scenario", "event_id", "_table")
        .agg(F.sum("_copies").alias("_copies"))
        .join(events.repartition(tasks, *own, "event_id").hint("shuffle_hash"), [*own, "event_id"], "left")
        .groupBy("scenario", "event_id")
        .agg(
            F.max("_o").alias("_o"),
            F.count_if(here).alias("_held"),
            F.count_if(F.col("_copies") > 1).alias("_repeated"),
            F.count_if(~here).alias("_stray"),
        )
        .groupBy("scenario")
        .agg(
            F.count_if(F.col("_o") == 1).alias("saved"),
            F.sum("_held").alias("_held"),
            F.sum("_repeated").alias("duplicate"),
            F.sum("_stray").alias("extra"),
        )
    )
    joined = specs.join(per_scenario, "scenario", "left")
    joined = joined.join(totals, own, "left") if own else joined.crossJoin(F.broadcast(totals))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counted = joined.select(
        "scenario", "expect", "unique_required",
        zero("produced").alias("produced"), zero("saved").alias("saved"),
        (zero("produced") - zero("saved")).alias("lost"),
        (zero("_total") - zero("_held")).alias("missing"),
        zero("duplicate").alias("duplicate"), zero("extra").alias("extra"),
    )
    verdict_ = passes(
        F.col("expect"), F.col("unique_required"), F.col("missing"), F.col("extra"), F.col("duplicate")
    )
    return counted.withColumn("pass", verdict_).drop("unique_required")


def verdict_report(
    ledger: DataFrame,
    sink: DataFrame,
    scenario: str,
    expect: str = "no-loss",
    unique_required: bool = False,
    tables: list[str] | None = None,
    k: int = 20,
) -> DataFrame:
    """One row per table with counts, samples, outage counts and the overall verdict.

    Write it with ``df.write.json`` or ``df.write.parquet``; nothing passes the driver.
    """
    tables = tables or TABLES
    compared = compare_ids(
        expected_rows(ledger, tables=tables), sink.where(F.col("sink_table").isin(tables))
    )
    per_table = table_verdict(compared, tables)
    found = samples(compared, k).groupBy("sink_table").agg(
        *[F.max(F.when(F.col("kind") == kind, F.col("sample"))).alias(f"{kind}_sample")
          for kind in KINDS]
    )
    empty = F.array().cast("array<bigint>")
    totals = Window.partitionBy()
    total = {kind: F.sum(f"{kind}_count").over(totals) for kind in KINDS}
    saved = outage(ledger, sink, tables).agg(
        F.struct(*[F.max(c).alias(c) for c in ("produced", "saved", "lost")])
    )
    return per_table.join(found, "sink_table", "left").select(
        F.lit(scenario).alias("scenario"),
        "sink_table", "expected", "actual_distinct", "rows",
        *[c for kind in KINDS for c in (
            F.col(f"{kind}_count"),
            F.coalesce(F.col(f"{kind}_sample"), empty).alias(f"{kind}_sample"))],
        saved.scalar().alias("outage"),
        passes(F.lit(expect), F.lit(unique_required),
               total["missing"], total["extra"], total["duplicate"]).alias("pass"),
    )


def ledger_phases(ledger: DataFrame) -> DataFrame:
    """Events, least and greatest id of each phase, in outage order."""
    order = (
        F.when(F.col("phase") == BEFORE, 0)
        .when(F.col("phase") == DURING, 1)
        .when(F.col("phase") == AFTER, 2)
        .otherwise(3)
    )
    return (
        ledger.groupBy("phase")
        .agg(
            F.count("*").alias("events"),
            F.min("event_id").alias("min_id"),
            F.max("event_id").alias("max_id"),
        )
        .orderBy(order, "phase")
    )


def route_split(ledger: DataFrame) -> DataFrame:
    """Events per route."""
    return ledger.groupBy("route").agg(F.count("*").alias("events")).orderBy("route")


def content_diff(
    expected: DataFrame, actual: DataFrame, key: list[str], columns: list[str]
) -> DataFrame:
    """R2: keys held by both sides whose copies do not all agree, and in which columns.

    Only 8-byte hashes of the columns cross the shuffle, not the columns.
    """
    def side(df: DataFrame, tag: int) -> DataFrame:
        return df.select(
            *key,
            F.lit(tag).alias("_side"),
            *[F.xxhash64(F.col(c).isNull(), F.col(c)).alias(f"_h{i}")
              for i, c in enumerate(columns)],
        )

    per_key = (
        side(expected, 0)
        .unionByName(side(actual, 1))
        .groupBy(*key)
        .agg(
            F.min("_side").alias("_lo"),
            F.max("_side").alias("_hi"),
            *[F.min(f"_h{i}").alias(f"_min{i}") for i in range(len(columns))],
            *[F.max(f"_h{i}").alias(f"_max{i}") for i in range(len(columns))],
        )
    )
    differing = F.array_compact(
        F.array(
            *[F.when(F.col(f"_min{i}") != F.col(f"_max{i}"), F.lit(c))
              for i, c in enumerate(columns)]
        )
    )
    return (
        per_key.where((F.col("_lo") == 0) & (F.col("_hi") == 1))
        .select(*key, differing.alias("diff_columns"))
        .where(F.size("diff_columns") > 0)
    )


def branch_divergence(log: DataFrame, sink: DataFrame) -> DataFrame:
    """Per table and partition, how far the branch got and how far it trails the leader.

    ``log`` has sink_table, as ``map_routes`` adds it. The closing window runs over one row
    per table and partition.
    """
    branch = ["sink_table", *PARTITION]
    wanted = log.where(F.col("sink_table").isNotNull()).select(
        *branch, "offset", F.lit(1).alias("_w"), F.lit(0).alias("_s")
    )
    stored = positions_of(sink).select(
        *branch, "offset", F.lit(0).alias("_w"), F.lit(1).alias("_s")
    )
    per_position = (
        wanted.unionByName(stored)
        .groupBy(*branch, "offset")
        .agg(F.max("_w").alias("_w"), F.max("_s").alias("_s"))
    )
    held = F.col("_s") == 1
    leader = F.max("last_offset").over(Window.partitionBy(*PARTITION))
    return (
        per_position.groupBy(*branch)
        .agg(
            F.max(F.when(held, F.col("offset"))).alias("last_offset"),
            F.count_if(held).alias("delivered"),
            F.count_if((F.col("_w") == 1) & ~held).alias("missing"),
        )
        .withColumn("behind_leader", leader - F.coalesce("last_offset", F.lit(-1)))
    )


def dup_cause(sink: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Each repeated key with its cause.

    ``replay``: the same source record was written again. ``producer``: distinct source
    records carry the same id. ``both``: each happened.
    """
    key = key or ["sink_table", "event_id"]
    per_source = (
        positions_of(sink).groupBy(*key, *POSITION).agg(F.count("*").alias("copies"))
    )
    per_key = per_source.groupBy(*key).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("sources")
    )
    return per_key.where(F.col("copies") > 1).withColumn(
        "cause",
        F.when(F.col("sources") == 1, "replay")
        .when(F.col("sources") == F.col("copies"), "producer")
        .otherwise("both"),
    )


def hop_reconcile(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Per original event id, its copies at each stage and the last one it reached."""
    names = [name for name, _ in stages]
    tagged = reduce(
        DataFrame.unionByName,
        [
            df.select("event_id", *[F.lit(int(n == name)).alias(n) for n in names])
            for name, df in stages
        ],
    )
    per_id = tagged.groupBy("event_id").agg(*[F.sum(n).alias(n) for n in names])
    last = F.lit(None).cast("string")
    for name in names:
        last = F.when(F.col(name) > 0, F.lit(name)).otherwise(last)
    return per_id.withColumn("last_stage", last)


def hop_summary(per_id: DataFrame, names: list[str]) -> DataFrame:
    """Per stage the ids that reached it, got lost on the way in, appeared from nowhere
    or were sent again. Repeats at an inner hop show here even if the sink absorbs them."""
    aggregates = []
    for i, name in enumerate(names):
        here = F.col(name) > 0
        before = F.col(names[i - 1]) > 0 if i else here
        aggregates += [
            F.count_if(here).alias(f"reached{i}"),
            F.count_if(before & ~here).alias(f"lost{i}"),
            F.count_if(here & ~before).alias(f"unexpected{i}"),
            F.sum(F.greatest(F.col(name) - 1, F.lit(0))).alias(f"repeats{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("hop"),
                F.lit(name).alias("stage"),
                *[F.coalesce(F.col(f"{c}{i}"), F.lit(0)).alias(c)
                  for c in ("reached", "lost", "unexpected", "repeats")],
            )
            for i, name in enumerate(names)
        ]
    )
    return per_id.agg(*aggregates).select(F.inline(rows))


def balance(
    log: DataFrame, dispositions: list[tuple[str, DataFrame]], conflict: tuple[str, str] = ("saved", "rejected")
) -> DataFrame:
    """Per partition, produced = the sum of all dispositions + outstanding.

    ``dispositions`` are named frames of positions (topic, partition, offset). ``conflicts``
    counts offsets found in both of the ``conflict`` frames, which must be none; ``stray``
    counts accounted offsets that the log does not hold.
    """
    names = [name for name, _ in dispositions]

    def marked(df: DataFrame, own: str) -> DataFrame:
        return df.select(*POSITION, *[F.lit(int(n == own)).alias(n) for n in ["produced", *names]])

    tagged = reduce(
        DataFrame.unionByName,
        [marked(log, "produced"), *[marked(df, name) for name, df in dispositions]],
    )
    per_position = tagged.groupBy(*POSITION).agg(
        *[F.max(n).alias(n) for n in ["produced", *names]]
    )
    accounted = F.greatest(*[F.col(n) for n in names], F.lit(0)) == 1
    logged = F.col("produced") == 1
    both = (F.col(conflict[0]) == 1) & (F.col(conflict[1]) == 1)
    return (
        per_position.groupBy(*PARTITION)
        .agg(
            F.count_if(logged).alias("produced"),
            *[F.count_if(logged & (F.col(n) == 1)).alias(n) for n in names],
            F.count_if(logged & ~accounted).alias("outstanding"),
            F.count_if(both).alias("conflicts"),
            F.count_if(~logged).alias("stray"),
        )
        .withColumn(
            "balanced",
            (reduce(lambda x, y: x + y, [F.col(n) for n in names]) + F.col("outstanding")
             == F.col("produced")) & (F.col("conflicts") == 0) & (F.col("stray") == 0),
        )
    )


def conflicts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Positions present in both frames, e.g. saved and rejected at once."""
    return first.select(*POSITION).distinct().join(
        second.select(*POSITION).distinct(), POSITION, "left_semi"
    )


def distinct_since(rows: DataFrame, clock: str, since: int) -> DataFrame:
    """Exact rows and exact distinct ids since a moment, and the surplus copies."""
    per_id = (
        rows.where(F.col(clock) >= F.lit(since))
        .groupBy("event_id")
        .agg(F.count("*").alias("copies"))
    )
    return per_id.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_ids"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus"),
    )


def hop_lineage(lineage: DataFrame) -> DataFrame:
    """J9 by position: what a hop made of each source record, without an id in the payload.

    ``lineage`` has a row for each record of the hop's topic with its source position. ``copies`` over one are
    repeats the hop sent; ``partition`` and ``offset`` name the first copy.
    """
    place = F.struct("partition", "offset")
    return (
        lineage.groupBy("src_topic", "src_part", "src_offset")
        .agg(F.count("*").alias("copies"), F.min(place).alias("_first"))
        .select("src_topic", "src_part", "src_offset", "copies", "_first.partition", "_first.offset")
    )


def distinct_sketches(sink: DataFrame, lg_k: int = 14) -> DataFrame:
    """G11 prepared: by table and hour the rows stored and a sketch of their ids, small and mergeable.

    Sketches of further batches are added with ``unionByName``; the error of an estimate is about
    1.04 / sqrt(2^lg_k), 0.8 % at 14.
    """
    hour = F.date_trunc("hour", "inserted_at").alias("hour")
    return sink.groupBy("sink_table", hour).agg(
        F.count("*").alias("rows"), F.hll_sketch_agg("event_id", F.lit(lg_k)).alias("ids")
    )


def dup_ratio_sketched(sketches: DataFrame, since=None) -> DataFrame:
    """G11 from sketches: exact rows and about how many distinct ids each table holds since an hour."""
    seen = sketches if since is None else sketches.where(F.col("hour") >= F.lit(since))
    return seen.groupBy("sink_table").agg(
        F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("distinct_ids")
    )
