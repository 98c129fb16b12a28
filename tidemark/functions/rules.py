"""Validity rules and the fate of each record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.routes import table_of
from tidemark.functions.wire import EMPTY, MALFORMED

DELIVERED, FILTERED, UNROUTED, REJECTED = "delivered", "filtered", "unrouted", "rejected"


@dataclass(frozen=True)
class Rule:
    """A named predicate that is true for a bad row.

    ``data`` rules reject the row; ``infra`` rules fail the job, because the row itself is
    not at fault and skipping it would lose it.
    """

    name: str
    bad: Column
    kind: str = "data"

    def __post_init__(self) -> None:
        if self.kind not in ("data", "infra"):
            raise ValueError(f"rule {self.name}: unknown class {self.kind!r}")


def every_nth_is_bad(n: int, name: str = "poison") -> list[Rule]:
    """The stand-in rule of the fault tests: each nth event id cannot be written."""
    return [Rule(name, F.col("event_id") % n == 0)]


def first_reason(rules: list[Rule]) -> Column:
    """F8: name of the first rule a row breaks, null if none."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        hit = (
            F.lit(rule.name)
            if rule.kind == "data"
            else F.raise_error(F.lit(f"rule {rule.name} failed; not a data error"))
        )
        found = F.when(rule.bad, hit.cast("string")).otherwise(found)
    return found


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """F8: adds reason."""
    return df.withColumn("reason", first_reason(rules))


def dispose(
    decoded: DataFrame,
    rules: list[Rule] | None = None,
    drop_route: str | None = None,
    route_map: dict[str, str] | None = None,
) -> DataFrame:
    """sets sink_table, reason and the final disposition of every decoded record.

    Filtered, unrouted and rejected records keep a row, so that progress can count them.
    """
    unread = F.col("disposition").isin(EMPTY, MALFORMED)
    filtered = (
        F.lit(False) if drop_route is None else F.col("route").eqNullSafe(F.lit(drop_route))
    )
    table = F.when(~unread, table_of(F.col("route"), route_map))
    return (
        decoded.withColumn("sink_table", table)
        .withColumn(
            "reason",
            F.when(unread, F.col("reason"))
            .when(filtered | F.col("sink_table").isNull(), F.lit(None).cast("string"))
            .otherwise(first_reason(rules or [])),
        )
        .withColumn(
            "disposition",
            F.when(unread, F.col("disposition"))
            .when(filtered, FILTERED)
            .when(F.col("sink_table").isNull(), UNROUTED)
            .when(F.col("reason").isNotNull(), REJECTED)
            .otherwise(DELIVERED),
        )
    )
