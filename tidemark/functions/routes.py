"""Routes, phases and time windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import AFTER, BEFORE, DURING, ROUTE_TABLES


def route_filter(df: DataFrame, drop: str | None = None) -> DataFrame:
    """keeps every row unless one route is named to be dropped."""
    return df if drop is None else df.where(~F.col("route").eqNullSafe(F.lit(drop)))


def table_of(route: Column, route_map: dict[str, str] | None = None) -> Column:
    """destination table of a route; null for a route nobody takes."""
    chosen = F.lit(None).cast("string")
    for name, table in reversed((route_map or ROUTE_TABLES).items()):
        chosen = F.when(route == name, F.lit(table)).otherwise(chosen)
    return chosen


def map_routes(df: DataFrame, route_map: dict[str, str] | None = None) -> DataFrame:
    """adds sink_table; rows with an unknown route stay, with a null table."""
    return df.withColumn("sink_table", table_of(F.col("route"), route_map))


def route_of(event_id: Column) -> Column:
    """every 500th event is rare, the others alternate between a and b."""
    return (
        F.when(event_id % 500 == 0, F.lit("rare"))
        .when(event_id % 2 == 0, F.lit("a"))
        .otherwise(F.lit("b"))
    )


def phase_of(clock: Column, outage_start: Column | float, restart: Column | float) -> Column:
    """which side of the outage ``[outage_start, restart)`` a value falls on."""
    return (
        F.when(clock < outage_start, F.lit(BEFORE))
        .when(clock < restart, F.lit(DURING))
        .otherwise(F.lit(AFTER))
    )


def tag_phase(
    df: DataFrame, outage_start: int, restart: int, clock: str = "produced_at"
) -> DataFrame:
    """adds phase from a clock column."""
    return df.withColumn("phase", phase_of(F.col(clock), F.lit(outage_start), F.lit(restart)))


def in_window(df: DataFrame, clock: str, lo: int, hi: int) -> DataFrame:
    """rows whose chosen clock lies in ``[lo, hi)``; pushes down to the scan."""
    return df.where((F.col(clock) >= F.lit(lo)) & (F.col(clock) < F.lit(hi)))
