"""Latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_version(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The row with the greatest version of each key.

    Name enough version columns to break ties. Spark keeps only the best row of a key in
    each task before the shuffle, so a key with very many versions stays cheap.
    """
    newest_first = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in version])
    return (
        df.withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def first_version(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the least ``order`` of each key: in-batch deduplication for K2."""
    oldest_first = Window.partitionBy(*key).orderBy(*[F.asc(c) for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(oldest_first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )
