"""Bounds of a topic log from its files' footers, without reading a row group.

Spark answers min, max and count from parquet footers if the log is laid out in folders by topic and
partition. That needs the second parquet source with aggregate pushdown, which a sister session of
the same application switches on for these small reads alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import PARTITION, TOPIC_LOG
from tidemark.sources.vectors import pin_small

# Records of a folder-partitioned log carry topic and partition in their path.
LAID_OUT = T.StructType([*[f for f in TOPIC_LOG.fields if f.name not in PARTITION], *[TOPIC_LOG[p] for p in PARTITION]])


def write_laid_out(log: DataFrame, path: str) -> None:
    """Adds records to a topic log with folders by topic and partition, in offset order inside files."""
    (
        log.select(*TOPIC_LOG.names)
        .hint("rebalance", *PARTITION)
        .sortWithinPartitions(*PARTITION, "offset")
        .write.mode("append").partitionBy(*PARTITION).parquet(path)
    )


def footer_profile(spark: SparkSession, path: str) -> DataFrame:
    """H1/I2 per partition: begin, exclusive end, records, and the least and greatest record clock.

    The frame belongs to the sister session; see ``pinned_footer_bounds`` for one of the caller's own.
    """
    sister = spark.newSession()
    sister.conf.set("spark.sql.sources.useV1SourceList", "")
    sister.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    log = sister.read.schema(LAID_OUT).parquet(path)
    return log.groupBy(*PARTITION).agg(
        F.min("offset").alias("begin"), F.max("offset").alias("last"), F.count("*").alias("records"),
        F.min("record_ts").alias("min_ts"), F.max("record_ts").alias("max_ts"),
    )


def pinned_footer_bounds(spark: SparkSession, path: str) -> DataFrame:
    """begin and exclusive end of each partition, one row each, as ``pinned_bounds`` of the log's rows."""
    rows = footer_profile(spark, path).toArrow()
    held = spark.createDataFrame(rows).select(*PARTITION, "begin", (F.col("last") + 1).alias("end"))
    return pin_small(held)
