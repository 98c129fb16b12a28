"""Hand-made tables for the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

LOG = "topic string, partition int, offset bigint, record_ts bigint, value string"


def log_frame(spark, rows):
    """rows: (partition, offset[, record_ts[, value]]) of topic 't'; value None is null."""
    full = []
    for row in rows:
        partition, offset = row[0], row[1]
        ts = row[2] if len(row) > 2 else offset
        value = row[3] if len(row) > 3 else f"{partition * 1000 + offset}\t{ts}\ta\tp"
        full.append(("t", partition, offset, ts, value))
    return spark.createDataFrame(full, LOG).withColumn("value", F.col("value").cast("binary"))


def positions(spark, rows):
    return spark.createDataFrame(
        [("t", p, o) for p, o in rows], "topic string, partition int, offset bigint"
    )


def bounds_frame(spark, rows):
    return spark.createDataFrame(
        [("t", *r) for r in rows], "topic string, partition int, begin bigint, end bigint"
    )


def as_dict(df, key, value):
    """{key columns: value columns}; a single column stands for itself."""
    out = {}
    for row in df.collect():
        k = tuple(row[c] for c in key) if isinstance(key, list) else row[key]
        out[k] = tuple(row[c] for c in value) if isinstance(value, list) else row[value]
    return out
