"""Writes a larger ``events.parquet`` folder: the events of a scale factor, repeated with
shifted ids and times, over several files.

    python tools/widen_events.py <sf dir> <new folder> <copies> <files>
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main() -> None:
    sf_dir, out, copies, files = sys.argv[1], sys.argv[2], int(sys.argv[3]), int(sys.argv[4])
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    )
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = raw.agg(F.max("event_id") + 1).first()[0]
    wide = raw.withColumn("_k", F.explode(F.expr(f"sequence(0L, {copies - 1}L)")))
    wide = wide.withColumn("event_id", F.col("event_id") + F.col("_k") * size).withColumn(
        "ts", F.col("ts") + F.make_dt_interval(F.col("_k").cast("int") * 30)
    )
    columns = [c for c in wide.columns if c != "_k"]
    wide.select(*columns).repartitionByRange(files, "event_id").write.parquet(f"{out}/events.parquet")
    spark.stop()


if __name__ == "__main__":
    main()
