"""Where pipelines keep tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster must name one,
    since executors cannot see the driver's disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix=f"{name}-")


def ensure_table(
    spark: SparkSession, path: str, schema: T.StructType, partition_by: list[str]
) -> None:
    """Creates an empty parquet table unless the folder exists."""
    empty = spark.createDataFrame([], schema)
    empty.write.mode("ignore").partitionBy(*partition_by).parquet(path)


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty frame that the optimizer knows to be empty, so that joins and unions with it vanish."""
    columns = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema.fields]
    return spark.range(1).where("false").select(*columns)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table's rows, or none if nothing was written yet."""
    if not exists(spark, path):
        return no_rows(spark, schema)
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the file system the path belongs to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(spark: SparkSession, path: str) -> bool:
    """Has a finished job written this folder? One that died left no success mark."""
    return exists(spark, f"{path}/_SUCCESS")
