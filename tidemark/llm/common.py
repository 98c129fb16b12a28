"""Small helpers shared by the training-text operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session without one, as in tests, gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def pieces(texts, limit: int = 4_000_000):
    """Consecutive (from, to) ranges of a list of texts, each of about `limit` characters or one text; null counts as empty."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(batches, rows: int = 500):
    """The same Arrow batches in parts of at most `rows` rows, so that little is unpacked at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
