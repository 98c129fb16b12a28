"""Shards along a Hilbert curve over metadata, with DataFrame functions only.

Each dimension (language, source, length) is quantised into at most 2^bits cells at its own
quantiles, the cell coordinates become an index on a Hilbert curve, and the rows in curve order are
cut into shards of equal row counts (law `rows`: at most one apart). A shard is a short stretch of
the curve, so its values span few cells of every dimension, and files by shard can be skipped by any
of them.

The global rank of a row is the sum of three numbers: rows in earlier cells, rows of its cell in
earlier buckets (a hash of doc_id splits hot cells), and its place in its bucket. Only counts meet in
one place: one per cell, at most 2^(bits * dimensions).

Defined cases: null text has size 8 and checksum 0; null metadata counts as the smallest value;
repeated rows each get a slot of their own; rows without doc_id are one bucket's; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import settled

SHARDS = 24
BITS = 4
BUCKETS = 64
BUCKET_ROWS = 100_000


def dimensions() -> list[Column]:
    """Metadata columns in the order of the curve's axes; strings are ordered by their whole UTF-8 bytes."""
    return [F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce(F.col("n_chars").cast("long"), F.lit(0).cast("long"))]


def cuts_of(docs: DataFrame, axis: Column, bits: int) -> list:
    """The values at the quantiles k / 2^bits of an axis, at most 2^bits - 1, each once and in order.

    Rows are counted by value first, so a value that a third of all rows share is one row. The values are
    sorted by range and summed within ranges; only one sum a range is put in order in one place.
    """
    counts = docs.select(axis.alias("v")).groupBy("v").count()
    placed = settled(counts.repartitionByRange("v").sortWithinPartitions("v")).withColumn("r", F.spark_partition_id())
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("r").agg(F.sum("count").alias("s"))
    sums = sums.select("r", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy()).alias("total"))
    here = Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = placed.withColumn("upto", F.sum("count").over(here)).join(F.broadcast(sums), "r")  # a row for each range
    crosses = f"((before + upto) * {1 << bits}) div total > ((before + upto - count) * {1 << bits}) div total"
    cuts = upto.where(crosses).where("before + upto < total").select("v").limit(1 << bits).collect()
    return sorted(row["v"] for row in cuts)


def quantised(docs: DataFrame, axes: list[Column], bits: int) -> list[Column]:
    """Cell coordinates 0 to 2^bits - 1: how many of the axis's cuts a value lies above."""
    steps = lambda axis, own: sum(((axis > F.lit(cut)).cast("int") for cut in own), F.lit(0))
    return [steps(axis, cuts_of(docs, axis, bits)) for axis in axes]


def hilbert_place(cell: list[int], bits: int) -> int:
    """Place of one cell on the Hilbert curve, by Skilling's transform of its coordinates."""
    x, axes = list(cell), len(cell)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(axes):
            if x[i] >> level & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] >> level & 1:
            flip ^= (1 << level) - 1
    place = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            place = place * 2 + ((v ^ flip) >> level & 1)
    return place


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of cell coordinates: looked up in one constant array of all cells.

    The array has 2^(bits * axes) entries, 2^16 at most, and becomes a single literal of the plan.
    """
    axes = len(cells)
    if bits * axes > 16:
        raise ValueError("at most 2^16 cells")
    places = (hilbert_place([n >> bits * k & (1 << bits) - 1 for k in range(axes)], bits) for n in range(1 << bits * axes))
    number = sum(cell * (1 << bits * k) for k, cell in enumerate(cells))
    return F.get(F.split(F.lit(",".join(map(str, places))), ","), number).cast("int")


def curve(docs: DataFrame, bits: int = BITS) -> Column:
    return hilbert_index(quantised(docs, dimensions(), bits), bits)


def assign(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot, lang, source, n_chars: one row for each row of docs.

    buckets: parts of a cell that are ranked apart; by default one for each BUCKET_ROWS rows of the table.
    """
    if buckets is None:
        buckets = max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    place = curve(docs, bits).alias("curve")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    meta = ("lang", "source", "n_chars")
    counts = docs.select(place, bucket).groupBy("curve", "bucket").count()
    in_cell = Window.partitionBy("curve")
    earlier = in_cell.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("curve", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"), F.sum("count").over(in_cell).alias("cell"))
    cells = counts.groupBy("curve").agg(F.first("cell").alias("cell"))
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("curve", F.coalesce(F.sum("cell").over(along), F.lit(0)).alias("first"), F.sum("cell").over(whole).alias("total"))
    firsts = counts.join(cells, "curve").select("curve", "bucket", (F.col("first") + F.col("before")).alias("first"), "total")

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *meta, place, bucket)
    own = Window.partitionBy("curve", "bucket").orderBy("text_crc32", "doc_id", "size", *meta)
    rank = F.col("first") + F.col("n") - 1
    ranked = rows.withColumn("n", F.row_number().over(own)).join(firsts, ["curve", "bucket"]).withColumn("rank", rank)
    shard = F.expr(f"cast(rank * {shards} div total as int)")
    slot = F.expr(f"rank - (shard * total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", slot).select("doc_id", "size", "text_crc32", "curve", "shard", "slot", *meta)


def manifest(assigned: DataFrame) -> DataFrame:
    """For each shard its rows, bytes and the range of every dimension: what a reader skips files by."""
    spans = [f(c).alias(f"{name}_{c}") for c in ("lang", "source", "n_chars") for name, f in (("min", F.min), ("max", F.max))]
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *spans)
