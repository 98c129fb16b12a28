"""Removal of repeated byte strings by prefix-free parsing.

A byte is removed if some string of `span` (200) bytes that covers it also starts anywhere else.

Parsing. A rolling hash of GRAM bytes slides over each document; a position whose hash is the least
within `radius` positions on both sides triggers a new phrase. Triggers depend on the text around
them alone, so equal strings are cut into phrases alike, whatever surrounds them.

Dictionary. The 200-byte strings that start in one phrase (more exactly: whose first inner trigger is
the same, WIDTH starts at most) share a core, the bytes that all of them cover. One row stands for
them: a hash of the core, a hash of the whole context (all the bytes they cover), and where they
start. Counting both over the corpus gives the dictionary of contexts. A core that occurs once rules
all its starts out; a context that occurs twice takes all its starts in.

Order. What is left are cores with several contexts, at the ends of repeated passages. The suffixes
of the contexts of one core are sorted, and those that share 200 bytes with a neighbour in that order
are repeated. Strings that share 200 bytes always meet below one core, so these orders, side by side,
are all of the corpus's suffix order that matters; the order between cores is never needed. A core
with very many contexts is split: half the starts share a longer core each, down to single starts.

Text is parsed where it lies and crosses the network twice, compressed, to meet the starts found in
it. No task gathers all rows of a key: counts are partial sums, and joins are on tables whose large
partitions Spark splits.

Defined cases: null and empty texts have no bytes and keep the hash of nothing; texts under 200 bytes
lose nothing; repeated rows each get a result, and repeat each other; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import pieces, settled, shared_folder, slices

SPAN = 200
GRAM = 8
RADIUS = 28
WIDTH = 64
#: Contexts of one core that are sorted in one task; more are split first.
MOST = 4_000


def triggers(text: bytes, radius: int = RADIUS) -> np.ndarray:
    """Positions whose rolling hash is the least within the radius, where that lies in the text."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw) - GRAM + 1
    if n < 2 * radius + 1:
        return np.empty(0, np.int64)
    four = raw.astype(np.uint32)
    four = four[:-1] | four[1:] << np.uint32(8)
    four = four[:-2] | four[2:] << np.uint32(16)
    value = four[:n] * np.uint32(0x9E3779B1) ^ four[4 : n + 4] * np.uint32(0x85EBCA77)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(13)
    least, reach, width = value, 1, 2 * radius + 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    around = np.minimum(least[: n - width + 1], least[width - reach : n - reach + 1])
    return np.flatnonzero(value[radius : n - radius] == around) + radius


def starts(text: bytes, span: int = SPAN, radius: int = RADIUS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, nearest) for each run of string starts that are taken together.

    nearest is the last start that a run of its kind can have, or -1 where a string holds no inner
    trigger and stands alone.
    """
    end = len(text) - span
    if end < 0:
        return (np.empty(0, np.int64),) * 3
    at = triggers(text, radius)
    inner = span - GRAM - radius  # an inner trigger lies radius to inner after the start
    before = np.r_[-1, at[:-1] - radius] if len(at) else at
    low = np.maximum(np.maximum(before + 1, at - inner), 0)
    high = np.minimum(at - radius, end)
    gaps_from = np.r_[before + 1, at[-1] - radius + 1 if len(at) else 0]
    gaps_to = np.r_[np.minimum(at - inner - 1, end), end]
    alone = [np.arange(max(a, 0), b + 1) for a, b in zip(gaps_from.tolist(), gaps_to.tolist()) if b >= a]
    single = np.concatenate(alone) if alone else np.empty(0, np.int64)
    real = low <= high
    low, high, near = low[real], high[real], (at - radius)[real]
    first, last = (near - low) // width, (near - high) // width  # numbers of the farthest and nearest run
    times = first - last + 1
    own = np.repeat(np.arange(len(low)), times)
    number = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + last[own]
    nearest = near[own] - number * width
    lows, highs = np.maximum(nearest - width + 1, low[own]), np.minimum(nearest, high[own])
    return np.r_[lows, single], np.r_[highs, single], np.r_[nearest, np.full(len(single), -1)]


def rows_of(text: bytes, span: int, radius: int, width: int, cores_only: bool) -> tuple[list[int], list[int], np.ndarray]:
    """Hashes of cores and of contexts, and places: first start * 65536 + shift * 256 + starts.

    shift is how far the last start lies before the nearest one of its kind, where a text ends early.
    """
    low, high, near = starts(text, span, radius, width)
    hash_, cores, contexts = xxhash.xxh64_intdigest, [], []
    long = span - width + 1
    for a, b, c in zip(low.tolist(), high.tolist(), near.tolist()):
        cores.append(hash_(text[c : c + long], 1) if c >= 0 else hash_(text[a : a + span], 2))
        if not cores_only:
            contexts.append(hash_(text[a : b + span], 3))
    shift = np.where(near >= 0, near - high, 0)
    return cores, contexts, (low << 16) + (shift << 8) + high - low + 1


def _parsed(keyed: DataFrame, span: int, radius: int, width: int, cores_only: bool) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_pylist()
            for i, j in pieces(texts, 2_000_000):
                core, context, place, key = [], [], [], []
                for text, k in zip(texts[i:j], keys[i:j]):
                    a, b, c = rows_of((text or "").encode(), span, radius, width, cores_only)
                    core += a
                    context += b
                    place.append(c)
                    key.append(np.full(len(a), k, np.int64))
                columns = [np.array(core, np.uint64).view(np.int64)]
                if not cores_only:
                    columns += [np.array(context, np.uint64).view(np.int64), np.concatenate(key), np.concatenate(place)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["core"] if cores_only else ["core", "context", "key", "place"]
    return keyed.select("key", "text").mapInArrow(parse, ", ".join(f"{c} long" for c in names))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key: a number for each different (doc_id, text); the hash is changed until no two share one."""
    seed = 0
    while True:
        keyed = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))
        who = F.struct("doc_id", F.md5("text").alias("m"))
        if keyed.groupBy("key").agg(F.min(who).alias("a"), F.max(who).alias("b")).where("not (a <=> b)").isEmpty():
            return keyed
        seed += 1


def _carried(keyed: DataFrame) -> DataFrame:
    """doc_id, key and the text's bytes, compressed for the way."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            packed = [pa.compress(t, "zstd", asbytes=True) for t in raw]
            sizes = [len(t) for t in raw]
            columns = [*batch.select(["doc_id", "key"]).columns, pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType([keyed.schema["doc_id"]]).add("key", T.LongType()).add("n", T.LongType()).add("packed", T.BinaryType())
    return keyed.mapInArrow(squeeze, schema)


def _unpacked(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, size, "zstd", asbytes=True) if size else b""


def _contexts(carried: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """wanted (core, key, place) with the bytes of each context."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            core, key, place, held = [], [], [], []
            for k, n, packed, own in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "packed", "own"))):
                text = _unpacked(packed, n)
                for w in own:
                    first, many = w["place"] >> 16, w["place"] & 255
                    core.append(w["core"])
                    key.append(k)
                    place.append(w["place"])
                    held.append(text[first : first + many + span - 1])
            longs = [pa.array(c, pa.int64()) for c in (core, key, place)]
            yield pa.RecordBatch.from_arrays([*longs, pa.array(held, pa.binary())], names=["core", "key", "place", "held"])

    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("core", "place")).alias("own"))
    met = carried.select("key", "n", "packed").join(by_text, "key")
    return met.mapInArrow(cut, "core long, key long, place long, held binary")


def sorted_repeats(held: list[bytes], span: int) -> list[np.ndarray]:
    """For the contexts of one core, aligned at their ends, which of their starts are repeated.

    All suffixes of at least `span` bytes are sorted; neighbours that share `span` bytes are repeated.
    """
    suffixes = sorted((c[k : k + span], i, k) for i, c in enumerate(held) for k in range(len(c) - span + 1))
    found = [np.zeros(len(c) - span + 1, bool) for c in held]
    for (a, i, k), (b, j, m) in zip(suffixes, suffixes[1:]):
        if a == b:
            found[i][k] = found[j][m] = True
    return found


def _resolved(contexts: DataFrame, span: int) -> DataFrame:
    """key, place of the repeated starts of contexts whose core is shared."""

    def own(key: list[int], place: list[int], held: list[bytes]) -> Iterator[tuple[int, int]]:
        for flags, k, p in zip(sorted_repeats(held, span), key, place):
            edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).reshape(-1, 2)
            for a, b in edges.tolist():
                yield k, ((p >> 16) + a << 16) + b - a

    def whole_cores(rest: list[list], last: bool) -> pa.RecordBatch:
        """Of the cores that are complete; they leave rest."""
        core, out = rest[0], []
        cuts = [0, *(i for i in range(1, len(core)) if core[i] != core[i - 1]), *([len(core)] if last else [])]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                out += own(*(column[a:b] for column in rest[1:]))
        for column in rest:
            del column[: cuts[-1]]
        columns = zip(*out) if out else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list] = [[], [], [], []]
        for batch in batches:
            for column, more in zip(rest, batch.columns):
                column += more.to_pylist()
            yield whole_cores(rest, False)
        yield whole_cores(rest, True)

    return (
        contexts.select("core", "key", "place", "held").repartition("core").sortWithinPartitions("core")
        .mapInArrow(run, "key long, place long")
    )


def _halves(contexts: DataFrame, width: int, span: int) -> DataFrame:
    """Each context as its nearer and its farther starts, width / 2 at most, below a longer core."""
    half, long = width // 2, F.lit(span - width // 2 + 1)
    c = contexts.selectExpr(
        "core", "key", "held", "shiftright(place, 16) as first", "int(place & 255) as many", "int(shiftright(place, 8) & 255) as shift"
    ).withColumn("near", F.greatest(F.lit(0), F.least("many", F.lit(half) - F.col("shift"))))
    many, shift, near = F.col("many"), F.col("shift"), F.col("near")

    def part(skipped: Column, n: Column, new_shift: Column, core_at: Column) -> Column:
        return F.struct(
            F.xxhash64("core", F.substring("held", core_at, long)).alias("core"), "key",
            ((F.col("first") + skipped) * 65536 + new_shift * 256 + n).alias("place"),
            F.substring("held", skipped + 1, n + (span - 1)).alias("held"),
        )

    nearer = part(many - near, near, shift, shift + many)
    farther = part(F.lit(0), many - near, F.greatest(shift - half, F.lit(0)), shift + many - half)
    parts = F.array_compact(F.array(F.when(near > 0, nearer), F.when(many > near, farther)))
    return c.select(F.explode(parts).alias("p")).select("p.core", "p.key", "p.place", "p.held")


def repeated_starts(docs_keyed: DataFrame, carried: DataFrame, span: int, radius: int, width: int, most: int) -> DataFrame:
    """key, place: all starts of strings of `span` bytes that start anywhere else too."""
    spark = docs_keyed.sparkSession
    folder = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"

    def parked(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    twice = F.col("count") > 1
    cores = _parsed(docs_keyed, span, radius, width, True).groupBy("core").count().where(twice).select("core")
    cores = parked(cores, "cores")
    rows = parked(_parsed(docs_keyed, span, radius, width, False).join(cores, "core", "left_semi"), "rows")
    place = F.min(F.struct("key", "place")).alias("p")
    known = parked(rows.groupBy("core", "context").agg(F.count(F.lit(1)).alias("count"), place), "contexts")
    whole = rows.join(known.where(twice).select("core", "context"), ["core", "context"], "left_semi").select("key", "place")
    open_ = parked(known.groupBy("core").count().where(twice), "open")
    wanted = known.select("core", "p.key", "p.place").join(open_.select("core"), "core", "left_semi")
    contexts = parked(_contexts(carried, wanted, span), "held")
    found = whole
    sizes = open_
    while True:
        heavy = sizes.where(F.col("count") > most).select("core")
        if width == 1 or heavy.isEmpty():
            return found.union(_resolved(contexts, span))
        found = found.union(_resolved(contexts.join(heavy, "core", "left_anti"), span))
        contexts = settled(_halves(contexts.join(heavy, "core", "left_semi"), width, span))
        width //= 2
        sizes = settled(contexts.groupBy("core").count())
        if width == 1:  # a context is now one string, so all of a core are equal
            return found.union(contexts.join(sizes.where(twice).select("core"), "core", "left_semi").select("key", "place"))


def remove_repeats(docs: DataFrame, span: int = SPAN, radius: int = RADIUS, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end in bytes), kept (the other bytes): one row for each row of docs."""
    keyed = _keyed(docs)
    carried = _carried(keyed)
    found = repeated_starts(keyed, carried, span, radius, width, most)
    by_text = found.groupBy("key").agg(F.collect_set("place").alias("places"))
    run = T.StructType().add("start", T.LongType()).add("end", T.LongType())
    schema = T.StructType([docs.schema["doc_id"]]).add("n_bytes", T.LongType()).add("removed", T.ArrayType(run)).add("kept", T.BinaryType())
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, packed, places = (batch.column(c).to_pylist() for c in ("n", "packed", "places"))
            for i, j in _by_bytes(sizes):
                removed, kept = [], []
                for n, p, own in zip(sizes[i:j], packed[i:j], places[i:j]):
                    text = _unpacked(p, n)
                    runs = merged(own or [], span)
                    ends = [0, *(x for r in runs for x in r), n]
                    kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
                    removed.append([{"start": a, "end": b} for a, b in runs])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(sizes[i:j], pa.int64()), pa.array(removed, run_type), pa.array(kept, pa.binary())],
                    names=schema.names,
                )

    return carried.join(by_text, "key", "left").select("doc_id", "n", "packed", "places").mapInArrow(cut, schema)


def _by_bytes(sizes: list[int], limit: int = 16_000_000) -> Iterator[tuple[int, int]]:
    return pieces([range(n) for n in sizes], limit)


def merged(places: list[int], span: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings starting at these places cover."""
    runs: list[list[int]] = []
    for place in sorted(places):  # by first start
        first = place >> 16
        end = first + (place & 255) - 1 + span
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([first, end])
    return [(a, b) for a, b in runs]
