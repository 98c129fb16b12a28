"""Packing token sequences by minimum bin slack.

A document is its token ids and an end id, cut every `capacity` ids; what is shorter than a whole
sequence is a remainder. Remainders matter only by length, so a histogram of at most `capacity`
counts describes them all, however many there are. Each window takes the longest remainder left and
fills the rest by a subset sum over bitsets: bit s of a row says whether some of the lengths taken so
far add up to s. Walking back over the rows gives how many of each length the window takes. A window
is used as often as the counts allow, so the plan has at most a few windows per length.

Pieces are then numbered within their length and looked up in the plan. Numbers come from two
levels, a count by length and bucket and a number within, so no task holds all pieces of a length.

Padding: a sequence is padded to `capacity` unless its length is a power of two.
Defined cases: null and empty texts are the end id alone; repeated rows are packed each; rows without
doc_id are packed like others; an empty table gives no pieces. With `special`, as in the queries, the
file's added tokens in a text get their own ids, as from `tokenizers` by default; without it they are
ordinary text.
"""

from __future__ import annotations

import array
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import settled

CAPACITY = 2048
END = 1
BUCKETS = 256


def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE vocabulary in a tokenizers file."""
    vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens and ids of a tokenizers file; only those found as they stand, anywhere in a text."""
    added = json.load(open(path, encoding="utf-8"))["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that match otherwise than as they stand")
    return {t["content"]: t["id"] for t in added}


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END, special: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: one row for each piece of at most `capacity` ids."""
    ranks, added = byte_ranks(path), added_tokens(path) if special else {}
    schema = T.StructType([docs.schema["doc_id"]])
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema.add(name, T.LongType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column("text")):
                ids = coder.encode(text.as_py() or "", allowed_special="all")
                ids.append(end)
                raw = memoryview(array.array("I", ids).tobytes())
                for start in range(0, len(ids), capacity):
                    row.append(i)
                    own = raw[4 * start : 4 * (start + capacity)]
                    out.append((start, len(own) // 4, zlib.crc32(own), len(ids)))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *columns], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def fill(counts: dict[int, int], room: int, taken: int, capacity: int) -> dict[int, int]:
    """Of counts (length: how many), those whose sum leaves a window with `taken` ids least slack."""
    rows: list[tuple[int, int, int]] = []  # length, copies, sums reachable before them
    reach = 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        copies, part = min(counts[length], room // length), 1
        while copies and not reach >> room & 1:
            part = min(part, copies)  # 1, 2, 4, ... copies at a time reach every number of copies
            rows.append((length, part, reach))
            reach |= (reach << length * part) & ((1 << room + 1) - 1)
            copies -= part
            part *= 2
    slack = lambda s: 0 if (taken + s) & (taken + s - 1) == 0 else capacity - taken - s
    total = min((s for s in range(room + 1) if reach >> s & 1), key=lambda s: (slack(s), -s)) if not reach >> room & 1 else room
    used: dict[int, int] = {}
    for length, part, before in reversed(rows):
        if not before >> total & 1:  # this sum needs the row's copies
            used[length] = used.get(length, 0) + part
            total -= length * part
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, each, sequence, offset).

    Pieces of a length with ranks in [rank_from, rank_to) go `each` to a sequence, from `sequence`
    on, the first of them at `offset`.
    """
    left = {length: n for length, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        window = fill(left, capacity - longest, longest, capacity)
        left[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        times = min(left[length] // each for length, each in window.items())
        offset = 0
        for length, each in sorted(window.items(), reverse=True):
            rows.append((length, used[length], used[length] + times * each, each, sequence, offset))
            used[length] += times * each
            left[length] -= times * each
            if not left[length]:
                del left[length]
            offset += length * each
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END, buckets: int = BUCKETS, special: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset: one row for each piece."""
    cut = settled(pieces(docs, path, pattern, capacity, end, special))
    counts = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}
    rows = plan(counts, capacity)
    columns = ("length", "rank_from", "rank_to", "each", "sequence", "at")
    planned = docs.sparkSession.createDataFrame(rows, ", ".join(f"{c} long" for c in columns))

    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("n", F.row_number().over(within)).join(firsts, ["length", "bucket"])
        .withColumn("rank", F.col("first") + F.col("n") - 1)
    )
    # The plan has a few rows for each of at most `capacity` lengths, whatever the input.
    p, r = F.broadcast(planned).alias("p"), ranked.alias("r")
    found = (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.rank_from")) & (F.col("r.rank") < F.col("p.rank_to"))
    own = F.col("r.rank") - F.col("p.rank_from")
    return r.join(p, found).select(
        "r.doc_id", "r.start", "r.length", "r.ids_crc32", "r.doc_tokens",
        (F.col("p.sequence") + F.floor(own / F.col("p.each"))).alias("sequence_id"),
        (F.col("p.at") + own % F.col("p.each") * F.col("r.length")).alias("offset"),
    )
