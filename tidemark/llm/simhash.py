"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints are the leaves of a binary trie. Starting from the root paired with itself, the join
walks down pairs of nodes together, adds a bit of error wherever the two branch differently, and
drops a pair as soon as its errors exceed the budget.

Across the cluster the trie is cut where the budget allows it: with at most e differing bits, one of
e + 1 blocks of bits is equal, so each fingerprint joins the subtrie of each of its blocks, and the
walk of a subtrie needs no other. A subtrie with more than `leaf` fingerprints is cut again the same
way over its remaining bits, until all fit; as a subtrie over r bits holds at most 2^r distinct
fingerprints, that ends. Copies share one leaf, so their number never matters. A subtrie emits only
a spanning forest of its links.

Defined cases: null and empty texts have fingerprint 0 and are linked like any other; fewer words
than a shingle count as one shingle; repeated rows each get a result; rows without doc_id keep their
fingerprint and count for no component's smallest id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import settled
from tidemark.llm.components import connected

SEED = 42
SHINGLE = 3
MAX_BITS = 2
LEAF = 2048


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest, seed = xxhash.xxh64_digest, SEED
    raw = np.frombuffer(b"".join([digest(g, seed) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(shingle: int = SHINGLE):
    """A column function: the fingerprint of a whole text, its bits as a long."""

    @F.pandas_udf(T.LongType())
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([simhash(t, shingle) for t in batch], np.uint64).view(np.int64))

    return fp


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: one row for each row of docs."""
    return docs.select("doc_id", fingerprint(shingle)("text").alias("fp"))


def walk(keys: np.ndarray, groups: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of a group that differ in 1 to `budget` bits.

    keys: distinct within a group, sorted by group and value; the keys of a group share their
    first `depth` bits. A node is a range [lo, hi) of keys with a common prefix; all pairs of
    nodes of one depth are taken down a bit at once.
    """
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    many = ends - starts > 1
    a0 = b0 = starts[many]
    a1 = b1 = ends[many]
    errors = np.zeros(len(a0), np.int8)
    ones = np.zeros(len(keys) + 1, np.int64)
    for bit in range(63 - depth, -1, -1):
        if not len(a0):
            break
        np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), out=ones[1:])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        mixed = a0 != b0  # a node with itself has one mixed pair of children, not two
        a0, a1, b0, b1, errors = (
            np.concatenate(parts)
            for parts in zip(
                (a0, am, b0, bm, errors),
                (am, a1, bm, b1, errors),
                (a0, am, bm, b1, errors + 1),
                tuple(x[mixed] for x in (am, a1, b0, bm, errors + 1)),
            )
        )
        alive = (a0 < a1) & (b0 < b1) & (errors <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, errors = (x[alive] for x in (a0, a1, b0, b1, errors))
    return a0, b0


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the links (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _joined(depth: int, budget: int, leaf: int):
    """Links of all subtries of a partition whose rows (path, key, fp) come sorted by path and key."""

    def links(path: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        node = nodes(path, key)
        firsts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        cuts = firsts[np.searchsorted(firsts, np.arange(0, len(key), leaf))[1:] - 1]  # whole subtries, a few leaves at a time
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(key)]):
            if lo < hi:
                i, j = walk(key[lo:hi].view(np.uint64), node[lo:hi], depth, budget)
                root = spanning(hi - lo, i, j)
                child = np.flatnonzero(root != np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(fp[lo + child]), pa.array(fp[lo + root[child]])], names=["a", "b"])

    def nodes(path: np.ndarray, key: np.ndarray) -> np.ndarray:
        head = key.view(np.uint64) >> np.uint64(64 - depth)
        return np.cumsum(np.r_[False, (path[1:] != path[:-1]) | (head[1:] != head[:-1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "key", "fp")))
            path, key, fp = (np.concatenate(x) for x in zip(*held))
            node = nodes(path, key)
            whole = int(np.searchsorted(node, node[-1]))  # the last subtrie may go on in the next batch
            if whole:
                yield from links(path[:whole], key[:whole], fp[:whole])
            held = [(path[whole:], key[whole:], fp[whole:])]
        if held:
            yield from links(*held[0])

    return run


def _cut(rows: DataFrame, depth: int, sizes: list[int]) -> DataFrame:
    """Each row once for each block of its bits below `depth`, that block turned to the top of them."""
    rest = 64 - depth
    low = (1 << rest) - 1 if depth else -1
    own, head = F.col("key").bitwiseAND(F.lit(low)), F.col("key").bitwiseAND(F.lit(~low))
    turned, offset = [], 0
    for k, size in enumerate(sizes):
        around = F.shiftleft(own, offset).bitwiseOR(F.shiftrightunsigned(own, rest - offset)) if offset else own
        turned.append(F.struct((F.col("path") * len(sizes) + k).alias("path"), head.bitwiseOR(around.bitwiseAND(F.lit(low))).alias("key")))
        offset += size
    return rows.select("fp", F.explode(F.array(*turned)).alias("t")).select("fp", "t.path", "t.key")


def near_links(distinct: DataFrame, budget: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """a, b: links whose components are those of all pairs of fingerprints at 1 to `budget` bits.

    distinct: fp, each once. Each round cuts the subtries at hand into budget + 1 blocks; those with
    at most `leaf` fingerprints are walked, the others go into the next round. What a round leaves
    over is written, so that the next one does not repeat it.
    """
    found = None
    rows = distinct.select("fp", F.col("fp").alias("key"), F.lit(0).cast("long").alias("path"))
    depth = 0
    while True:
        rest = 64 - depth
        sizes = [rest // (budget + 1) + (k < rest % (budget + 1)) for k in range(budget + 1)]
        last = rest < leaf.bit_length() or sizes[-1] < 1
        if not last:
            rows = _cut(rows, depth, sizes)
            depth += sizes[-1]  # the smallest block; the larger ones agree in as many bits
        rows = rows.withColumn("head", F.shiftrightunsigned("key", 64 - depth))
        light = rows
        if not last:
            heavy = settled(rows.groupBy("path", "head").count().where(F.col("count") > leaf).select("path", "head"))
            last = heavy.isEmpty()
            if not last:
                light = rows.join(heavy, ["path", "head"], "left_anti")
        links = (
            light.repartition("path", "head").sortWithinPartitions("path", "key").select("path", "key", "fp")
            .mapInArrow(_joined(depth, budget, leaf), "a long, b long")
        )
        if last:
            return links if found is None else found.union(links)
        found = settled(links) if found is None else found.union(settled(links))
        rows = settled(rows.join(heavy, ["path", "head"], "left_semi").select("fp", "key", "path"))


def _classes(docs: DataFrame, shingle: int, budget: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows (doc_id, fp), and fp, root, component_id of each different one."""
    prints = settled(fingerprints(docs, shingle))
    least = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(near_links(least.select("fp"), budget, leaf)).withColumnsRenamed({"node": "fp"})
    rooted = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most `budget` bits."""
    prints, classes = _classes(docs, shingle, budget, leaf)
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """The rows of docs that stay, all columns: of each component the one with the smallest doc_id.

    Among rows of that doc_id the smallest fingerprint, then the smallest text decides, and of equal
    rows one stays. Rows without doc_id can't be told apart by it and all stay.
    """
    prints, classes = _classes(docs, shingle, budget, leaf)
    rows = settled(prints.where("doc_id is not null").join(classes, "fp").select("doc_id", "fp", "root"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("s")).select("s.doc_id", "s.fp")
    again = settled(rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id")))
    gone = settled(rows.join(first, ["doc_id", "fp"], "left_anti").select(F.col("doc_id").alias("id")).distinct())
    whole = docs.select(F.struct("*").alias("row"))  # whatever its columns are called
    alone = whole.join(gone.union(again), F.col("row.doc_id") == F.col("id"), "left_anti")
    if again.isEmpty():
        return alone.select("row.*")
    # Only rows that share their doc_id are looked at one by one.
    shared = whole.join(again, F.col("row.doc_id") == F.col("id"), "left_semi").withColumn("print", fingerprint(shingle)("row.text"))
    shared = shared.join(first, F.expr("row.doc_id = doc_id and print = fp"), "left_semi")
    order = Window.partitionBy("row.doc_id", "print").orderBy("row.text")
    one = shared.withColumn("n", F.row_number().over(order)).where("n = 1").select("row")
    return alone.union(one).select("row.*")
