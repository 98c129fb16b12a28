"""Benchmark decontamination with suffix arrays of the training text.

The training words are cut into shards, runs of whole documents of about `shard_words` words. Each
shard gets a suffix array: its suffixes sorted by their first words, up to the window length. Every
suffix of every benchmark item is then binary-searched in every shard, word by word, which gives its
longest verbatim match, up to the window's length, and all places where that match occurs. A document is hit where a whole
window (13 consecutive words of an item, or a shorter item as a whole) occurs, and contaminated when
enough of its words are hit.

The benchmark is read in blocks of bounded size, one pass of the shards each; a document's hits add
up from block to block in its own row, so no text is shuffled. Only words of the block's items get
numbers of their own; all others share number 0, which no benchmark suffix contains, so searching
finds the same as with all words numbered.

Defined cases: null and empty texts have no words and are never contaminated; items without words
match nothing; repeated documents each get a row; repeated items count once for each item_id; items
with a null item_id hit words but are not listed; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import pieces

WINDOW = 13
SHARD_CHARS = 6_000_000
#: Characters of benchmark text in a block; a block travels to every task.
BLOCK_CHARS = 4_000_000
#: Of bytes: A-Z to lower case, everything that is no word byte to a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(WORD_BYTES).split()


class Block:
    """Items of a benchmark: their suffixes in order, ready to be searched for."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.window = window
        self.ids = [item for item, _ in items]
        texts = [words_of(text) for _, text in items]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        lengths = np.array([len(t) for t in texts], np.int64)
        stream = np.array([self.number[w] for t in texts for w in t], np.int32)
        # A suffix is searched as far as its item goes, but no further than the window.
        self.item = np.repeat(np.arange(len(texts)), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(stream))
        self.reach = np.minimum(left, window)
        self.needed = np.minimum(np.repeat(lengths, lengths), window)  # a match of so many words is a hit
        self.words = np.zeros((len(stream), window), np.int32)
        padded = np.r_[stream, np.zeros(window, np.int32)]
        for k in range(window):
            self.words[:, k] = np.where(k < left, padded[k : k + len(stream)], 0)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the numbered words sorted by the `depth` words from there.

    Suffixes that start with number 0 match nothing and are left out, and a suffix counts as ended
    at its first 0 or document end. Words are packed into keys of 63 bits, which are sorted together.
    """
    at = np.flatnonzero(words > 0)
    bits = max(1, int(words.max(initial=1)).bit_length())
    each = 63 // bits
    padded = np.r_[words, np.full(depth, -1, words.dtype)]
    keys, alive = [], np.ones(len(at), bool)
    for first in range(0, depth, each):
        key = np.zeros(len(at), np.int64)
        for k in range(first, min(first + each, depth)):
            word = padded[at + k]
            alive &= word > 0
            key = (key << bits) | np.where(alive, word, 0)
        keys.append(key)
    return at[np.lexsort(keys[::-1])]


def search(words: np.ndarray, order: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix of the block: words of its longest match, and the range of order that has it."""
    n, q = len(order), len(block.reach)
    padded = np.r_[words, np.full(block.window, -1, words.dtype)]
    lo, hi, length = np.zeros(q, np.int64), np.full(q, n, np.int64), np.zeros(q, np.int64)
    live = np.arange(q if n else 0)
    for k in range(block.window):
        live = live[block.reach[live] > k]
        if not len(live):
            break
        word = block.words[live, k]
        ends = []
        for right in (False, True):
            a, b = lo[live], hi[live]
            while (wide := a < b).any():  # all searches halve their ranges together
                mid = (a + b) >> 1
                there = padded[order[np.minimum(mid, n - 1)] + k]
                below = there <= word if right else there < word
                a, b = np.where(wide & below, mid + 1, a), np.where(wide & ~below, mid, b)
            ends.append(a)
        found = ends[0] < ends[1]
        live = live[found]
        lo[live], hi[live], length[live] = ends[0][found], ends[1][found], k + 1
    return length, lo, hi


def matches(texts: list[str | None], block: Block) -> list[tuple[int, list[dict], list[str]]]:
    """For each text of a shard: its number of words, hit runs of words, items with occurring windows."""
    number, sizes, stream = block.number.get, [], []
    for text in texts:
        own = words_of(text)
        sizes.append(len(own))
        stream += [number(w, 0) for w in own]
        stream.append(-1)  # no match crosses the end of a document
    words = np.array(stream, np.int32)
    out: list[tuple[int, list[dict], list[str]]] = [(n, [], []) for n in sizes]
    order = suffix_array(words, block.window)
    length, lo, hi = search(words, order, block)
    whole = np.flatnonzero((length > 0) & (length >= block.needed))
    if not len(whole):
        return out
    at = np.concatenate([order[lo[s] : hi[s]] for s in whole])
    times = (hi - lo)[whole]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + np.repeat(length[whole], times), -1)
    inside = np.r_[False, np.cumsum(cover) > 0]
    firsts = np.r_[0, np.cumsum(np.array(sizes, np.int64) + 1)]
    for a, b in np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).tolist():
        d = int(np.searchsorted(firsts, a, "right")) - 1
        out[d][1].append({"start": int(a - firsts[d]), "end": int(b - firsts[d])})
    owner = np.repeat(block.item[whole], times)
    doc = np.searchsorted(firsts, at, "right") - 1
    for d, item in np.unique(np.stack([doc, owner], axis=1), axis=0).tolist():
        if block.ids[item] is not None:
            out[d][2].append(block.ids[item])
    return out


def blocks(benchmark: DataFrame, window: int, limit: int) -> Iterator[Block]:
    """The benchmark a block at a time. The blocks of all passes travel in their tasks' closures, so a
    benchmark must fit the driver's memory, at about 60 bytes a word."""
    held: list[tuple[str | None, str | None]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= limit:
            yield Block(held, window)
            held, size = [], 0
    if held:
        yield Block(held, window)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs: doc_id, digest (MD5 of the text), n_words, runs, items.

    runs: array of (start, end) in words, sorted, of the verbatim matches; items: item_ids as
    strings, sorted, each once.
    """
    rows = docs.select("doc_id", F.md5("text").alias("digest"), "text")
    run_of_words = T.StructType().add("start", T.LongType()).add("end", T.LongType())
    schema = T.StructType([rows.schema["doc_id"], rows.schema["digest"]]).add("n_words", T.LongType())
    schema = schema.add("runs", T.ArrayType(run_of_words)).add("items", T.ArrayType(T.StringType()))

    def one(block: Block) -> DataFrame:
        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for a, b in pieces(texts, SHARD_CHARS):
                    n, runs, items = zip(*matches(texts[a:b], block))
                    found = [pa.array(n, pa.int64()), pa.array(runs, runs_type), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.select(["doc_id", "digest"]).slice(a, b - a).columns, *found], names=schema.names
                    )

        return rows.mapInArrow(run, schema)

    passes = [one(block) for block in blocks(benchmark, window, limit)] or [one(Block([], window))]
    found = reduce(DataFrame.union, passes)
    # Equal rows have equal results in every pass, so a group's passes add up and its copies come back.
    grouped = found.groupBy("doc_id", "digest").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / len(passes)).cast("int").alias("copies"),
    )
    return grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_CHARS) -> DataFrame:
    """hits() with n_hit, longest (words of the longest hit run, windows that meet joined) and contaminated."""
    step = "struct(a.n + greatest(r.end - greatest(r.start, a.e), 0L) as n, greatest(a.e, r.end) as e)"
    n_hit = F.expr(f"aggregate(runs, struct(0L as n, 0L as e), (a, r) -> {step}, a -> a.n)")
    longest = F.expr("coalesce(array_max(transform(runs, r -> r.end - r.start)), 0L)")
    found = hits(docs, benchmark, window, limit).withColumn("n_hit", n_hit).withColumn("longest", longest)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, all columns."""
    bad = judge(docs, benchmark, window).where("contaminated").select("doc_id", "digest").distinct()
    rows = docs.select(F.struct("*").alias("row"))  # whatever its columns are called
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.md5("row.text") == F.col("digest"))
    return rows.join(bad, same, "left_anti").select("row.*")
