"""Perplexity of documents under an interpolated modified Kneser-Ney model of word trigrams.

Words are runs of letters, runs of digits, single other signs, line ends, and single characters of
scripts written without blanks. An n-gram is a 64-bit hash. Documents lie in chunks of about CHUNK
characters, written once as numbers of words with the words they stand for. All n-grams are counted
and asked for in PASSES passes, each over a share of the range of bigrams' hashes. In a pass a chunk
sends, in sorted blocks, to the task that owns a part of that share: its distinct bigrams; its distinct
trigrams that begin with one of them, with how often trusted texts have them; and the distinct trusted
trigrams that end with one. So the owner has all that is known of a bigram: it counts the trigrams and
adds up the context (total and number of n-grams with counts 1, 2, 3 or more), finds how many different
words the bigram follows, answers each chunk in the order sent, and passes on what single words need.
Those are counted and asked for in one more step. So the tables of counts lie partitioned by hash, no
more than a pass's share is on disk at a time, and nothing but counts of counts comes to the driver. At
last, a share of the chunks at a time, the answers meet the words, and log-probabilities are summed by
document.

A trusted document is scored as if it had not been counted: its own trigrams are taken out of the
counts of all orders, exactly, before its words are scored; discounts are those of all texts. Else its
perplexity would tell how long it is remembered, and not how a text of its kind fares.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import settled, shared_folder

CHUNK = 3_000_000
CHUNKS_IN_RANGE = 8  # n-grams of so many chunks make a range of hashes
PASSES = 10  # over the bigrams; the words of a bigram tell its pass
LEAST_RANGES = 12  # in a pass, and of words
SHARES = 6  # of the chunks, scored one after the other
LOWER, STATS = SHARES, SHARES + 1  # beside the answers of each share
BATCH = 1_000_000  # characters whose words are hashed together
WORDS = 100_000  # of whole documents, scored together
ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
LETTERS, DIGITS = rf"[^\W\d_{ALONE}]+", rf"[^\D{ALONE}]+"
WORD = re.compile(rf"[{ALONE}]|{LETTERS}|\d+|\n+|[^\w\s]|_")
TIMES = np.uint64(0x9E3779B97F4A7C15)
HIGH, LOW = np.uint64(0xFFFF << 48), np.uint64(16)  # a trigram's hash has the first 16 bits of one of its bigrams


def words(text: str) -> list[str]:
    return [w if w[0] != "\n" else "\n" for w in WORD.findall(text.lower())]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def joined(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram and a word after it."""
    return mixed(left * TIMES + word)


def second(bigram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of a bigram's other word: joined() loses nothing."""
    return unmixed(bigram) - first * TIMES


def compressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def packed(*columns: np.ndarray, rising: bool = True) -> bytes:
    """Columns of equal length, the first sorted if rising; differences and byte planes compress well."""
    n, out, widths = len(columns[0]), [], []
    for i, c in enumerate(columns):
        c = c.astype(np.uint64)
        c = np.diff(c, prepend=np.uint64(0)) if i == 0 and rising else c
        widths.append(-(-int(c.max()).bit_length() // 8) if n else 0)
        out.append(c.view(np.uint8).reshape(-1, 8)[:, : widths[-1]].T.tobytes())
    return compressed(np.array([n, rising, len(columns), *widths], np.uint64).tobytes() + b"".join(out))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = restored(data)
    n, rising, k = (int(x) for x in np.frombuffer(raw[:24], np.uint64))
    widths = np.frombuffer(raw, np.uint64, k, 24).astype(int).tolist()
    at, columns = 24 + 8 * k, []
    for width in widths:
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        columns.append(c.view(np.uint64).reshape(n))
        at += n * width
    if rising:
        columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns


def by_first(n: np.ndarray) -> np.ndarray:
    return np.argsort(np.minimum(n, 65535).astype(np.uint16), kind="stable")


def grouped(n: np.ndarray, *others: np.ndarray) -> bytes:
    """Columns packed, all but the first in its order: what goes with the same count is much alike."""
    order = by_first(n)
    return packed(n, *[c[order] for c in others], rising=False)


def ungrouped(data: bytes) -> list[np.ndarray]:
    n, *others = unpacked(data)
    order, back = by_first(n), []
    for c in others:
        back.append(np.empty_like(c))
        back[-1][order] = c
    return [n, *back]


def starts(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[starts(keys)]


def ranked(keys: np.ndarray, of_pass: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The number of distinct keys, and the place of each key among them, pass by pass."""
    order = np.argsort(keys)
    if of_pass is not None:
        order = order[np.argsort(of_pass[order], kind="stable")]
    first = starts(keys[order])
    back = np.empty(len(keys), np.int32)
    back[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(keys)))
    return len(first), back


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, a place of each, and their sums of values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = starts(keys)
    return keys[first], order[first], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def edges(ranges: int) -> list[int]:
    """Where ranges of hashes begin, and the end of the last. The first 16 bits of a hash tell its range."""
    return [min(65536, i * 65536 // ranges) << 48 for i in range(ranges + 1)]


def dealt(hashes: np.ndarray, bounds: list[int]) -> list[slice]:
    """Of sorted hashes the part in each range."""
    at = [len(hashes) if b == 1 << 64 else int(np.searchsorted(hashes, np.uint64(b))) for b in bounds]
    return [slice(a, b) for a, b in zip(at, at[1:])]


@cache
def kinds() -> np.ndarray:
    """Of each character: 0 belongs to no word, 1 is one, 2 to 4 are parts of runs of letters, digits and line ends, 5 is one or goes on after digits."""
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    kind = np.ones(0x110000, np.uint8)
    for of, pattern in ((0, r"\s+"), (2, LETTERS), (5, r"\d+"), (3, DIGITS), (4, r"\n+")):
        for m in re.finditer(pattern, every):
            kind[m.start() : m.end()] = of
    return kind


def hashed(characters: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that follow one another without gaps."""
    at = np.arange(len(characters), dtype=np.uint64) - np.repeat(first, sizes).astype(np.uint64)
    return mixed(np.add.reduceat(mixed((at << np.uint64(21)) + characters.astype(np.uint64) + np.uint64(1)), first)) if len(first) else np.zeros(0, np.uint64)


def hashed_words(listed: bytes) -> np.ndarray:
    """Hashes of words with blanks between them."""
    raw = np.frombuffer(listed, np.uint8)
    blanks = np.flatnonzero(raw == 32)
    sizes = np.diff(blanks, prepend=-1, append=len(raw)) - 1
    return hashed(raw[raw != 32], np.cumsum(sizes) - sizes, sizes)


def found_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """As words(): the numbers of words of texts, hashes of all words, and the distinct ones with their hashes."""
    sizes, hashes, names = [], [], {}
    start = 0
    while start < len(texts):
        stop, lowered, held = start, [], 0
        while stop < len(texts) and (held < BATCH or not lowered):
            lowered.append(texts[stop].lower())
            held += len(lowered[-1]) + 1
            stop += 1
        whole = " ".join(lowered) + " "
        characters = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = kinds()[characters]
        new = kind != 0
        new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        first = np.flatnonzero(new) if not (kind == 5).any() else np.array([m.start() for m in WORD.finditer(whole)], np.int64)
        # A line end stands for a run of them.
        word = (kind != 0) & ((kind != 4) | new)
        own = np.add.reduceat(word, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        h = hashed(characters[word], np.cumsum(own) - own, own)
        ends = np.cumsum([len(t) + 1 for t in lowered])
        sizes.append(np.diff(np.searchsorted(first, ends), prepend=0))
        hashes.append(h)
        codes, listed = pd.factorize(h)
        at = np.empty(len(listed), np.int64)
        at[codes[::-1]] = np.arange(len(h))[::-1]
        names |= {k: whole[a : a + n] for k, a, n in zip(listed.tolist(), first[at].tolist(), own[at].tolist()) if k not in names}
        start = stop
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *sizes]), np.concatenate([none.astype(np.uint64), *hashes]), list(names.values()), np.array(list(names), np.uint64)


def coded(texts: list[str]) -> tuple[np.ndarray, bytes, bytes]:
    """The numbers of words of texts; distinct words, the frequent ones first; the places of all words among them, with two line ends before each text."""
    sizes, hashes, listed, known = found_words(texts)
    if "\n" not in listed:
        listed, known = [*listed, "\n"], np.append(known, hashed(np.array([10]), np.array([0]), np.array([1])))
    padded = np.full(len(hashes) + 2 * len(sizes), known[listed.index("\n")], np.uint64)
    padded[np.arange(len(hashes)) + 2 * (np.repeat(np.arange(len(sizes)), sizes) + 1)] = hashes
    codes = pd.Index(known).get_indexer(padded)
    alphabetical = np.array(sorted(range(len(listed)), key=listed.__getitem__), np.int64)
    order = alphabetical[np.argsort(-np.bincount(codes, minlength=len(listed))[alphabetical], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return sizes, compressed(" ".join([listed[i] for i in order.tolist()]).encode()), packed(rank[codes], rising=False)


class Grams:
    """A chunk's words by position, with two line ends before each text."""

    def __init__(self, row: dict) -> None:
        self.sizes, self.trusted = unpacked(row["sizes"])[0].astype(np.int64), unpacked(row["trusted"])[0].astype(bool)
        self.known = hashed_words(restored(row["vocabulary"]))
        self.code = unpacked(row["codes"])[0].view(np.int64)
        starts = np.cumsum(self.sizes + 2) - self.sizes - 2
        self.pad = np.zeros(len(self.code) + 1, np.uint8)
        self.pad[starts], self.pad[starts + 1], self.pad[-1] = 1, 2, 1
        part = (self.known % np.uint64(PASSES)).astype(np.uint8)[self.code]
        self.of_pass = np.zeros(len(part), np.uint8)  # of the bigram that ends here
        self.of_pass[1:] = part[1:] + part[:-1]
        self.of_pass -= PASSES * (self.of_pass >= PASSES).astype(np.uint8)

    def bigrams(self, ends: np.ndarray) -> np.ndarray:
        return joined(self.known[self.code[ends - 1]], self.known[self.code[ends]])

    def trigrams(self, ends: np.ndarray, left: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Hashes of trigrams, in the range of a bigram near; left are the bigrams they begin with."""
        return (near & HIGH) | (joined(left, self.known[self.code[ends]]) >> LOW)


CODED = "chunk long, doc_id array<{}>, lang array<{}>, sizes binary, trusted binary, vocabulary binary, codes binary"
SENT = "place long, chunk long, bigrams binary, trigrams binary, heads binary, tails binary, firsts binary"
TOLD = "part int, k long, place long, chunk long, payload binary, more binary, numbers array<long>"


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, types[k]) for c, k in zip(columns, kinds)], names=list(names))


def emitted(row: dict, bounds: list[int], p: int) -> list[tuple]:
    """What a chunk has in the ranges of a pass."""
    g = Grams(row)
    own = np.repeat(g.trusted, g.sizes + 2)
    ends = np.flatnonzero((g.of_pass == p) & (g.pad[:-1] != 1))
    every = g.bigrams(ends)
    bigrams, at, _ = summed(every)
    firsts = g.known[g.code[ends[at] - 1]]

    def offsets(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How far after the first bigram with the same 16 bits."""
        return np.searchsorted(bigrams, of) - np.searchsorted(bigrams, keys & HIGH)

    here = g.pad[ends + 1] != 1
    left = every[here]
    trigrams, at, (n,) = summed(g.trigrams(ends[here] + 1, left, left), own[ends[here]].astype(np.int64))
    counted = n > 0
    held = offsets(trigrams[counted], left[at[counted]])
    here = own[ends] & (g.pad[ends] == 0)
    right = every[here]
    tails, at, _ = summed(g.trigrams(ends[here], g.bigrams(ends[here] - 1), right))
    ended = offsets(tails, right[at])
    rows, before = [], np.concatenate([[0], np.cumsum(counted)])
    for i, (b, t, s) in enumerate(zip(dealt(bigrams, bounds), dealt(trigrams, bounds), dealt(tails, bounds)), p * (len(bounds) - 1)):
        if b.start < b.stop:
            last = distinct(np.searchsorted(bigrams[b], tails[s] & HIGH) + ended[s])
            heads = held[before[t.start] : before[t.stop]]
            rows.append((i, row["chunk"], packed(bigrams[b]), packed(trigrams[t], n[t]), packed(heads, rising=False), packed(tails[s], ended[s]), packed(firsts[b][last], rising=False)))
    return rows


def found(asked: np.ndarray, keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    if not len(keys):
        return [np.zeros(len(asked), np.int64) for _ in values]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return [np.where(keys[at] == asked, v[at], 0) for v in values]


def gathered(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts)]


def excess(total: np.ndarray, *by_count: np.ndarray) -> list[np.ndarray]:
    """The total as far as the numbers of n-grams with counts 1, 2, 3 or more don't tell it, mostly nought."""
    return [total - sum(i * x for i, x in enumerate(by_count, 1)), *by_count]


def classes(n: np.ndarray) -> list[np.ndarray]:
    """The numbers of n-grams with counts 1, 2, 3 or more, as one adds them up."""
    return [(np.minimum(n, 3) == i).astype(np.int64) for i in (1, 2, 3)]


def told(k: int, n: np.ndarray) -> tuple:
    return (STATS, k, 0, 0, None, None, [len(n), int(n.sum()), *[int((n == i).sum()) for i in (1, 2, 3, 4)]])


def counted(group: pa.Table, bounds: list[int]) -> pa.Table:
    """What owns a range of bigrams does: add up, answer, and pass on what single words, dealt by bounds, need."""
    place, received, heads, tails, firsts = group.column("place")[0].as_py(), group.to_pylist(), [], [], []
    for r in received:
        (own,), (trigrams, n) = unpacked(r["bigrams"]), unpacked(r["trigrams"])
        held = n > 0
        keys = trigrams[held]
        heads.append([keys, n[held].astype(np.int64), own[np.searchsorted(own, keys & HIGH) + unpacked(r["heads"])[0].astype(np.int64)]])
        keys, offset = unpacked(r["tails"])
        at = np.searchsorted(own, keys & HIGH) + offset.astype(np.int64)
        tails.append([keys, own[at]])
        firsts.append([own[distinct(at)], unpacked(r["firsts"])[0]])
    keys, n, owner = gathered(heads)
    trigrams, at, (n,) = summed(keys, n)
    context, _, sums = summed(owner[at], n, *classes(n))
    keys, owner = gathered(tails)
    owner = owner[summed(keys)[1]]
    bigrams, _, (times,) = summed(owner, np.ones(len(owner), np.int64))
    keys, first = gathered(firsts)
    first = first[summed(keys)[1]]  # in the order of bigrams
    rows = [told(3, n), told(2, times)]
    left, _, lower = summed(first, times, *classes(times))
    right, _, (follows,) = summed(second(bigrams, first), np.ones(len(bigrams), np.int64))
    for i, (a, b) in enumerate(zip(dealt(left, bounds), dealt(right, bounds))):
        if a.start < a.stop or b.start < b.stop:
            rows.append((LOWER, 1, i, 0, packed(left[a], *[x[a] for x in lower]), packed(right[b], follows[b]), None))
    for r in received:
        (asked,), (three, _) = unpacked(r["bigrams"]), unpacked(r["trigrams"])
        answer = [*found(asked, bigrams, [times]), *excess(*found(asked, context, sums))]
        rows.append((r["chunk"] % SHARES, 2, place, r["chunk"], grouped(*answer), grouped(*found(three, trigrams, [n])), None))
    return table_of(rows, TOLD)


def summed_words(received: list[dict]) -> tuple[np.ndarray, ...]:
    """Words as contexts with their sums, and words with the numbers of words that they follow."""
    none = np.zeros(0, np.uint64)
    left, *lower = gathered([[none] * 5, *(unpacked(r["payload"]) for r in received)])
    context, _, sums = summed(left, *[x.astype(np.int64) for x in lower])
    right, times = gathered([[none] * 2, *(unpacked(r["more"]) for r in received)])
    last, _, (n,) = summed(right, times.astype(np.int64))
    return context, sums, last, n


def merged(group: pa.Table) -> pa.Table:
    """What passes have told of a range of words, in one row."""
    place = group.column("place")[0].as_py()
    context, sums, last, n = summed_words(group.to_pylist())
    return table_of([(LOWER, 1, place, 0, packed(context, *sums), packed(last, n), None)], TOLD)


def counted_words(group: pa.Table) -> pa.Table:
    """What owns a range of words does with what the owners of bigrams passed on."""
    place, received = group.column("place")[0].as_py(), group.to_pylist()
    context, sums, last, n = summed_words([r for r in received if r["part"] == LOWER])
    rows = [told(1, n)]
    for r in received:
        if r["part"] != LOWER:
            (asked,) = unpacked(r["payload"])
            answer = [*found(asked, last, [n]), *excess(*found(asked, context, sums))]
            rows.append((r["part"], 1, place, r["chunk"], grouped(*answer), None, None))
    return table_of(rows, TOLD)


def answers(rows: list[dict], k: int, column: str) -> list[np.ndarray]:
    """Counts of a chunk's n-grams pass by pass, in the order of their hashes."""
    narrow = lambda c: c.astype(np.int32 if not len(c) or c.max() < 1 << 31 else np.int64)
    parts = [[narrow(c) for c in ungrouped(r[column])] for r in sorted(rows, key=lambda r: r["place"]) if r["k"] == k]
    n, *context = gathered(parts)
    if context:
        context[0] = context[0].astype(np.int64) + sum(i * x for i, x in enumerate(context[1:], 1))
    return [n, *context]


def pairs(doc: np.ndarray, gram: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, n-gram): a position of each, and the pair of each position."""
    _, first, back = np.unique(doc * np.int64(max(most, 1)) + gram, return_index=True, return_inverse=True)
    return first, back, np.bincount(back, minlength=len(first))


def change(old: np.ndarray, new: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """How the total and the numbers of n-grams with counts 1, 2, 3 or more change, by owner."""
    at = lambda i: (np.minimum(new, 3) == i).astype(float) - (np.minimum(old, 3) == i)
    return np.stack([np.bincount(owner, x, size) for x in (new - old, at(1), at(2), at(3))])


def log_probabilities(g: Grams, found: dict[int, list[np.ndarray]], stats: dict[int, list[int]], cuts: dict[int, tuple]) -> np.ndarray:
    """Of each word after the two before it; without the document's own counts where it is trusted."""
    n3, (n2, *c2), (n1, *c1) = found[3][0], found[2], found[1]
    docs = np.repeat(np.arange(len(g.sizes), dtype=np.int32), g.sizes)
    at, ends = np.flatnonzero(g.pad[:-1] == 0), np.flatnonzero(g.pad[:-1] != 1)
    every = g.bigrams(ends)
    bigram = np.zeros(len(g.code), np.int32)
    _, bigram[ends] = ranked(every, g.of_pass[ends])
    left = np.zeros(len(g.code), np.uint64)
    left[ends] = every
    _, i3 = ranked(g.trigrams(at, left[at - 1], left[at - 1]), g.of_pass[at - 1])
    del every, left, ends
    _, word = ranked(g.known)
    uv, vw, v, w = bigram[at - 1], bigram[at], word[g.code[at - 1]], word[g.code[at]]
    whole = np.array([stats[1][1], stats[1][2], stats[1][3], stats[1][0] - stats[1][2] - stats[1][3]], float)

    def level(n: np.ndarray, context: np.ndarray, lower: np.ndarray, k: int) -> np.ndarray:
        cut = np.array([0.0, *cuts[k]])
        total = context[0]
        backoff = cut[1] * context[1] + cut[2] * context[2] + cut[3] * context[3]
        p = (n - cut[np.minimum(n, 3)] + backoff * lower) / np.maximum(total, 1)
        return np.where(total > 0, p, lower)

    def others(at: np.ndarray) -> np.ndarray:
        p = level(n1[w[at]], whole[:, None], np.full(len(at), 1 / (stats[1][0] + 1)), 1)
        p = level(n2[vw[at]], np.stack([c[v[at]] for c in c1]).astype(float), p, 2)
        return level(n3[i3[at]], np.stack([c[uv[at]] for c in c2]).astype(float), p, 3)

    def without(at: np.ndarray) -> np.ndarray:
        doc = docs[at] - docs[at[0]]
        first3, at3, times = pairs(doc, i3[at], len(n3))
        old3 = n3[i3[at][first3]]
        new3 = old3 - times
        f_uv, at_uv, _ = pairs(doc, uv[at], len(n2))
        f_vw, at_vw, _ = pairs(doc, vw[at], len(n2))
        f_v, at_v, _ = pairs(doc, v[at], len(n1))
        f_w, at_w, _ = pairs(doc, w[at], len(n1))
        ctx_uv = np.stack([c[uv[at][f_uv]] for c in c2]) + change(old3, new3, at_uv[first3], len(f_uv))
        gone3 = ((old3 > 0) & (new3 == 0)).astype(float)
        old2 = n2[vw[at][f_vw]]
        new2 = old2 - np.bincount(at_vw[first3], gone3, len(f_vw)).astype(np.int64)
        ctx_v = np.stack([c[v[at][f_v]] for c in c1]) + change(old2, new2, at_v[f_vw], len(f_v))
        gone2 = ((old2 > 0) & (new2 == 0)).astype(float)
        old1 = n1[w[at][f_w]]
        new1 = old1 - np.bincount(at_w[f_vw], gone2, len(f_w)).astype(np.int64)
        ctx = whole[:, None] + change(old1, new1, doc[f_w], doc[-1] + 1)
        p = level(new1[at_w], ctx[:, doc], np.full(len(at), 1 / (stats[1][0] + 1)), 1)
        p = level(new2[at_vw], ctx_v[:, at_v], p, 2)
        return level(new3[at3], ctx_uv[:, at_uv], p, 3)

    own = g.trusted[docs]
    p, start, stops = np.empty(len(docs)), 0, np.cumsum(g.sizes)
    while start < len(docs):
        stop = int(stops[min(np.searchsorted(stops, start + WORDS), len(stops) - 1)])
        here = np.arange(start, stop)
        for at, of in ((here[~own[start:stop]], others), (here[own[start:stop]], without)):
            if len(at):
                p[at] = of(at)
        start = stop
    return np.log(p)


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        payload = pa.array([compressed(t) for t in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), payload], names=["doc_id", "lang", "payload"])


def chunked(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """One row for each chunk of about so many characters, numbered apart from those of other tasks."""
    rows: list[pa.RecordBatch] = []
    texts: list[str] = []
    number = count(TaskContext.get().partitionId() * ((1 << 32) + 1))  # so that even first chunks fall to all shares

    def made() -> pa.RecordBatch:
        together = pa.Table.from_batches(rows)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), together.column(c).combine_chunks()) for c in ("doc_id", "lang")]
        trusted = np.array([bool(x) for x in together.column("trusted").to_pylist()], np.int64)
        sizes, vocabulary, codes = coded(texts)
        own = [packed(sizes, rising=False), packed(trusted, rising=False), vocabulary, codes]
        columns = [pa.array([next(number)], pa.int64()), *lists, *[pa.array([x], pa.binary()) for x in own]]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_id", "lang", "sizes", "trusted", "vocabulary", "codes"])

    held = 0
    for batch in batches:
        start = 0
        for i, payload in enumerate(batch.column("payload")):
            texts.append(restored(payload.as_py()).decode())
            held += len(texts[-1])
            if held >= chunk:
                rows.append(batch.slice(start, i + 1 - start))
                yield made()
                start, held = i + 1, 0
                rows.clear()
                texts.clear()
        if start < batch.num_rows:
            rows.append(batch.slice(start))
    if texts:
        yield made()


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries run here leave no shuffle files behind when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def perplexity(docs: DataFrame, trusted: DataFrame, discounts, chunk: int = CHUNK) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity: one row for each row of docs; the model is of those in trusted."""
    with shuffles_dropped(docs.sparkSession):
        return scored(docs, trusted, discounts, chunk)


def scored(docs: DataFrame, trusted: DataFrame, discounts, chunk: int) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/kneser-ney-{uuid.uuid4().hex}"
    id_type, lang_type = docs.schema["doc_id"].dataType, docs.schema["lang"].dataType

    # Rows without doc_id are never trusted.
    rows = docs.select("doc_id", "lang", "text").mapInArrow(squeezed, T.StructType().add("doc_id", id_type).add("lang", lang_type).add("payload", T.BinaryType()))
    ids = trusted.select(F.col("doc_id").cast(id_type).alias("doc_id")).where("doc_id is not null").distinct()
    flagged = rows.join(ids.withColumn("trusted", F.lit(True)), "doc_id", "left")
    coded_schema = CODED.format(id_type.simpleString(), lang_type.simpleString())
    flagged.mapInArrow(lambda batches: chunked(batches, chunk), coded_schema).write.parquet(f"{folder}/chunks")
    chunks = spark.read.schema(coded_schema).parquet(f"{folder}/chunks")

    def emptied(name: str) -> None:
        spark.createDataFrame([], "nothing int").write.mode("overwrite").parquet(f"{folder}/{name}")

    in_pass = max(LEAST_RANGES, -(-chunks.count() // (CHUNKS_IN_RANGE * PASSES)))
    bounds = edges(in_pass)
    columns = [c.split(" ")[0] for c in TOLD.split(", ")]
    read = lambda name: spark.read.schema(TOLD).parquet(f"{folder}/{name}").select(*columns)
    for p in range(PASSES):

        def send(batches: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from table_of(emitted(batch.slice(i, 1).to_pylist()[0], bounds, p), SENT).to_batches()

        asked = chunks.select("chunk", "sizes", "trusted", "vocabulary", "codes").mapInArrow(send, SENT)
        asked.groupBy("place").applyInArrow(lambda t: counted(t, bounds), TOLD).write.partitionBy("part").parquet(f"{folder}/told/pass={p}")
        lower = read(f"told/pass={p}").where(F.col("part") == LOWER)
        lower = lower.union(read(f"lower/{p - 1}")) if p else lower
        lower.groupBy("place").applyInArrow(merged, TOLD).write.parquet(f"{folder}/lower/{p}")
        emptied(f"told/pass={p}/part={LOWER}")
        if p:
            emptied(f"lower/{p - 1}")

    for i in range(SHARES):

        def send_words(batches: Iterator[pa.RecordBatch], i=i) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    own = distinct(hashed_words(restored(r["vocabulary"])))
                    asked = [(i, 1, place, r["chunk"], packed(own[s]), None, None) for place, s in enumerate(dealt(own, bounds)) if s.start < s.stop]
                    yield from table_of(asked, TOLD).to_batches()

        asked = chunks.where(F.col("chunk") % SHARES == i).select("chunk", "vocabulary").mapInArrow(send_words, TOLD)
        answered = asked.union(read(f"lower/{PASSES - 1}")).groupBy("place").applyInArrow(counted_words, TOLD)
        answered.write.partitionBy("part").parquet(f"{folder}/words/share={i}")

    stats = {k: [0] * 6 for k in (3, 2, 1)}
    sums = [F.sum(F.get("numbers", F.lit(i))).alias(str(i)) for i in range(6)]
    for r in read("told").union(read("words/share=0")).where(F.col("part") == STATS).groupBy("k").agg(*sums).collect():
        stats[r["k"]] = [r[str(i)] for i in range(6)]
    cuts = {k: discounts(*stats[k][2:]) for k in stats}

    def score(group: pa.Table) -> pa.Table:
        asked = pa.array([x is None for x in group.column("k").to_pylist()], pa.bool_())
        row, answer = group.filter(asked), group.filter(pc.invert(asked)).select(["k", "place", "payload", "more"]).to_pylist()
        g = Grams(row.select(["sizes", "trusted", "vocabulary", "codes"]).to_pylist()[0])
        total = np.zeros(len(g.sizes))
        if g.sizes.any():
            counts = {3: answers(answer, 2, "more"), 2: answers(answer, 2, "payload"), 1: answers(answer, 1, "payload")}
            answer.clear()
            total = np.bincount(np.repeat(np.arange(len(g.sizes)), g.sizes), log_probabilities(g, counts, stats, cuts), len(g.sizes))
        mean = [float(np.exp(-s / n)) if n else None for s, n in zip(total, g.sizes.tolist())]
        columns = [row.column("doc_id").combine_chunks().flatten(), row.column("lang").combine_chunks().flatten(), pa.array(g.sizes), pa.array(mean, pa.float64())]
        return pa.table(columns, names=["doc_id", "lang", "n_symbols", "perplexity"])

    out = T.StructType().add("doc_id", id_type).add("lang", lang_type).add("n_symbols", T.LongType()).add("perplexity", T.DoubleType())
    parts = []
    emptied(f"lower/{PASSES - 1}")
    for i in range(SHARES):
        answer = read("told").union(read(f"words/share={i}")).where(F.col("part") == i).select("chunk", "k", "place", "payload", "more")
        met = chunks.where(F.col("chunk") % SHARES == i).unionByName(answer, allowMissingColumns=True)
        parts.append(settled(met.groupBy("chunk").applyInArrow(score, out)))
    for name in ("chunks", "told", "words"):
        emptied(name)
    return reduce(DataFrame.union, parts)
