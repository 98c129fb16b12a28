"""Periodic runs of words: stretches that repeat themselves many times, found by descending-LCP Kruskal.

The suffixes of a text, as words, are put in order; neighbours in that order are edges weighted by
their longest common prefix (LCP). Edges are taken by decreasing LCP, as Kruskal's algorithm does, and
each one unites two suffix classes, kept by union-find together with the ordered set of their
positions. Positions i < j that become neighbours in a united set share exactly LCP words, so if
j - i <= LCP, words i to j + LCP repeat with period j - i: they seed a run. It is a whole run if the
words before i and j differ. No smaller period exists, since it would have put a position between the
two at a higher LCP. A run of L words with period q is seeded at LCP L - q, so edges too small for any
wanted run are never taken.

Suffixes are ordered by doubling the compared length, among those not yet told apart; ordinary prose
leaves none after a few steps. A union costs the smaller set's size (by bisection), or one merge
of two sorted lists where that is less.

Defined cases: null and empty texts have no words and no runs; a text of any length is one row's work,
in memory in proportion to its words; rows with equal ids each get a result; other columns of the
input are ignored; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import pieces

MIN_LENGTH = 6
MIN_EXPONENT = 4
RUNS = T.ArrayType(
    T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())
)
Words = list[bytes]


def words_of(text: str | None) -> Words:
    """The words between ASCII blanks, as UTF-8."""
    return text.encode().split() if text else []


def numbered(words: Words) -> np.ndarray:
    """Words as numbers; equal words are equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def suffix_order(word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and by step k their ranks when 2^k words are compared (equal ranks: equal words).

    A rank is the place of the suffix's group in the order, so groups are told apart in place and
    suffixes alone in theirs are not looked at again.
    """
    n = len(word)
    order = np.argsort(word, kind="stable")
    opens = np.concatenate(([True], word[order][1:] != word[order][:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # the end of the text comes before every word
    rank[order] = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    steps, held = [rank.copy()], 1
    while True:
        at = rank[order]
        alone = np.concatenate((at[1:] != at[:-1], [True])) & np.concatenate(([True], at[1:] != at[:-1]))
        places = np.flatnonzero(~alone)
        if not len(places):
            return order, steps
        own = order[places]
        first, then = at[places], rank[np.minimum(own + held, n)]
        key = np.argsort(first * (n + 1) + then + 1, kind="stable")
        own, first, then = own[key], first[key], then[key]
        order[places] = own
        opens = np.concatenate(([True], (first[1:] != first[:-1]) | (then[1:] != then[:-1])))
        rank[own] = places[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
        steps.append(rank.copy())
        held *= 2


def shared_prefixes(order: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix in order and the one before it (0 for the first)."""
    n = len(order)
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for k in range(len(steps) - 1, -1, -1):
        same = steps[k][left] == steps[k][right]
        shared[1:][same] += 1 << k
        left[same] = np.minimum(left[same] + (1 << k), n)
        right[same] = np.minimum(right[same] + (1 << k), n)
    return shared


def seeds(order: np.ndarray, shared: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, LCP) of positions that become neighbours in a united class, by decreasing LCP down to `least`."""
    edges = np.flatnonzero(shared >= least)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for a, b, lcp in zip(order[edges - 1].tolist(), order[edges].tolist(), shared[edges].tolist()):
        a, b = root(a), root(b)
        large, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        if len(small) <= 16:
            for x in small:
                large.insert(bisect_left(large, x), x)
        else:
            large += small
            large.sort()  # two sorted stretches: one merge
        members[a] = large
        for n, x in enumerate(small):
            k = bisect_left(large, x)
            if k and not (n and large[k - 1] == small[n - 1]):
                yield large[k - 1], x, lcp
            if k + 1 < len(large) and not (n + 1 < len(small) and large[k + 1] == small[n + 1]):
                yield x, large[k + 1], lcp


def least_shared(min_length: int, min_exponent: int) -> int:
    """The least LCP that seeds a run of the wanted length and exponent."""
    return max(1, min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1)))


def runs_of(word: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start, then period; exponents below 2 are not runs."""
    if min_exponent < 2:
        raise ValueError("a run repeats at least twice")
    if len(word) < min_length:
        return []
    order, steps = suffix_order(word)
    found = []
    for i, j, lcp in seeds(order, shared_prefixes(order, steps), least_shared(min_length, min_exponent)):
        period, length = j - i, j - i + lcp
        if length >= max(min_length, min_exponent * period) and (i == 0 or word[i - 1] != word[j - 1]):
            found.append((i, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words without the repetitions: of each run the first period stays."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [w for w, dropped in zip(words, (np.cumsum(step)[:-1] > 0).tolist()) if not dropped]


def may_repeat(texts: list[np.ndarray], least: int) -> np.ndarray:
    """For each text: do any `least` words in a row (by hash) occur in it twice? Without that there is no run."""
    lengths = np.array([len(t) for t in texts])
    out = np.zeros(len(texts), bool)
    word = np.concatenate(texts).astype(np.uint64) if len(texts) else np.zeros(0, np.uint64)
    if len(word) <= least:
        return out
    text = np.repeat(np.arange(len(texts)), lengths)
    size = len(word) - least + 1
    mixed = text[:size].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(least):
            mixed = (mixed ^ word[k : size + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    whole = text[:size] == text[least - 1 :]
    mixed, text = mixed[whole], text[:size][whole]
    key = np.argsort(mixed, kind="stable")
    same = mixed[key][1:] == mixed[key][:-1]
    out[text[key][1:][same]] = True
    return out


def find_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    reword: Callable[[object, Words], Words] | None = None,
) -> DataFrame:
    """doc_id, n_words, runs, collapsed (text without repetitions): one row for each row of docs.

    ``reword`` may change the words of a text, given its doc_id, before they are searched.
    """
    least = least_shared(min_length, min_exponent)
    shape = T.StructType().add("n_words", T.LongType()).add("runs", RUNS).add("collapsed", T.StringType())

    @F.pandas_udf(shape)
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = []
            for a, b in pieces(texts):
                words = [words_of(t) for t in texts[a:b]]
                if reword is not None:
                    words = [reword(i, w) for i, w in zip(ids[a:b], words)]
                numbers = [numbered(w) for w in words]
                for own, number, repeats in zip(words, numbers, may_repeat(numbers, least).tolist()):
                    runs = runs_of(number, min_length, min_exponent) if repeats else []
                    spans = [dict(zip(("start", "length", "period"), r)) for r in runs]
                    rows.append((len(own), spans, b" ".join(collapsed(own, runs)).decode()))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    # Ids travel as text: a long column with nulls would become floats.
    found = find(F.col("doc_id").cast("string"), "text").alias("f")
    return docs.select("doc_id", found).select("doc_id", "f.n_words", "f.runs", "f.collapsed")
