"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

A text becomes a dozen rates: density of lexicon words of several strengths, lexicon words near second
person pronouns, capitals, punctuation, obfuscated spellings. The lexicon (word beginnings and whole
words, with the log-odds of appearing in toxic documents) is learnt from labels, so it needs no list
per language; a training document's own appearance is taken out of the counts before its features
are computed, so training and unseen documents look alike. Labels, language, source and doc_id enter
no feature.

Only a bounded sample of labelled rows is learnt from: at most MOST_TOXIC toxic and MOST_CLEAN clean
documents, the first by a hash of doc_id, weighted back to their true shares, and the lexicon keeps the
LEXICON grams with the highest odds. Their features (not
their texts) come to the driver, where the trees and the calibration are fitted. Scoring covers every
whole text in one pass.

Defined cases: null and empty texts have all features 0 and get the score of such a document; a
document labelled more than once is toxic if any label says so; repeated rows each get a score;
without both kinds of labels every score is the share of toxic labels (0 without labels); empty
tables give empty results.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import settled

MOST_TOXIC = 4_000
MOST_CLEAN = 10_000
LEXICON = 20_000
HELD_OUT = 2  # of crc32(doc_id) mod 4
THRESHOLD = 0.3
#: Second person in the languages served.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestra vuestro".split()
)
WORD = re.compile(r"[^\W\d_]+")
# Symbols inside a word, single letters between separators; each starts with a rare character, which
# the search jumps to.
INNER = re.compile(r"[0-9@$*!|+]+(?=[^\W\d_])")
SPACED = re.compile(r"[.\-_*](?=[^\W\d_][.\-_*][^\W\d_])")
#: By code point: is it a capital of any script?
CAPITAL = np.fromiter((chr(c).isupper() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
NAMES = (
    "strong", "medium", "weak", "strong_kinds", "strong_rate", "medium_rate", "odds_sum", "odds_top", "near_second",
    "second_rate", "capitals", "shouted", "exclaimed", "asked", "marks", "obfuscated", "log_words",
)


def grams(word: str) -> list[str]:
    """A word's beginnings of four to seven letters and the whole word, marked by its end."""
    return [word[:k] for k in range(4, min(len(word), 8))] + [word + "$"]


def capital_runs(text: str) -> tuple[int, int]:
    """How many characters are capitals, of any script, and how many runs of three or more they form."""
    capital = CAPITAL[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    three = capital[2:] & capital[1:-1] & capital[:-2]
    return int(np.count_nonzero(capital)), int(np.count_nonzero(three[1:] & ~three[:-1])) + int(three[:1].any())


class Lexicon:
    """Log-odds of grams, from how many toxic and clean documents hold them."""

    def __init__(self, held: dict[str, tuple[int, int]], toxic: int, clean: int) -> None:
        self.held, self.toxic, self.clean = held, toxic, clean
        self.known: dict[str, float] = {}

    def odds(self, word: str, own: tuple[int, int] = (0, 0)) -> float:
        """The highest log-odds of a word's grams; own: appearances to leave out (toxic, clean)."""
        best = 0.0
        for gram in grams(word):
            t, c = self.held.get(gram, (0, 0))
            if t - own[0] >= 2:
                rate_t = (t - own[0] + 0.5) / (self.toxic - own[0] + 1)
                rate_c = (c - own[1] + 0.5) / (self.clean - own[1] + 1)
                best = max(best, math.log(rate_t / rate_c))
        return best

    def of_unseen(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) > 300_000:
                self.known.clear()  # it only saves time
            value = self.known[word] = self.odds(word)
        return value


def features(text: str | None, lexicon: Lexicon, label: int | None = None) -> list[float]:
    """The numbers of NAMES; label: of a training document, whose own appearance is left out."""
    if not text:
        return [0.0] * len(NAMES)
    words = WORD.findall(text.lower())
    kinds, n, length = set(words), len(words) or 1, len(text)
    own = (0, 0) if label is None else (label, 1 - label)
    odds = {}  # of words that point to toxicity at all
    for w in kinds:
        value = lexicon.of_unseen(w) if label is None else lexicon.odds(w, own)
        if value > 0.7:
            odds[w] = value
    line = [(i, odds[w]) for i, w in enumerate(words) if w in odds] if odds else []
    strong = [i for i, x in line if x > 3.0]
    medium = [x for _, x in line if x > 1.5]
    near = 0
    if strong and not kinds.isdisjoint(SECOND_PERSON):
        at = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        spot = np.searchsorted(at, strong)
        after = np.abs(at[np.minimum(spot, len(at) - 1)] - strong)
        near = int((np.minimum(after, np.abs(at[np.maximum(spot - 1, 0)] - strong)) <= 3).sum())
    capitals, shouted = capital_runs(text)
    inner = sum(m.start() > 0 and text[m.start() - 1].isalpha() for m in INNER.finditer(text))
    marks = sum(text.count(c) for c in "#$%&*|<>")
    return [
        float(len(strong)), float(len(medium)), float(len(line)), float(len({words[i] for i in strong})), len(strong) / n,
        len(medium) / n, sum(medium), max(odds.values(), default=0.0), near / n, len(kinds & SECOND_PERSON) / n,
        capitals / length, shouted / n, text.count("!") / n, text.count("?") / n,
        marks / length, (inner + len(SPACED.findall(text))) / n, math.log1p(len(words)),
    ]


class Trees:
    """Boosted regression trees for the logistic loss, over binned features."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64) -> None:
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        share = float(np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4))
        self.start = math.log(share / (1 - share))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
        raw = np.full(len(y), self.start)
        columns, inner = x.shape[1], 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                spot = np.full((width, 2), -1)
                for f in range(columns):
                    key = (node - first) * self.bins + binned[:, f]
                    gs = np.bincount(key, g, width * self.bins).reshape(width, -1).cumsum(1)
                    hs = np.bincount(key, h, width * self.bins).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[:, len(cuts[f]) :] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(width), top] > best
                    best[better] = gain[np.arange(width), top][better]
                    spot[better] = np.stack([np.full(width, f), top], axis=1)[better]
                for k in np.flatnonzero(spot[:, 0] >= 0):
                    feature[first + k], cut[first + k] = spot[k, 0], cuts[spot[k, 0]][spot[k, 1]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            self.model.append((feature, cut, value))
            raw += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.start), np.arange(len(x)), 2**self.depth - 1
        for feature, cut, value in self.model:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y by x, by pooling adjacent violators."""
    values, where = np.unique(x, return_inverse=True)  # rows with equal x count as one
    total = np.bincount(where, weight)
    means = np.bincount(where, weight * y) / total
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for mean, w, v in zip(means.tolist(), total.tolist(), values.tolist()):
        blocks.append([mean, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, k, _, last = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * k) / (b[1] + k), b[1] + k, last
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    return at, np.array([b[0] for b in blocks for _ in (0, 1)])


class Model:
    """Lexicon, trees and calibration; without trees a constant."""

    def __init__(self, lexicon: Lexicon, share: float, trees: Trees | None = None, knots: tuple | None = None) -> None:
        self.lexicon, self.share, self.trees, self.knots = lexicon, share, trees, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        calibrated = np.interp(raw, *self.knots)
        return 0.998 * calibrated + 0.002 / (1 + np.exp(-raw))  # the second part orders what the steps tie


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, label of the rows learnt from, and how many rows of each label there are."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    total = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    first = lambda label, most: known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = first(1, most_toxic).union(first(0, most_clean))  # bounded, so it may be broadcast
    return settled(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")), total


def learn_lexicon(rows: DataFrame, most: int = LEXICON) -> Lexicon:
    """Grams of at least three toxic documents whose odds are raised by more than half, those with the highest odds first.

    Toxic and clean counts meet in a join; `most` grams at most, the size of the model, reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[tuple[int, str]] = Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                total.update({(label, g) for w in set(WORD.findall((text or "").lower())) for g in grams(w)})
        yield pd.DataFrame([(g, n * label, n * (1 - label)) for (label, g), n in total.items()], columns=["gram", "t", "c"])

    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    t, c = n.get(1, 0), n.get(0, 0)
    counted = rows.select("text", "label").mapInPandas(count, "gram string, t long, c long")
    held = counted.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t >= 3")
    held = held.withColumn("lift", (F.col("t") + 0.5) / (t + 1) / ((F.col("c") + 0.5) / (c + 1))).where("lift > 1.5")
    kept = held.orderBy(F.desc("lift"), F.desc("t"), "gram").limit(most).collect()
    return Lexicon({r["gram"]: (r["t"], r["c"]) for r in kept}, t, c)


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    rows, total = sample(docs, labels, most_toxic, most_clean)
    share = total.get(1, 0) / max(1, sum(total.values()))
    if len(total) < 2:
        return Model(Lexicon({}, 0, 0), share)
    lexicon = learn_lexicon(rows)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [features(t, lexicon, label) for t, label in zip(batch["text"], batch["label"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": x})

    schema = T.StructType([docs.schema["doc_id"]]).add("label", T.IntegerType()).add("x", T.ArrayType(T.DoubleType()))
    seen = rows.mapInPandas(measured, schema).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)))
    seen = sorted(seen.select("part", "doc_id", "label", "x").collect(), key=lambda r: (r["part"], r["doc_id"], r["x"]))
    if {r["label"] for r in seen} != {0, 1}:
        return Model(lexicon, share)
    x, y = np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen], float)
    weight = np.where(y > 0, total[1] / y.sum(), total[0] / (1 - y).sum())
    weight /= weight.mean()
    part = np.array([r["part"] for r in seen])
    raw = np.empty(len(y))
    for k in range(4):  # the calibration sees scores of trees that have not seen the row
        own = part == k
        raw[own] = Trees().fit(x[~own], y[~own], weight[~own]).raw(x[own]) if own.any() and not own.all() else 0.0
    return Model(lexicon, share, Trees().fit(x, y, weight), isotonic(raw, y, weight))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    model = fit(docs, labels)

    @F.pandas_udf(T.DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            x = np.array([features(t, model.lexicon) for t in batch]).reshape(-1, len(NAMES))
            yield pd.Series(model.score(x), dtype="float64")

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
