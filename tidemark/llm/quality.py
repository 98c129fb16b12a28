"""Quality rules whose cutoffs carry a guarantee on false rejection.

Every rule gives a document a number, larger is worse. A rule rejects above a cutoff, and a cutoff
is only used where labelled good documents prove it harmless: for each stratum (language), rule and
candidate cutoff, the exact binomial test asks whether the share of good documents above the cutoff
is below `alpha / number of rules`. The tests of all strata, rules and cutoffs share the error
probability `delta` (Holm's step-down correction), so with probability 1 - delta no stratum loses
more than `alpha` of its good documents to the rules taken together.
The base rules (too few words, too much repetition) hold whatever the labels say.

Defined cases: null text has no words and fails the base rules; null language is the stratum "";
a stratum with too few good labels has no cutoff and rejects nothing beyond the base rules; a
document labelled more than once is good only if all its labels say so; repeated rows of a
document each get their verdict; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import settled

SYMBOLS = b"#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words")
#: Candidate cutoffs of each rule, fixed before any label is seen.
CUTOFFS = {
    "symbols": (0.005, 0.01, 0.02, 0.04, 0.08, 0.16),
    "dup_lines": (0.05, 0.1, 0.2, 0.3, 0.5),
    "repeats": (0.02, 0.05, 0.1, 0.15, 0.2),
    "same_words": (0.3, 0.5, 0.7, 0.8, 0.9),
    "long_words": (9.0, 10.0, 12.0, 16.0, 24.0),
}
ALPHA = 0.025
DELTA = 0.05
MAX_STRATA = 1_000


def _features(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0, 0, 0, 0, 0, 0, 0)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blank = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeats = 0
    if len(words) > 8:
        windows = list(zip(*(words[k:] for k in range(8))))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            again = np.zeros(len(words) + 1, np.int32)
            for i, window in enumerate(windows):
                j = first.setdefault(window, i)
                if j != i:
                    again[i] += 1
                    again[i + 8] -= 1
                    again[j] += 1
                    again[j + 8] -= 1
            repeats = int((np.cumsum(again[:-1]) > 0).sum())
    return (len(words), len(text) - blank, symbols, len(lines), len(lines) - len(set(lines)), repeats, len(set(words)))


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in FEATURES]))
def features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Counts of each whole text. Words are runs of anything but the six ASCII blanks."""
    for batch in texts:
        yield pd.DataFrame([_features(t) for t in batch], columns=list(FEATURES), dtype="int64")


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def rule_values(f: Column) -> dict[str, Column]:
    """The number each rule gives; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbols": share(f["n_symbols"], f["word_chars"]),
        "dup_lines": share(f["n_dup_lines"], f["n_lines"]),
        "repeats": share(f["n_repeat_words"], f["n_words"]),
        "same_words": share(f["n_words"] - f["n_distinct_words"], f["n_words"]),
        "long_words": share(f["word_chars"], f["n_words"]),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) for success probability p, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def holm(tests: list[tuple[float, tuple]], delta: float) -> set[tuple]:
    """Keys of the tests that stand after Holm's step-down correction."""
    stands: set[tuple] = set()
    for i, (p, key) in enumerate(sorted(tests)):
        if p > delta / (len(tests) - i):
            break
        stands.add(key)
    return stands


def choose_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """For each stratum, the lowest proven cutoff of each rule.

    measured: doc_id, lang, f. Only counts come to the driver, one row for each stratum that has
    enough good documents for any cutoff to be proven; more than MAX_STRATA of them is an error.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    values = rule_values(F.col("f"))
    per_rule = alpha / len(values)
    least = math.ceil(math.log(delta) / math.log1p(-per_rule))
    above = [
        F.sum((values[rule] > cutoff).cast("long")).alias(f"{rule}:{cutoff}") for rule in values for cutoff in CUTOFFS[rule]
    ]
    counts = (
        measured.join(good, "doc_id")
        .where(~base_failed(F.col("f")))
        .groupBy(F.coalesce("lang", F.lit("")).alias("stratum"))
        .agg(F.count(F.lit(1)).alias("n"), *above)
        .where(F.col("n") >= least)
        .limit(MAX_STRATA + 1)
        .collect()
    )
    if len(counts) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    tests = [
        (binomial_tail(row[f"{rule}:{cutoff}"], row["n"], per_rule), (row["stratum"], rule, cutoff))
        for row in counts
        for rule in values
        for cutoff in CUTOFFS[rule]
    ]
    chosen: dict[str, dict[str, float]] = {}
    for stratum, rule, cutoff in holm(tests, delta):
        own = chosen.setdefault(stratum, {})
        own[rule] = min(cutoff, own.get(rule, math.inf))
    return chosen


def rejected_by(lang: Column, f: Column, chosen: dict[str, dict[str, float]]) -> Column:
    """Names of the rules with a proven cutoff that the document exceeds."""
    values = rule_values(f)
    stratum = F.coalesce(lang, F.lit(""))
    hits = []
    for rule, value in values.items():
        own = {s: c[rule] for s, c in chosen.items() if rule in c}
        if own:
            cutoffs = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
            hits.append(F.when(value > cutoffs[stratum], F.lit(rule)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def measure(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", features("text").alias("f"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, lang, f (counts), base_failed, rules (that rejected it), kept: one row for each row of docs."""
    measured = settled(measure(docs))
    chosen = choose_cutoffs(measured, labels, alpha, delta)
    f = F.col("f")
    rules = rejected_by(F.col("lang"), f, chosen)
    return measured.select(
        "doc_id", "lang", "f", base_failed(f).alias("base_failed"), rules.alias("rules"),
        (~base_failed(f) & (F.size(rules) == 0)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that judge() keeps, all columns, without moving any text."""
    chosen = choose_cutoffs(settled(measure(docs)), labels, alpha, delta)
    f = features("text")
    if not any(chosen.values()):
        return docs.where(~base_failed(f))
    return docs.where(~base_failed(f) & (F.size(rejected_by(F.col("lang"), f, chosen)) == 0))
