import random
import re
from fractions import Fraction
from math import comb

import pytest

from tests.llm.shapes import docs_of, labels_of, no_docs, odd_docs, odd_rows, sentence
from tidemark.llm import quality as Q


def slow_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    inside = set()
    for i in range(len(words) - 7):
        same = [j for j in range(len(words) - 7) if words[j : j + 8] == words[i : i + 8]]
        if len(same) > 1:
            inside.update(range(i, i + 8))
    duplicate = sum(x in lines[:k] for k, x in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(words), sum(map(len, words)), symbols, len(lines), duplicate, len(inside), len(set(words)))


@pytest.mark.parametrize("seed", range(6))
def test_features_equal_plain_counts(seed):
    rng = random.Random(seed)
    words = ["a", "bb", "é#", "|", "x y", "\x1c"]
    text = "".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t", "\r\n"]) for _ in range(90)) * rng.randint(1, 2)
    assert Q._features(text) == slow_features(text)


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, 0.1), (30, 4, 0.2), (50, 50, 0.5)):
        assert Q.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_holm_stops_at_the_first_failure():
    assert Q.holm([(0.001, "a"), (0.02, "b"), (0.021, "c")], 0.05) == {"a", "b", "c"}
    assert Q.holm([(0.001, "a"), (0.03, "b"), (0.04, "c")], 0.05) == {"a"}


def test_cutoffs_hold_on_good_documents_and_reject_junk(spark):
    rng = random.Random(2)
    good = [sentence(rng, 40) for _ in range(2_000)]
    junk = [" ".join(w + "&&&" for w in sentence(rng, 40).split()) for _ in range(50)]
    docs = docs_of(spark, good + junk)
    labels = labels_of(spark, [(i, 1, 0) for i in range(2_000)])
    judged = {r["doc_id"]: r["kept"] for r in Q.judge(docs, labels).collect()}
    assert sum(judged[i] for i in range(2_000)) >= 2_000 * (1 - Q.ALPHA)
    assert not any(judged[i] for i in range(2_000, 2_050))
    assert {r["doc_id"] for r in Q.keep_good(docs, labels).collect()} == {i for i, kept in judged.items() if kept}


def test_few_labels_prove_nothing(spark):
    docs = docs_of(spark, ["&&& " * 30 + f"w{i} v{i}" for i in range(20)])
    assert not any(Q.choose_cutoffs(Q.measure(docs), labels_of(spark, [(i, 1, 0) for i in range(20)])).values())


def test_odd_documents(spark):
    labels = labels_of(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)])
    got = Q.judge(odd_docs(spark), labels).collect()
    assert len(got) == len(odd_rows())
    expected = sorted((i is None, i or 0, slow_features(t)[:1]) for i, t, *_ in odd_rows() if t is None or len(t) < 5_000)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["f"]["n_words"],)) for r in got if r["f"]["n_words"] < 5_000) == expected
    assert not any(r["kept"] for r in got if r["f"]["n_words"] < 20)
    kept = Q.keep_good(odd_docs(spark), labels)
    assert kept.columns == odd_docs(spark).columns and kept.count() == sum(r["kept"] for r in got)
    assert Q.judge(no_docs(spark), labels).count() == 0 and Q.keep_good(no_docs(spark), labels).count() == 0


def slow_values(text):
    """The five rules' numbers, from the plain counts."""
    n, chars, symbols, lines, dup, repeats, distinct = slow_features(text)
    share = lambda a, b: a / b if b else 0.0
    return {
        "symbols": share(symbols, chars), "dup_lines": share(dup, lines), "repeats": share(repeats, n),
        "same_words": share(n - distinct, n), "long_words": share(chars, n),
    }


def slow_base(text):
    n, repeats = slow_features(text)[0], slow_features(text)[5]
    return n < 20 or 100 * repeats > 30 * n


def slow_cutoffs(rows, good, alpha, delta):
    """Cutoffs by whole fractions: exact tails, then the step-down over all tests of all strata."""
    per_rule = Fraction(alpha).limit_denominator(1_000) / 5
    passed = {}
    for doc_id, lang, text in rows:
        if doc_id in good and not slow_base(text):
            passed.setdefault(lang or "", []).append(slow_values(text))
    tests = []
    for lang, values in passed.items():
        n = len(values)
        if (1 - per_rule) ** n > delta:
            continue  # not even a cutoff that rejects none could be proven
        terms = [comb(n, i) * per_rule**i * (1 - per_rule) ** (n - i) for i in range(n + 1)]
        for rule, cutoffs in Q.CUTOFFS.items():
            for cutoff in cutoffs:
                tests.append((sum(terms[: sum(v[rule] > cutoff for v in values) + 1]), lang, rule, cutoff))
    chosen = {}
    for i, (p, lang, rule, cutoff) in enumerate(sorted(tests)):
        if p > Fraction(delta).limit_denominator(1_000) / (len(tests) - i):
            break
        chosen[lang, rule] = min(cutoff, chosen.get((lang, rule), cutoff))
    return chosen


def test_verdicts_equal_plain_ones_in_every_stratum(spark):
    rng = random.Random(5)
    marked = lambda words, share: " ".join(w + "#" if rng.random() < share else w for w in words)
    rows = []
    for lang, size in (("en", 700), ("de", 400), (None, 350), ("fr", 60)):
        for _ in range(size):
            words = sentence(rng, rng.choice([12, 25, 30, 40])).split()
            rows.append((len(rows), lang, marked(words, rng.choice([0, 0, 0.1, 0.9]) if lang == "en" else 0)))
        rows += [(len(rows) + k, lang, "&&& " * 3 + "\n".join([sentence(rng, 6)] * 5)) for k in range(8)]
    labels = [(i, int(rng.random() < 0.95), 0) for i, *_ in rows]
    labels += [(i, 0, 0) for i in range(0, 40)]  # labelled twice: good only if both say so
    good = {i for i, quality, _ in labels if quality} - {i for i, quality, _ in labels if not quality}
    docs = docs_of(spark, [text for *_, text in rows]).drop("lang").join(
        spark.createDataFrame([(i, lang) for i, lang, _ in rows], "doc_id long, lang string"), "doc_id")
    alpha, delta = 0.15, 0.05
    expected = slow_cutoffs(rows, good, alpha, delta)
    assert {lang for lang, _ in expected} == {"en", "de", ""}  # fr has too few good documents
    got = Q.choose_cutoffs(Q.measure(docs), labels_of(spark, labels), alpha, delta)
    assert {(lang, rule): cutoff for lang, own in got.items() for rule, cutoff in own.items()} == expected
    kept = {
        i for i, lang, text in rows
        if not slow_base(text) and all(v <= expected.get((lang or "", r), v) for r, v in slow_values(text).items())
    }
    judged = Q.judge(docs, labels_of(spark, labels), alpha, delta).collect()
    assert {r["doc_id"] for r in judged if r["kept"]} == kept and 0 < len(kept) < len(rows)
    assert {r["doc_id"] for r in judged if r["base_failed"]} == {i for i, _, text in rows if slow_base(text)}
