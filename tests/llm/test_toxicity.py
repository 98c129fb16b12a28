import numpy as np
import pytest

from tests.llm.shapes import labels_of, no_docs, odd_docs, odd_rows
from tidemark.llm import toxicity as X


def auc(score, label):
    values, where, times = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[where]
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = X.score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    score, hit, label = (np.array([r[c] for r in rows]) for c in ("score", "predicted", "toxic"))
    assert auc(score, label) > 0.98
    assert hit[label == 1].mean() > 0.85 and hit[label == 0].mean() < 0.02


def test_trees_fit_what_one_cut_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3_000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    raw = X.Trees().fit(x, y, np.ones(len(y))).raw(x)
    assert ((raw > 0) == (y > 0)).mean() > 0.97


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_is_the_pooled_fit(seed):
    rng = np.random.default_rng(seed)
    x, y, w = rng.integers(0, 12, 60).astype(float), rng.integers(0, 2, 60).astype(float), rng.random(60) + 0.1
    got = np.interp(np.unique(x), *X.isotonic(x, y, w))
    means = [((w * y)[x == v].sum() / w[x == v].sum(), w[x == v].sum()) for v in np.unique(x)]
    m, k = zip(*means)
    best = [  # of all weighted block means, the least over ends of the greatest over starts
        max(min(np.average(m[a : b + 1], weights=k[a : b + 1]) for b in range(i, len(m))) for a in range(i + 1)) for i in range(len(m))
    ]
    assert got == pytest.approx(best)


def test_own_appearance_is_left_out():
    lexicon = X.Lexicon({"idio": (3, 0)}, 10, 90)
    assert lexicon.odds("idiotic") > lexicon.odds("idiotic", (1, 0)) > 0
    assert X.Lexicon({"idio": (2, 0)}, 10, 90).odds("idiotic", (1, 0)) == 0


def test_odd_documents(spark):
    labels = labels_of(spark, [(1, 1, 1), (1, 1, 0), (2, 1, 0), (3, 1, 1), (4, 0, 0), (None, 0, 1), (6, 1, None), (8, 1, 0)])
    rows = X.score(odd_docs(spark), labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in X.score(odd_docs(spark), labels_of(spark, [])).collect()} == {0}
    assert X.score(no_docs(spark), labels).count() == 0


@pytest.mark.parametrize("text", ["BLÖDE Kuh", "ПОШЁЛ вон, ДА", "ΦΎΓΕ τώρα", "STOP IT now", "ÉÈ ok ÀB C", "ǅǅǅ ⅧⅧⅧ 𝐀𝐁𝐂", "é" * 9])
def test_capitals_of_all_scripts_count(text):
    got = dict(zip(X.NAMES, X.features(text, X.Lexicon({}, 0, 0))))
    runs = [len(r) for r in "".join(c if c.isupper() else " " for c in text).split()]
    assert got["capitals"] == sum(map(str.isupper, text)) / len(text)
    assert got["shouted"] == sum(r >= 3 for r in runs) / (len(X.WORD.findall(text.lower())) or 1)
