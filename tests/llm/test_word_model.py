import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.shapes import docs_of, labels_of
from tidemark.llm import kneser_ney as N
from tidemark.llm import word_model as W


def slow_counts(texts):
    seen = [Counter() for _ in range(4)]
    for t in texts:
        x = ["\n", "\n", *W.words(t)]
        seen[3].update(tuple(x[i : i + 3]) for i in range(len(x) - 2))
    for k in (2, 1):
        seen[k] = Counter(g[1:] for g in seen[k + 1])
    return seen


def slow_perplexity(text, others, every):
    """By the formulas: counts of the other texts, discounts and vocabulary of every text."""
    seen, whole = slow_counts(others), slow_counts(every)
    cuts = {k: N.discounts(*[sum(v == i for v in whole[k].values()) for i in (1, 2, 3, 4)]) for k in (1, 2, 3)}
    follow = [defaultdict(list) for _ in range(4)]
    for k in (1, 2, 3):
        for g, n in seen[k].items():
            follow[k][g[:-1]].append(n)

    def p(context, word):
        k = len(context) + 1
        lower = p(context[1:], word) if k > 1 else 1 / (len(whole[1]) + 1)
        own = follow[k].get(context)
        if not own:
            return lower
        cut = lambda n: cuts[k][min(n, 3) - 1] if n else 0.0
        n = seen[k].get((*context, word), 0)
        return ((n - cut(n)) + sum(map(cut, own)) * lower) / sum(own)

    x = ["\n", "\n", *W.words(text)]
    return math.exp(-np.mean([math.log(p((x[i], x[i + 1]), x[i + 2])) for i in range(len(x) - 2)]))


@pytest.mark.parametrize("chunk", [100, 2_000, 4_000_000])
def test_perplexity_equals_the_formulas(spark, chunk):
    rng = random.Random(7)
    vocabulary = ["the", "cat", "Sat", "on", "мир", "и", "война", "世", "界", "a.", "12", "\n", "?", "हिन्दी"]
    texts = [" ".join(rng.choice(vocabulary[: rng.randint(2, 14)]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    trusted = {i for i in range(40) if i % 3}
    labels = labels_of(spark, [(i, int(i in trusted), 0) for i in range(40)])
    rows = W.perplexity(docs_of(spark, texts), N.trusted_ids(labels), N.discounts, chunk).collect()
    assert len(rows) == 40
    for r in rows:
        i = r["doc_id"]
        others = [texts[j] for j in sorted(trusted) if j != i]
        assert r["n_symbols"] == len(W.words(texts[i]))
        assert r["perplexity"] == pytest.approx(slow_perplexity(texts[i], others, [texts[j] for j in sorted(trusted)]), rel=1e-6)


def sentences(rng, words, n):
    """Prose in which each word is followed by one of three."""
    out, at = [], rng.choice(words)
    for _ in range(n):
        out.append(at)
        at = words[(words.index(at) * 3 + rng.randint(1, 3)) % len(words)]
    return out


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnop", "абвгдежзиклмнопр", "αβγδεζηθικλμνξοπ"])
def test_good_words_in_a_wrong_order_go(spark, alphabet):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(3, 7))) for _ in range(60)})
    prose = [sentences(rng, words, 100) for _ in range(260)]
    wrong = [rng.sample(t, len(t)) for t in prose[:20]]
    fresh = [sentences(rng, words, 100) for _ in range(20)]
    docs = docs_of(spark, [" ".join(t) for t in [*prose, *fresh, *wrong]])
    labels = labels_of(spark, [(i, 1, 0) for i in range(260)])
    kept = {r["doc_id"]: r["kept"] for r in N.judge(docs, labels).collect()}
    assert sum(kept[i] for i in range(260, 280)) >= 19  # unseen prose, though it was not counted
    assert not any(kept[i] for i in range(280, 300))


def held(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_disk_holds_less_than_the_texts_afterwards(spark):
    """All n-grams of all orders, written at once and kept, took several times the texts."""
    from tidemark.llm.common import shared_folder

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(5_000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(400)) for _ in range(300)]
    folder = shared_folder(spark).removeprefix("file:")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = held(folder), spark.conf.get(key)
    rows = W.perplexity(docs_of(spark, texts), N.trusted_ids(labels_of(spark, [(i, 1, 0) for i in range(300)])), N.discounts)
    assert rows.count() == 300 and spark.conf.get(key) == setting
    assert held(folder) - before < sum(map(len, texts)) / 2


def test_a_pass_sends_its_share():
    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(3_000)) + "x" for _ in range(2_000)) for _ in range(20)]
    sizes, vocabulary, codes = W.coded(texts)
    row = {"chunk": 0, "sizes": W.packed(sizes, rising=False), "trusted": W.packed(np.ones(20, np.int64), rising=False), "vocabulary": vocabulary, "codes": codes}
    passes = [W.emitted(row, W.edges(2), p) for p in range(W.PASSES)]
    each = [sum(len(x) for r in p for x in r[2:]) for p in passes]
    assert max(each) < 2 * sum(each) / W.PASSES
    three = {(a, b, c) for t in texts for a, b, c in zip(*[["\n", "\n", *W.words(t)][i:] for i in range(3)])}
    two = {x[:2] for x in three} | {x[1:] for x in three}
    assert sum(len(W.unpacked(r[2])[0]) for p in passes for r in p) == len(two)
    assert sum(len(W.unpacked(r[3])[0]) for p in passes for r in p) == sum(len(W.unpacked(r[5])[0]) for p in passes for r in p) == len(three)


def test_words_are_found_as_by_the_expression():
    rng = random.Random(8)
    wild = "".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(128), 0xE51, 0x30, 10])) for _ in range(60_000))
    for texts in ([], [""], ["", "\n\n", " a\n\nb\n \n", "\u0130\u03a3 \u0391\u03a3_12\u0e51\u0e51 \u0e511", "\x00\x1ca", wild]):
        sizes, vocabulary, codes = W.coded(texts)
        listed, at = W.restored(vocabulary).decode().split(" "), W.unpacked(codes)[0].astype(int).tolist()
        assert sizes.tolist() == [len(W.words(t)) for t in texts]
        assert [listed[i] for i in at] == [w for t in texts for w in ["\n", "\n", *W.words(t)]]


def test_a_bigram_and_its_first_word_tell_the_second():
    x, y = np.random.default_rng(9).integers(0, 1 << 64, (2, 1_000), np.uint64, endpoint=False)
    assert (W.second(W.joined(x, y), x) == y).all()
