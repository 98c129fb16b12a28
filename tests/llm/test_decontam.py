import random
import re

import numpy as np
import pytest

from tests.llm.shapes import docs_of, no_docs, odd_docs, odd_rows, sentence
from tidemark.llm import decontam as D

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(text, items, window=13):
    own, hit, found = split(text), set(), set()
    for item, words in ((i, split(t)) for i, t in items):
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            for p in range(len(own) - size + 1):
                if own[p : p + size] == words[k : k + size]:
                    hit.update(range(p, p + size))
                    found.add(str(item))
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


def benchmark_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def case(seed):
    rng = random.Random(seed)
    words = ["the", "of", "Cat", "dög", "x1", "run"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 13, 20]))) for i in range(6)] + [(0, text(15)), (77, ""), (78, None), (79, "cat-dög! the")]
    texts = [text(rng.randint(0, 40)) for _ in range(25)] + [text(5) + ", " + items[k][1] + "\n" + text(60) for k in range(6)]
    return items, texts + [None, "", "!!"]


@pytest.mark.parametrize("seed", range(4))
def test_hits_equal_plain_search(spark, seed):
    items, texts = case(seed)
    expected = [slow(t, items) for t in texts]
    for limit in (1_000_000, 40):  # one block of benchmark, and several
        got = D.judge(docs_of(spark, texts), benchmark_of(spark, items), limit=limit).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got] == expected


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(1)
    words = rng.choice([-1, 0, 1, 2, 3], 400).astype(np.int32)

    def key(p):
        out = []
        for v in words[p : p + 7]:
            if v <= 0:
                break
            out.append(int(v))
        return out

    order = D.suffix_array(words, 7).tolist()
    assert sorted(order) == np.flatnonzero(words > 0).tolist()
    assert [key(p) for p in order] == sorted(map(key, order))


def test_contaminated_documents_go_whole_rows_stay(spark):
    rng = random.Random(8)
    item = sentence(rng, 30)
    texts = [item, sentence(rng, 200), item + " " + sentence(rng, 2_000)]
    kept = D.remove_contaminated(docs_of(spark, texts), benchmark_of(spark, [(1, item)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]  # 30 of 2,030 words are under a twentieth


def test_odd_documents(spark):
    bench = benchmark_of(spark, [(1, "one"), (None, "a a"), (2, None)])
    got = D.judge(odd_docs(spark), bench).collect()
    assert len(got) == len(odd_rows())
    assert [(r["n_hit"], r["items"]) for r in got if r["doc_id"] == 8] == [(1, ["1"])]
    kept = D.remove_contaminated(odd_docs(spark), bench)
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(odd_rows()) - 1
    empty = benchmark_of(spark, [])
    assert D.remove_contaminated(odd_docs(spark), empty).count() == len(odd_rows())
    assert D.judge(no_docs(spark), bench).count() == 0
