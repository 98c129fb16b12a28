import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.shapes import docs_of, no_docs, odd_docs, odd_rows, sentence
from tidemark.llm import simhash as S
from tidemark.llm.components import connected


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits):
    """Smallest member of each print's component, by all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= bits:
                root[find(max(find(a), find(b)))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def clustered(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(40)]
    out = set(base)
    for x in base[:15]:
        for _ in range(12):
            y = x
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            out.add(y)
    y = base[0]
    for _ in range(20):  # a chain whose ends are far apart
        y ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        out.add(y)
    return sorted(out)


@pytest.mark.parametrize("text", ["", "One", "ONE two", "a b c", "ÀB c d e\x0bf", "x " * 50, sentence(random.Random(1), 90)])
def test_fingerprint_by_definition(text):
    assert S.simhash(text) == slow_print(text)


@pytest.mark.parametrize("budget", [1, 2, 3])
def test_walk_finds_exactly_the_near_pairs(budget):
    keys = np.array(clustered(3), np.uint64)
    i, j = S.walk(keys, np.zeros(len(keys), np.int64), 0, budget)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    near = {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if (int(keys[a]) ^ int(keys[b])).bit_count() <= budget}
    assert got == near and len(i) == len(near)


@pytest.mark.parametrize("leaf", [2048, 8])
def test_links_have_the_components_of_all_pairs(spark, leaf):
    prints = clustered(5)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = S.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, leaf)
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in connected(links).collect()}
    expected = classes(prints, 2)
    groups = {}
    for p in prints:
        groups.setdefault(expected[p], set()).add(p)
    found = {}
    for p in prints:
        found.setdefault(roots.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_a_long_path_is_one_component(spark):
    n = 200
    order = list(range(n))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(900, 901), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected(links).collect()}
    assert len({roots[i] for i in range(n)}) == 1 and roots[900] == roots[901] != roots[0]


def test_whole_operator_against_all_pairs(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    texts += [texts[0], texts[1] + " x", "", None, texts[3].upper()]
    got = {r["doc_id"]: r for r in S.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [slow_print(t) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == prints
    root = classes(sorted(set(prints)), 2)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(root[p], i)
    assert [got[i]["component_id"] for i in range(len(texts))] == [least[root[p]] for p in prints]


def test_keep_one_by_hand(spark):
    rows = [
        (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "x y z"), (3, "q r s t u v"), (4, "x y z"),
        (5, "q r s t u v"), (None, "x y z"), (6, None), (7, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in S.keep_one(docs).collect())
    assert got == [(0, "x y z"), (1, "a b c d"), (3, "q r s t u v"), (3, "x y z"), (6, "")]


def test_odd_documents(spark):
    got = S.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows())
    assert {r["component_id"] for r in got if r["fp"] == 0} == {3}
    kept = S.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 6, 7, 8, 9, 10]
    assert S.near_duplicates(no_docs(spark)).count() == 0 and S.keep_one(no_docs(spark)).count() == 0
