import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.shapes import docs_of, no_docs, odd_docs, odd_rows
from tidemark.llm import periodic as P
from tidemark.llm import queries


def slow_runs(w, min_length=6, min_exponent=4):
    """All maximal stretches of every period, whose smallest period it is."""
    found = []
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(min_length, min_exponent * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(rng):
    """Words of a small alphabet with planted repetitions, some of them of repetitions."""
    out = []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 5))]
        out += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        out += [rng.choice("abcdefg") for _ in range(rng.randint(0, 4))]
    return out * rng.choice([1, 1, 1, 4, 5])


@pytest.mark.parametrize("seed", range(120))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    w = made(rng)
    number = P.numbered([x.encode() for x in w])
    assert P.runs_of(number) == slow_runs(w)
    least, exponent = rng.randint(2, 9), rng.randint(2, 5)
    assert P.runs_of(number, least, exponent) == slow_runs(w, least, exponent)


@pytest.mark.parametrize("seed", range(60))
def test_order_and_prefixes(seed):
    rng = random.Random(seed)
    w = [rng.randint(0, 2) for _ in range(rng.randint(1, 60))]
    order, steps = P.suffix_order(np.array(w))
    assert order.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
    shared = P.shared_prefixes(order, steps).tolist()
    for n in range(1, len(w)):
        a, b = w[order[n - 1] :], w[order[n] :]
        assert shared[n] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_texts_without_repeats_are_told_by_their_hashes():
    texts = [np.arange(50), np.array([1, 2, 3, 4, 5] * 2), np.zeros(0, np.int64), np.array([1, 2, 3]), np.array([7] * 6)]
    assert P.may_repeat(texts, 5).tolist() == [False, True, False, False, True]
    assert P.may_repeat([], 5).tolist() == []


def test_long_texts_take_little_time():
    n = 200_000
    rng = np.random.default_rng(0)
    for word in (np.zeros(n, np.int64), np.arange(n) % 2, np.arange(n) % 20_000, rng.integers(0, 2, n), np.arange(n) // 7 % 2):
        runs = P.runs_of(word)
        assert all(length >= max(6, 4 * q) for _, length, q in runs)
    assert P.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]


def test_collapse_keeps_one_period():
    words = "x a b a b a b a b a y z z z z z z".split()
    runs = P.runs_of(P.numbered([w.encode() for w in words]))
    assert runs == [(1, 9, 2), (11, 6, 1)]
    assert P.collapsed(words, runs) == "x a b y z".split()


def expected(doc_id, text):
    """The contract's row, by brute force."""
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = slow_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    written = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *four, *(hashlib.sha256(t.encode()).hexdigest() for t in (written, kept)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [rng.choice([" ", "\n", " \t"]).join(made(rng)) for _ in range(50)] + [None, "", " \n", "a b " * 8, "é " * 7, "one"]
    got = [tuple(r[c] for c in COLUMNS) for r in queries.periodic_rows(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [expected(i, t) for i, t in enumerate(texts)]
    assert any(r[1] > 1 for r in got) and any(r[1] == 0 for r in got)


def test_odd_documents(spark):
    small = {i for i, r in enumerate(odd_rows()) if len(r[1] or "") < 5_000}
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.periodic_rows(odd_docs(spark)).collect()), key=str)
    assert len(got) == len(odd_rows())
    for i, r in enumerate(odd_rows()):
        if i in small:
            assert expected(r[0], r[1]) in got
    assert queries.periodic_rows(no_docs(spark)).count() == 0
