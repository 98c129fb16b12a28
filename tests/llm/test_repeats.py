import hashlib
import random
from collections import Counter

import pytest

from tests.llm.shapes import docs_of, no_docs, odd_docs, odd_rows
from tidemark.llm import repeats as R


def slow(texts, span=200):
    """(bytes, removed, runs, hash of the rest) of each text, by counting all strings."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + span] for t in raw for i in range(len(t) - span + 1))
    out = []
    for t in raw:
        cover = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                cover[i : i + span] = b"\1" * span
        runs = sum(cover[i] and not (i and cover[i - 1]) for i in range(len(t)))
        kept = bytes(b for b, c in zip(t, cover) if not c)
        out.append((len(t), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


def found(docs, **how):
    rows = R.remove_repeats(docs, **how).collect()
    return [
        (r["doc_id"], (r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()))
        for r in rows
    ]


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages, texts = [text(rng.randint(20, 150)) for _ in range(8)], []
    for _ in range(60):
        kind = rng.random()
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.4 and texts:
            own = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
        elif kind < 0.8:
            texts.append(text(rng.randint(0, 80)) + rng.choice(passages) + text(rng.randint(0, 80)) + rng.choice(["", rng.choice(passages)]))
        else:
            odd = ["a" * rng.randint(0, 700), "ab" * 200 + text(40) + "ab" * 150, "", text(300), "é" * 150 + text(50), passages[0][: rng.randint(0, 90)]]
            texts.append(rng.choice(odd))
    return texts + [passages[0][i:] + text(3) for i in range(40)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("most", [4_000, 2])
def test_removal_equals_counting_all_strings(spark, seed, most):
    texts = corpus(seed)
    assert sorted(found(docs_of(spark, texts), most=most)) == list(enumerate(slow(texts)))


def test_short_spans_and_other_widths(spark):
    texts = corpus(9)
    how = {"span": 120, "radius": 10, "width": 16}
    assert sorted(found(docs_of(spark, texts), most=3, **how)) == list(enumerate(slow(texts, 120)))


def test_odd_documents(spark):
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 5_000]
    docs = odd_docs(spark).where("text is null or length(text) < 5000")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(found(docs), key=key) == sorted(zip((r[0] for r in rows), slow([r[1] for r in rows])), key=key)
    assert len(found(odd_docs(spark))) == len(odd_rows())
    assert found(no_docs(spark)) == []
