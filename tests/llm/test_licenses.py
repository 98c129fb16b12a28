import random
import re

import pytest

from tests.llm.shapes import docs_of, no_docs, odd_docs, odd_rows, sentence
from tidemark.llm import licenses as L


def grams(text):
    own = re.findall(r"[a-z0-9]+", text.lower())
    return [" ".join(own[i : i + 5]) for i in range(len(own) - 4)]


def slow(text, contained=0.8):
    """Templates of which some window of their size holds enough, over all windows."""
    own, out = grams(text), set()
    for name, template in L.TEMPLATES.items():
        wanted = set(grams(template))
        size = L.window_size(len(wanted))
        for start in range(0, len(own), size // 2):
            if len(wanted & set(own[start : start + size])) / len(wanted) >= contained:
                out.add(name)
    return out


@pytest.mark.parametrize("m", range(1, 200))
def test_a_window_covers_its_templates_wherever_they_lie(m):
    size = L.window_size(m)
    for at in range(0, 3 * size):
        assert any(start <= at and at + m <= start + size for start in range(0, at + 1, size // 2))
    assert m / size >= 0.25


@pytest.mark.parametrize("contained", [0.8, 0.9, 1.0])
def test_bands_keep_misses_rare_at_the_accepted_containment(contained):
    for name, text in L.TEMPLATES.items():
        m = len(set(grams(text)))
        size = L.window_size(m)
        # The least similar window that is accepted: full, with just enough of the template.
        held = next(k for k in range(m + 1) if k / m >= contained)
        similarity = L.least_similarity(m, size, contained)
        assert similarity == pytest.approx(held / (size + m - held)), name
        n = len(L.bands(0.001, similarity))
        assert (1 - similarity) ** n <= 0.001 < (1 - similarity) ** (n - 1)


def test_a_template_without_shingles_is_refused(spark):
    with pytest.raises(ValueError, match="short"):
        L.scan(docs_of(spark, ["MIT License"]), {"short": "MIT License", "mit": L.TEMPLATES["mit"]})
    five = L.scan(docs_of(spark, ["x under the mit license terms y"]), {"five": "under the MIT license terms"})
    assert {m["template"] for m in five.first()["matches"]} == {"five"}


def test_matches_equal_all_windows(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        name = rng.choice(list(L.TEMPLATES))
        words = L.TEMPLATES[name].split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = "altered"
        texts.append(sentence(rng, rng.randint(0, 70)) + " " + " ".join(words) + "\n" + sentence(rng, rng.randint(0, 70)))
    got = L.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [{m["template"] for m in r["matches"]} for r in got] == [slow(t) for t in texts]
    assert all(m["share"] >= 0.8 for r in got for m in r["matches"])


def test_no_python_runs_on_executors(spark):
    plan = L.scan(docs_of(spark, ["x"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_odd_documents(spark):
    assert [r["matches"] for r in L.scan(odd_docs(spark)).collect()] == [[]] * len(odd_rows())
    assert L.scan(docs_of(spark, [L.TEMPLATES["mit"]]), {}).first()["matches"] == []
    assert L.scan(no_docs(spark)).count() == 0
