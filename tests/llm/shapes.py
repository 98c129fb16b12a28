"""Odd documents that every operator must take: nulls, empty and long texts, repeats, clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
EXTRA = "digest string, key long, row string, fp long, core long, id long, n int, f string, count long, label int, bucket int"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(11)
    long = sentence(rng, 30_000)
    prose = sentence(rng, 120)
    texts = [
        (1, prose, "en"), (1, prose, "en"), (2, prose, "en"), (3, None, "de"), (4, "", "de"), (5, " \n\t ", None),
        (6, long, "en"), (7, "a" * 1_500, "fr"), (8, "one", "fr"), (None, prose, "en"), (None, None, None),
        (9, "é" * 300 + " ñ\n" * 40, "es"), (10, "mail a.b@c.de, +1 (443) 555-5793 or 10.0.0.255\n" * 30, "en"),
    ]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in texts]


def odd_docs(spark):
    """The odd rows with extra columns that share names with what operators use inside."""
    rows = [(*r, "d", 1, "r", 2, 3, 4, 5, "f", 6, 7, 8) for r in odd_rows()]
    return spark.createDataFrame(rows, f"{DOCS}, {EXTRA}")


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def docs_of(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
