import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.shapes import no_docs, odd_docs, odd_rows
from tidemark.llm import hilbert as H


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2), (3, 4), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(axes, bits):
    cells = [[n >> bits * k & (1 << bits) - 1 for k in range(axes)] for n in range(1 << axes * bits)]
    path = sorted(cells, key=lambda c: H.hilbert_place(c, bits))
    assert sorted(H.hilbert_place(c, bits) for c in cells) == list(range(len(cells)))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(path, path[1:]))


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    facts = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted(map(facts, texts))


@pytest.mark.parametrize("buckets", [1, 64])
def test_shards_follow_the_curve_with_equal_counts(spark, buckets):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = H.assign(docs, buckets=buckets).collect()
    check(rows, [r["text"] for r in docs.collect()], 24)
    by_place = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in by_place] == sorted(r["curve"] for r in rows)
    assert sum(r["rows"] for r in H.manifest(H.assign(docs)).collect()) == len(rows)


def test_no_python_runs_on_executors(spark):
    plan = H.assign(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_documents(spark):
    check(H.assign(odd_docs(spark), shards=5).collect(), [r[1] for r in odd_rows()], 5)
    check(H.assign(odd_docs(spark), shards=24).collect(), [r[1] for r in odd_rows()], 24)
    assert H.assign(no_docs(spark)).count() == 0


def test_cuts_are_the_quantiles_of_whole_values(spark):
    rng = random.Random(4)
    values = [f"https://site{rng.choice([1, 1, 1, *range(20)]):02d}.example.org/é" for _ in range(2_000)] + [None, ""] * 3
    docs = spark.createDataFrame([(v,) for v in values], "source string").repartition(7)
    ranked = sorted(v or "" for v in values)
    for bits in (1, 3, 4):
        steps = 1 << bits
        # The first value that at least a share k / 2^bits of all rows does not exceed.
        expected = {ranked[-(-k * len(ranked) // steps) - 1] for k in range(1, steps)} - {ranked[-1]}
        assert H.cuts_of(docs, F.coalesce("source", F.lit("")), bits) == sorted(expected)


def test_sources_with_a_common_beginning_are_kept_apart(spark):
    rows = [(i, "text", "en", f"https://site{i % 20:02d}.org", 10, ) for i in range(2_000)]
    out = H.assign(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), shards=20).collect()
    held = defaultdict(set)
    for r in out:
        held[r["shard"]].add(r["source"])
    assert max(map(len, held.values())) <= 3
