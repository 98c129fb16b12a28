import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.shapes import DOCS, no_docs, odd_docs, odd_rows
from tidemark.llm import merkle as M
from tidemark.llm import queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_tree(digests, fan=8):
    """Root, and for each leaf (left, right) by level."""
    ways, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for way, k in zip(ways, at):
            first = k // fan * fan
            way.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + fan])))
        nodes = [h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        at = [k // fan for k in at]
    return nodes[0], ways


def slow_rows(rows):
    """The contract, row by row: (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for i, text, lang, source, n_chars in rows:
        head = field(i) + field(source) + field(lang) + field(n_chars)
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        groups.setdefault(lang, []).append(((i is not None, i or 0), h(head + field(text)), h(head + field(low(text) if hit else text)), i))
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: slow_tree([leaf for _, leaf, _, _ in sorted(groups[lang], key=lambda r: (r[0], r[1]))]) for lang in order}
    root, tops = slow_tree([trees[lang][0] for lang in order])
    out = []
    for lang, top in zip(order, tops):
        subroot, ways = trees[lang]
        for (_, leaf, given, i), way in zip(sorted(groups[lang], key=lambda r: (r[0], r[1])), ways):
            way, now = way + top, given
            for left, right in way:
                now = h(left, now, right)
            out.append((i, leaf, subroot, root, h("".join(a + b for a, b in way)), now, now == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def got(docs):
    return sorted((tuple(r[c] for c in COLUMNS) for r in queries.witnessed_rows(docs).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 513, 600])
def test_appending_equals_the_whole_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    assert M._grow(leaves, n, 8, 4) == slow_tree(leaves)


@pytest.mark.parametrize("n", [1, 5, 64, 65, 200])
def test_a_block_of_a_larger_tree_climbs_all_its_levels(n):
    leaves = [h(str(i)) for i in range(n)]
    root, ways = M._grow(leaves, 10_000, 8, 3)
    nodes = leaves
    for _ in range(3):
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    assert [root] == nodes and all(len(way) == 3 for way in ways)


@pytest.mark.parametrize("fan, levels, n", [(2, 1, 75), (3, 1, 30), (2, 3, 60), (8, 1, 300)])
def test_blocks_of_any_size_give_the_same_tree(spark, fan, levels, n):
    rng = random.Random(n)
    rows = [(f":{rng.choice('aab')}", i, h(str(i))) for i in range(n)]
    docs = spark.createDataFrame(rows, "tree string, doc_id long, digest string").repartition(3)
    out = M.manifest(docs, ["doc_id"], fan, levels).withColumn("folded", M.folded(F.col("digest"), F.col("proof"))).collect()
    assert len(out) == n
    trees = {t: slow_tree([d for tree, _, d in rows if tree == t], fan) for t in (":a", ":b")}
    root, tops = slow_tree([trees[":a"][0], trees[":b"][0]], fan)
    for tree, top in zip((":a", ":b"), tops):
        own = sorted((r for r in out if r["tree"] == tree), key=lambda r: r["doc_id"])
        assert [[(s["left"], s["right"]) for s in r["proof"]] for r in own] == [way + top for way in trees[tree][1]]
        assert {(r["subroot"], r["root"], r["folded"]) for r in own} == {(trees[tree][0], root, root)}


def test_query_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice([i, i, i, None, 7]), rng.choice(["Text", "UP and down É", None, "", "low", str(i)]), rng.choice(["en", "en", "de", None, "", "é"]), "s", i)
        for i in range(400)
    ] + [(2**62 + 1, "BIG", "en", None, None)]
    want = slow_rows(rows)
    assert got(spark.createDataFrame(rows, DOCS).repartition(5)) == sorted(want, key=str)
    assert {r[-1] for r in want} == {True, False}


def test_odd_documents(spark):
    assert got(odd_docs(spark)) == sorted(slow_rows(odd_rows()), key=str)
    assert got(no_docs(spark)) == []
    one = [(1, "ONE", "en", "s", 3)]
    assert got(spark.createDataFrame(one, DOCS)) == slow_rows(one)
