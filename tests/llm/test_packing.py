import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.shapes import no_docs, odd_docs, odd_rows
from tidemark.llm import packing as K
from tidemark.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def padding(total, capacity):
    return 0 if total & (total - 1) == 0 else capacity - total


@pytest.mark.parametrize("n", [0, 1, 7, 300, 4_000])
def test_plan_uses_every_piece_once_without_gaps(n):
    rng = random.Random(n)
    counts = Counter(min(2048, int(rng.expovariate(1 / 400)) + 1) for _ in range(n))
    sequences = defaultdict(list)
    used = Counter()
    for length, first, last, each, sequence, offset in K.plan(dict(counts)):
        assert first == used[length]
        used[length] = last
        for rank in range(first, last):
            sequences[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    assert used == counts
    totals = []
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
        totals.append(end)
    assert sum(totals) == sum(k * v for k, v in counts.items())
    if n >= 300:
        assert sum(padding(t, 2048) for t in totals) <= 2_100  # a window's worth


@pytest.mark.parametrize("seed", range(20))
def test_fill_has_least_slack(seed):
    from itertools import product

    rng = random.Random(seed)
    counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
    taken = rng.randint(20, 40)
    room = 64 - taken
    got = K.fill(counts, room, taken, 64)
    assert all(v <= counts[k] for k, v in got.items())
    sums = {sum(k * c for k, c in zip(counts, pick)) for pick in product(*(range(n + 1) for n in counts.values()))}
    total = sum(k * v for k, v in got.items())
    assert total in sums and total <= room
    assert padding(taken + total, 64) == min(padding(taken + s, 64) for s in sums if s <= room)


def check(rows, texts, coder):
    """rows against [(doc_id, text)], both with repeats; every piece is compared with the library's ids."""
    expected = Counter()
    for doc_id, text in texts:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 2048):
            own = ids[start : start + 2048]
            expected[doc_id, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048


def coder():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check(K.pack(docs, PATH, public_tokenizers.PATTERN, buckets=3).collect(), texts, coder())


def test_odd_documents(spark):
    rows = K.pack(odd_docs(spark), PATH, public_tokenizers.PATTERN).collect()
    check(rows, [(r[0], r[1]) for r in odd_rows()], coder())
    special = spark.createDataFrame([(1, "a <|endoftext|> b​\x1c  \n x")], "doc_id long, text string")
    check(K.pack(special, PATH, public_tokenizers.PATTERN).collect(), [(1, "a <|endoftext|> b​\x1c  \n x")], coder())
    assert K.pack(no_docs(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_special_tokens_in_text_as_the_library_reads_them(spark, tmp_path):
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "Der", "é", "don't", "12", ".", "<|endoftext|><|endoftext|>"]
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a" * 3_000 + "<|endoftext|> b " * 1_000, None]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    default = Tokenizer.from_file(PATH)
    check(K.pack(docs, PATH, public_tokenizers.PATTERN, special=True).collect(), rows, default)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(queries.op6_minimum_bin_slack_packing(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect(), rows, default)
    check(corpus_pipeline.token_packing(spark, docs, str(tmp_path)).collect(), rows, default)
