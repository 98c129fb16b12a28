import random
import struct
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.shapes import odd_rows, sentence
from tests.llm.test_decontam import slow as slow_hits
from tests.llm.test_simhash import classes, slow_print
from tidemark.llm import pii, quality


def write(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    rng = random.Random(1)
    items = [(i, sentence(rng, 20)) for i in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return items


def test_run_equals_the_stages_in_plain_python(spark, tmp_path):
    rng = random.Random(7)
    items = [(i, sentence(random.Random(1), 20)) for i in range(1)]
    texts = [sentence(rng, rng.randint(5, 300)) for _ in range(40)]
    texts += [texts[0], texts[1], items[0][1] + " " + sentence(rng, 40), "short", sentence(rng, 30) + " a.b@c.de 10.1.2.3"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(100 + i, t, *r) for i, (_, t, *r) in enumerate(odd_rows())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    items = write(spark, str(tmp_path), docs)

    left = [(r[0], r[1]) for r in rows if not _base_failed(r[1])]  # too few labels to prove a cutoff
    prints = {i: slow_print(t) for i, t in left}
    root, least = classes(sorted(set(prints.values())), 2), {}
    for i, _ in sorted(left):
        least.setdefault(root[prints[i]], i)
    left = [(i, t) for i, t in left if i in least.values()]
    left = [(i, t) for i, t in left if not slow_hits(t, items)[3]]
    field = pii.train(spark.createDataFrame(left, "doc_id long, text string"))
    left = [(i, pii._masked(t, field)) for i, t in left]
    coder, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t in left:
        ids = coder.encode(t, add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 2048):
            own = ids[start : start + 2048]
            expected[i, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)), len(ids)] += 1

    got = C.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected
    assert any("<EMAIL>" in t for _, t in left)


def _base_failed(text):
    n, _, _, _, _, repeated, _ = quality._features(text)
    return n < 20 or 100 * repeated > 30 * n


def test_stages_keep_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
