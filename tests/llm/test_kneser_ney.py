import numpy as np
from tests.llm.shapes import labels_of, no_docs, odd_docs, odd_rows
from tidemark.llm import kneser_ney as N


def test_junk_goes_and_good_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = N.judge(docs, labels).join(labels, "doc_id").select("quality", "kept").collect()
    share = lambda q: np.mean([r["kept"] for r in rows if r["quality"] == q])
    assert share(1) > 0.985 and share(0) < 0.35


def test_odd_documents(spark):
    labels = labels_of(spark, [(1, 1, 0), (1, 0, 0), (6, 1, 0), (10, 1, 0), (None, 1, 1), (3, 1, 1)])
    rows = N.judge(odd_docs(spark), labels).collect()
    assert len(rows) == len(odd_rows())
    assert all(r["perplexity"] is None and not r["kept"] for r in rows if not r["n_symbols"])
    assert all(r["kept"] for r in N.judge(odd_docs(spark), labels_of(spark, [])).collect() if r["n_symbols"])
    assert N.judge(no_docs(spark), labels).count() == 0
