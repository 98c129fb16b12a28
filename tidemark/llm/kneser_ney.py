"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model is trained on all trusted documents, those labelled good. Its n-grams are over words; see
word_model. A document is kept if its perplexity lies between two quantiles of the trusted documents
of its language, each scored without its own counts; a language with few trusted documents takes those
of all. Repetitive text falls below the lower one, junk rises above the upper one.

Defined cases: null and empty texts have no perplexity and are not kept, nor are texts of blanks alone;
null language is a language of its own; a document labelled more than once is trusted only if all labels
say so; without trusted documents all words are equally likely, there are no quantiles, and all documents
with words are kept; repeated rows each get a result; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import word_model
from tidemark.llm.common import settled

LOW, HIGH = 0.002, 0.995
LEAST = 200  # trusted documents for quantiles of a language's own


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What counts of 1, 2 and 3 or more give up, from how many n-grams have counts 1 to 4."""
    if 0 in (n1, n2, n3, n4):
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))  # type: ignore[return-value]


def judge(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, least: int = LEAST) -> DataFrame:
    """word_model.perplexity() with the bounds low, high that hold for the row, and kept."""
    scored = settled(word_model.perplexity(docs, trusted_ids(labels), discounts))
    good = scored.where("perplexity is not null").join(trusted_ids(labels), "doc_id")
    q = F.percentile_approx("perplexity", [low, high], 100_000)
    every = good.agg(q.alias("q")).first()["q"]
    own = settled(good.groupBy(F.col("lang").alias("_lang")).agg(q.alias("q"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    met = scored.join(own, scored["lang"].eqNullSafe(own["_lang"]), "left")
    bound = lambda i: F.coalesce(F.get("q", F.lit(i)), F.lit(every[i] if every else None).cast("double"))
    out = met.select("doc_id", "lang", "n_symbols", "perplexity", bound(0).alias("low"), bound(1).alias("high"))
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & inside)
