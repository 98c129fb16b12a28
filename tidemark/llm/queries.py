"""The registered queries of this subpackage: each operator over its whole tables."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, hilbert, kneser_ney, licenses, merkle, packing, periodic, pii, quality, repeats, secrets, simhash, toxicity
from tidemark.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col("f")[c].alias(c) for c in counts], "base_failed", "kept", F.array_join("rules", ",").alias("rules"))


@query
def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, budget=2)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


# Words and their places, then 13-word windows (short items whole) met on their joined words.
ORACLES["op5_suffix_array_decontamination"] = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (gram, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY 1),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


@query
def op6_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, special=True)


@query
def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("curve").cast("long").alias("curve"),
    )


@query
def op3_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), best.alias("best_share"))


def _license_sql() -> str:
    """All windows of all texts against the templates, by counting shared shingles."""
    values = ", ".join(f"('{name}', '{text}')" for name, text in licenses.TEMPLATES.items())
    words = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    return f"""
WITH t AS (SELECT name, {words} AS w FROM (VALUES {values}) AS v(name, text)),
tg AS (SELECT DISTINCT name, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT name, w, unnest(generate_series(1, len(w) - 4)) AS i FROM t)),
ts AS (SELECT name, count(*) AS m FROM tg GROUP BY 1),
sz AS (
  SELECT name, m, CASE WHEN m <= 2 THEN 2 ELSE CAST(pow(2, ceil(log2(2 * (m - 1)))) AS BIGINT) END AS size FROM ts),
d AS (SELECT doc_id, {words} AS w FROM documents),
dg AS (
  SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
hit AS (SELECT doc_id, p, gram, name, m, size FROM dg JOIN tg USING (gram) JOIN sz USING (name)),
win AS (
  SELECT doc_id, name, m, gram, p - p % (size // 2) AS start FROM hit
  UNION ALL
  SELECT doc_id, name, m, gram, p - p % (size // 2) - size // 2 FROM hit WHERE p - p % (size // 2) > 0),
ok AS (
  SELECT doc_id, name, max(share) AS share FROM (
    SELECT doc_id, name, start, count(DISTINCT gram) / any_value(m) AS share FROM win GROUP BY ALL) WHERE share >= 0.8 GROUP BY 1, 2),
r AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, max(share) AS best FROM ok GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses, CAST(coalesce(best, 0) AS DOUBLE) AS best_share
FROM d LEFT JOIN r USING (doc_id)
"""


ORACLES["op2_license_scan"] = _license_sql()


@query
def op4_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), span=200)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op8_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def repeated_tail(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """In one document of ten, chosen by its id, the words from some place on repeat themselves."""
    h = 1 if doc_id is None else zlib.crc32(doc_id.encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_rows(docs: DataFrame) -> DataFrame:
    """Runs of each document after repeated_tail: how many, the longest, and digests of all of them and of the text left."""
    found = periodic.find_runs(docs, reword=repeated_tail)
    # The longest run; of equals the first, then the smallest period.
    order = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("back"), (-r["period"]).alias("less")))
    top = F.array_max(order)
    written = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.less")).alias("period"), F.expr("1000 * top.length div -top.less").alias("exponent_milli"),
        F.sha2(F.array_join(written, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_rows(table(spark, sf_dir, "documents"))


def witnessed_rows(docs: DataFrame) -> DataFrame:
    """Each document's witness, and the root that it leads to from the document as tampered with."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    leaves = docs.select(
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit(":"), "lang")).alias("tree"), "doc_id",
        merkle.leaf_digest(*fields, F.col("text")).alias("digest"),
        F.when(hit, merkle.leaf_digest(*fields, lowered)).alias("tampered"),
    )
    proof = F.col("proof")
    return merkle.manifest(leaves, ["doc_id"]).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(merkle.siblings(proof), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "digest"), proof).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_merkle_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return witnessed_rows(table(spark, sf_dir, "documents"))


# Levels by recursion, siblings by a join of each level with itself, then folding from the leaf to the root.
ORACLES["op13_merkle_witnesses"] = """
WITH RECURSIVE
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
rows AS (
  SELECT doc_id, coalesce(':' || lang, '') AS tree, source, lang, n_chars, text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(t[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8)), 4294967295) % 3 = 0 AS hit
  FROM documents, crc_table),
fields AS (
  SELECT doc_id, tree, hit, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM rows),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(low) || ':' || low, '-'))
      ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS given
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size
  FROM leaves),
lv AS (
  SELECT tree, 0 AS lvl, place, size, leaf AS h FROM placed
  UNION ALL
  SELECT tree, lvl + 1, place // 8, any_value((size + 7) // 8), sha256(string_agg(h, '' ORDER BY place)) FROM lv WHERE size > 1
  GROUP BY tree, lvl, place // 8),
subs AS (SELECT tree, h AS subroot FROM lv WHERE size = 1),
tops AS (SELECT tree, subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM subs),
up AS (
  SELECT 0 AS lvl, place, size, subroot AS h FROM tops
  UNION ALL
  SELECT lvl + 1, place // 8, any_value((size + 7) // 8), sha256(string_agg(h, '' ORDER BY place)) FROM up WHERE size > 1
  GROUP BY lvl, place // 8),
nodes AS (SELECT ('t' || tree) AS tree, lvl, place, size, h FROM lv UNION ALL SELECT 'u', lvl, place, size, h FROM up),
steps AS (
  SELECT a.tree, a.lvl, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.place // 8 = b.place // 8 WHERE a.size > 1 GROUP BY ALL),
ways AS (
  SELECT p.tree, p.place, s.lvl, s.l, s.r FROM placed p JOIN steps s ON s.tree = 't' || p.tree AND s.place = p.place // CAST(pow(8, s.lvl) AS BIGINT)
  UNION ALL
  SELECT p.tree, p.place, 100 + s.lvl, s.l, s.r FROM placed p JOIN tops USING (tree)
  JOIN steps s ON s.tree = 'u' AND s.place = tops.place // CAST(pow(8, s.lvl) AS BIGINT)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree, place ORDER BY lvl) AS k FROM ways),
fold AS (
  SELECT tree, place, 0 AS k, given AS h FROM placed
  UNION ALL
  SELECT tree, place, n.k, sha256(l || h || r) FROM fold JOIN numbered n USING (tree, place) WHERE n.k = fold.k + 1),
proofs AS (SELECT tree, place, string_agg(l || r, '' ORDER BY k) AS siblings, max(k) AS k FROM numbered GROUP BY ALL)
SELECT doc_id, leaf, subroot, (SELECT h FROM up WHERE size = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
  fold.h AS folded_root, fold.h = (SELECT h FROM up WHERE size = 1) AS verified
FROM placed JOIN subs USING (tree) LEFT JOIN proofs USING (tree, place)
JOIN fold ON fold.tree = placed.tree AND fold.place = placed.place AND fold.k = coalesce(proofs.k, 0)
"""


def secret_rows(docs: DataFrame, ledger: str) -> DataFrame:
    """Counts and digest of the base rules' spans, and all spans, for each document."""
    found = secrets.scan(docs, ledger)
    names = [r.name for r in secrets.BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    return found.select(
        "doc_id", *map(count, names), F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"), "blob",
    )


@query
def op12_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as the first scan of a new ledger."""
    return secret_rows(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/secrets-{uuid.uuid4().hex}")


def _secret_sql() -> str:
    """Every rule over every text; places are sums of the lengths between and of the matches before."""
    parts = []
    for k, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""SELECT n, {k} AS k, '{r.name}' AS kind, {r.least} AS least, i, len(gaps[i]) AS gap, len(hits[i]) AS hit, len(parts[i]) AS part FROM (
      SELECT n, hits, parts, gaps, unnest(generate_series(1, len(hits))) AS i FROM (
        SELECT n, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {r.part}) AS parts,
          string_split_regex(text, '{pattern}') AS gaps FROM d))""")
    counts = ", ".join(f"CAST(coalesce(count(*) FILTER (kind = '{r.name}'), 0) AS BIGINT) AS n_{r.name}" for r in secrets.BASE)
    base = ", ".join(f"'{r.name}'" for r in secrets.BASE)
    names = ", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in secrets.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
p AS (
  SELECT *, CAST(sum(gap + hit) OVER (PARTITION BY n, k ORDER BY i) AS BIGINT) AS stop FROM m),
s AS (SELECT n, k, kind, stop - hit AS start, kind || ':' || (stop - hit) || ':' || stop AS span FROM p WHERE part >= least),
g AS (
  SELECT n, {counts}, coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (kind IN ({base})), '') AS base,
    string_agg(span, ',' ORDER BY start, k) AS spans FROM s GROUP BY n)
SELECT doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob
FROM d LEFT JOIN g USING (n)
"""


ORACLES["op12_blob_ledger_secrets"] = _secret_sql()
