r"""Secrets in every version of every text, each distinct content scanned once, with DataFrame functions only.

A version is a row: something that names it (a path, a document) and a text. Its blob is the text's
SHA-256, so copies, moved files and reverted changes share one. The ledger is a table in the shared
folder: for each scanned blob the rules, with the version of their pattern, that were applied, and what
they found. A scan reads all versions, reduces them to distinct blobs within the map tasks and then by
blob, drops every (blob, rule version) pair that the ledger holds, scans the rest, appends one row a
blob, and joins the findings of all blobs back to all versions. A new commit of a repository costs its new
contents only; a changed rule costs that rule alone.

The base rules give the spans the contract names; RULES adds well-known key formats. Every rule reads a
text from left to right without overlaps. A match with too short a secret is dropped, and what it
covered is not searched again. Positions come from the texts between matches, by sums over the two;
the sums run over blocks, so that a text with very many matches takes linear time, not quadratic.

A blob held by a third of all versions is one row for each map task after the first reduction; in
the join back its versions are (id, blob) pairs, dealt over SALTS places to which the findings are copied.

Defined cases: null is the empty text; it has no findings; versions with equal ids each get a result;
positions count code points, end exclusive; other columns are ignored; an empty table gives no rows, a
missing ledger is an empty one. Losing executors or the whole job loses nothing: an unfinished scan
leaves no rows, and pairs scanned by two jobs at once are counted once.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, and how long group `part` of a match must be."""

    name: str
    pattern: str
    part: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        """Changes with anything that may change what is found."""
        digest = hashlib.sha256(f"{self.pattern}\0{self.part}\0{self.least}".encode()).hexdigest()
        return f"{self.name}-{digest[:12]}"


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case, letter by letter, so that no other letters fold into it."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Words that a secret is assigned to; a fixed list.
ASSIGNED = ("password", "passwd", "secret", "token", "api_?key")
BASE = (
    Rule("assign", f"({'|'.join(map(either_case, ASSIGNED))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}"),  # whole runs: a shorter one holds no match
)
#: Published formats of keys; fixed values.
RULES = (
    *BASE,
    Rule("session", "ASIA[A-Z0-9]{16,}"),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abeoprs]-[A-Za-z0-9-]{20,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("bearer", "[Bb]earer\\x20[A-Za-z0-9._~+/=-]{20,}"),
    Rule("private_key", "-----BEGIN( [A-Z]+){0,4} PRIVATE KEY-----"),
)
FOUND = "array<struct<start: bigint, end: bigint, rule: string>>"
LEDGER = f"blob string, rules array<string>, found {FOUND}, scan string"
BLOCK = 256
SALTS = 32


def bound(value: Column, body) -> Column:
    """body(value), with value computed once, however often body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's matches in a text, as (start, end, rule version) in order, less those with too short a secret."""
    length = lambda t: F.char_length(t).cast("long")
    matched = lambda part: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(part)), length)
    pieces = F.struct(
        F.transform(F.split(text, rule.pattern, -1), length).alias("gaps"), matched(0).alias("hits"), matched(rule.part).alias("parts")
    )
    starts_of_block = lambda b: (b * BLOCK + 1).cast("int")

    def placed(p: Column) -> Column:
        last = F.size(p["hits"]) - 1
        blocks = F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int"))
        steps = F.zip_with(p["gaps"], p["hits"], lambda g, h: g + F.coalesce(h, F.lit(0)))

        def spans(s: Column) -> Column:
            sums = F.transform(blocks, lambda b: total(F.slice(s, starts_of_block(b), F.lit(BLOCK))))
            before = bound(sums, lambda v: F.transform(blocks, lambda b: total(F.slice(v, F.lit(1), b))))

            def numbered(v: Column) -> Column:
                def span(i: Column) -> Column:
                    block = F.floor(i / BLOCK).cast("int")
                    end = F.get(v, block) + total(F.slice(s, starts_of_block(block), i % BLOCK + 1))
                    own = F.struct((end - F.get(p["hits"], i)).alias("start"), end.alias("end"), F.lit(rule.version).alias("rule"))
                    return F.when(F.get(p["parts"], i) >= rule.least, own)

                return F.filter(F.transform(F.sequence(F.lit(0), last), span), lambda x: x.isNotNull())

            return bound(before, numbered)

        return F.when(last >= 0, bound(steps, spans)).otherwise(F.array().cast(FOUND))

    return F.when(text.rlike(rule.pattern), bound(pieces, placed)).otherwise(F.array().cast(FOUND))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row for each blob of each scan: the rules applied then, and all they found."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, text, rules: each distinct text with the rule versions that the ledger does not hold for it."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    blobs = versions.select(F.sha2(whole, 256).alias("blob"), whole.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    left = F.array_except(F.array(*[F.lit(r.version) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", left.alias("rules")).where(F.size("rules") > 0)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, blob, and spans (kind, start, end, by start, then kind as listed), for each row of versions.

    ledger: a folder of the shared file system; what the scan learns is added to it.
    """
    spark = versions.sparkSession
    todo = unseen(versions, read_ledger(spark, ledger), rules)
    found = [F.when(F.array_contains("rules", r.version), spans_of(F.col("text"), r)).otherwise(F.array().cast(FOUND)) for r in rules]
    # A folder of its own: scans may run side by side, and an unfinished one leaves nothing to read.
    todo.select("blob", "rules", F.concat(*found).alias("found")).write.parquet(f"{ledger}/scan={uuid.uuid4().hex}")

    order = {r.version: k for k, r in enumerate(rules)}
    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    current = F.filter("found", lambda f: f["rule"].isin(list(order)))
    parts = read_ledger(spark, ledger).select("blob", F.struct("rules", current.alias("found")).alias("part"))
    parts = parts.where(F.size("part.found") > 0).groupBy("blob").agg(F.collect_list("part").alias("parts"))
    # A pair that two scans met at once counts once: of each part, the rules that no part before it has.
    none_yet = F.struct(F.array().cast("array<string>").alias("rules"), F.array().cast(FOUND).alias("found"))

    def merge(a: Column, x: Column) -> Column:
        more = F.filter(x["found"], lambda f: ~F.array_contains(a["rules"], f["rule"]))
        return F.struct(F.array_union(a["rules"], x["rules"]).alias("rules"), F.concat(a["found"], more).alias("found"))

    known = parts.select("blob", F.aggregate("parts", none_yet, merge)["found"].alias("found"))
    names = F.array(*[F.lit(r.name) for r in rules])
    ranked = F.sort_array(F.transform("found", lambda f: F.struct(f["start"], ranks[f["rule"]].alias("k"), f["end"])))
    spans = F.transform(ranked, lambda f: F.struct(F.get(names, f["k"]).alias("kind"), f["start"], f["end"]))
    # Copies of one blob may be a third of all versions, so they meet its findings in SALTS places.
    known = known.select("blob", spans.alias("spans")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob")
    salt = (F.monotonically_increasing_id() % SALTS).cast("int").alias("salt")
    paths = versions.select(F.struct(*keep).alias("row"), blob, salt).join(known, ["blob", "salt"], "left")
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    return paths.select("row.*", "blob", F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
