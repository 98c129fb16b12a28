"""Wire text <-> typed columns.

A record's value is UTF-8 text: ``event_id TAB produced_at TAB route TAB payload``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAB = "\t"
# Ends in \z, since $ also matches before a final newline.
STRICT_LONG = r"\A[+-]?[0-9]+\z"

# What became of a record while decoding.
EVENT, MALFORMED, EMPTY = "event", "malformed", "empty"


def text_of(value: Column) -> Column:
    """bytes as text, undecodable bytes replaced by U+FFFD instead of failing."""
    return F.make_valid_utf8(value.cast("string"))


def strict_long(text: Column) -> Column:
    """A long only if the whole text is one: blanks, decimals and overflow give null."""
    return F.when(text.rlike(STRICT_LONG), text.try_cast("bigint"))


def decode(log: DataFrame) -> DataFrame:
    """adds event_id, produced_at, route, payload, disposition and reason.

    No row is dropped, because each occupies an offset: a null value is ``empty``, a line
    with under four fields or a bad number is ``malformed`` with its reason, the rest is
    ``event``. Fields past the fourth are ignored.

    The two one-element generators are there on purpose: without them the optimizer copies
    the split and the number checks into every later filter and condition, until the
    generated code no longer compiles.
    """
    split = log.select(
        "*", F.explode(F.array(F.split(text_of(F.col("value")), TAB, -1))).alias("_fields")
    )
    typed = split.select(
        "*",
        F.inline(
            F.array(
                F.struct(
                    strict_long(F.get("_fields", F.lit(0))).alias("event_id"),
                    strict_long(F.get("_fields", F.lit(1))).alias("produced_at"),
                    F.get("_fields", F.lit(2)).alias("route"),
                    F.get("_fields", F.lit(3)).alias("payload"),
                    F.size("_fields").alias("_count"),
                )
            )
        ),
    )
    reason = (
        F.when(F.col("_count") < 4, F.lit("fields"))
        .when(F.col("event_id").isNull(), F.lit("event_id"))
        .when(F.col("produced_at").isNull(), F.lit("produced_at"))
    )
    return (
        typed.withColumn("reason", F.when(F.col("value").isNotNull(), reason))
        .withColumn(
            "disposition",
            F.when(F.col("value").isNull(), EMPTY)
            .when(F.col("reason").isNotNull(), MALFORMED)
            .otherwise(EVENT),
        )
        .drop("_fields", "_count")
    )


def events_only(decoded: DataFrame) -> DataFrame:
    """The decoded rows that are events."""
    return decoded.where(F.col("disposition") == EVENT).drop("disposition", "reason")


def malformed(decoded: DataFrame) -> DataFrame:
    """The records that could not be read, with the raw text kept for repair."""
    return decoded.where(F.col("disposition") == MALFORMED).withColumn(
        "payload", text_of(F.col("value"))
    )


def wire_text() -> Column:
    """the four fields as wire text; a null field is an empty one, never left out."""
    fields = ("event_id", "produced_at", "route", "payload")
    return F.concat_ws(TAB, *[F.coalesce(F.col(name).cast("string"), F.lit("")) for name in fields])


def encode(events: DataFrame) -> DataFrame:
    """sets key (the decimal id) and value (wire text) from the typed columns."""
    return events.withColumns(
        {
            "key": F.encode(F.col("event_id").cast("string"), "UTF-8"),
            "value": F.encode(wire_text(), "UTF-8"),
        }
    )
