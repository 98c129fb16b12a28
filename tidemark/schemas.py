"""Row shapes shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of a record's place in a topic, as the Kafka source spells them.
POSITION = ["topic", "partition", "offset"]
PARTITION = ["topic", "partition"]

TOPIC_LOG = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("record_ts", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
    ]
)

# Column names.
LEDGER = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("produced_at", T.LongType()),
        T.StructField("route", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("record_ts", T.LongType()),
    ]
)

# Column names.
SINK = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("produced_at", T.LongType()),
        T.StructField("route", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("src_topic", T.StringType()),
        T.StructField("src_part", T.IntegerType()),
        T.StructField("src_offset", T.LongType()),
        T.StructField("inserted_at", T.TimestampType()),
        T.StructField("sink_table", T.StringType()),
    ]
)

# Everything in [from_offset, next_offset) of a partition is accounted for.
PROGRESS = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("from_offset", T.LongType()),
        T.StructField("next_offset", T.LongType()),
        T.StructField("rows_written", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# Column names.
REJECTS = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("rejected_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)

COMMIT_AUDIT = T.StructType(
    [
        T.StructField("event_time", T.TimestampType()),
        T.StructField("written_rows", T.LongType()),
        T.StructField("log_comment", T.StringType()),
    ]
)

# The range note inside `log_comment`; `to` is inclusive.
COMMIT_NOTE = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("p", T.IntegerType()),
        T.StructField("from", T.LongType()),
        T.StructField("to", T.LongType()),
    ]
)

# Which table takes which route.
ROUTE_TABLES = {"a": "t_a", "b": "t_b", "rare": "t_rare"}
TABLES = ["t_a", "t_b", "t_rare"]

# The three phases of an outage, in time order.
BEFORE, DURING, AFTER = "before-outage", "during-outage", "after-restart"
