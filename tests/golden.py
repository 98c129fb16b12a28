"""The 1,800 events of the scenario corpus, as topic log and ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.routes import map_routes
from tidemark.schemas import AFTER, BEFORE, DURING

# Ids of the three phases, and the record counts per partition after each.
PHASES = [(BEFORE, 1, 600), (DURING, 601, 1500), (AFTER, 1501, 1800)]
SIZES = {BEFORE: [229, 177, 194], DURING: [520, 499, 481], AFTER: [619, 594, 587]}
DAY_MS = 86_400_000
START_MS = 1_700_000_000_000


def key_hash(data: bytes) -> int:
    """The public murmur2 hash that Kafka's default partitioner takes of a key."""
    mask, m = 0xFFFFFFFF, 0x5BD1E995
    h = 0x9747B28C ^ len(data)
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * m & mask
        h = (h * m & mask) ^ ((k ^ k >> 24) * m & mask)
    tail = int.from_bytes(data[whole:], "little")
    if tail:
        h = (h ^ tail) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


def route(event_id: int) -> str:
    return "rare" if event_id % 500 == 0 else ("a", "b")[event_id % 2]


def golden_log(spark, skew_outage: bool = False):
    """(topic, partition, offset, record_ts, event_id, produced_at, route, payload, phase)."""
    ends, rows = [0, 0, 0], []
    for phase, first, last in PHASES:
        for event_id in range(first, last + 1):
            partition = (key_hash(str(event_id).encode()) & 0x7FFFFFFF) % 3
            produced_at = START_MS + event_id * 17
            shift = -DAY_MS if skew_outage and phase == DURING else 0
            rows.append(("events", partition, ends[partition], produced_at + shift, event_id,
                         produced_at, route(event_id), f"payload-{event_id}", phase))
            ends[partition] += 1
    schema = (
        "topic string, partition int, offset bigint, record_ts bigint, event_id bigint, "
        "produced_at bigint, route string, payload string, phase string"
    )
    return spark.createDataFrame(rows, schema)


def as_sink(log):
    return (
        map_routes(log)
        .where(F.col("sink_table").isNotNull())
        .withColumnsRenamed({"topic": "src_topic", "partition": "src_part", "offset": "src_offset"})
    )
