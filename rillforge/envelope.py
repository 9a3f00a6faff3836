"""The change envelope and its columns.

key, before and after are canonical JSON text; seq is the arrival position within a source, on which
every order-sensitive operator relies (offset is opaque text and no order key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = ("Create", "Update", "Delete", "Snapshot", "Commit", "Rollback")
TERMINATORS = ("Commit", "Rollback")
MUTATIONS = ("Create", "Update", "Delete", "Snapshot")
COLUMNS = ["id", "source_database", "source_table_or_collection", "operation", "timestamp", "key", "before", "after", "transaction_id", "offset", "seq"]
SCHEMA = "id string, source_database string, source_table_or_collection string, operation string, timestamp timestamp_ntz, key string, before string, after string, transaction_id string, offset string, seq long"


def canonical(json: Column) -> Column:
    """Compact JSON with sorted keys; text that isn't JSON stays as it is. 1.0 becomes 1."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), json)


def is_terminator() -> Column:
    return F.col("operation").isin(*TERMINATORS)


def serialize(df: DataFrame, name: str = "json") -> DataFrame:
    """Adds the envelope as compact JSON in field order, nulls kept, payloads nested."""
    nested = lambda c: F.try_parse_json(c).alias(c)
    fields = [nested(c) if c in ("key", "before", "after") else F.col(c) for c in COLUMNS[:-1]]
    return df.withColumn(name, F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}))


def from_events(events: DataFrame) -> DataFrame:
    """The envelope of an events table: three mutations and a terminator for each transaction."""
    lane, tx = F.col("event_id") % 4, F.floor(F.col("event_id") / 4)
    kind = F.when(F.col("event_type") == "signup", "Create").when(F.col("event_type") == "error", "Delete").otherwise("Update")
    return events.select(
        F.concat(F.lit("evt-"), F.col("event_id")).alias("id"), F.lit("app").alias("source_database"), F.lit("events").alias("source_table_or_collection"),
        F.when(lane == 3, F.when(tx % 10 == 0, "Rollback").otherwise("Commit")).otherwise(kind).alias("operation"), F.col("ts").alias("timestamp"),
        F.to_json(F.struct("user_id")).alias("key"), F.lit(None).cast("string").alias("before"), F.to_json(F.struct("event_type", "user_id", "value")).alias("after"),
        F.concat(F.lit("tx-"), (tx + 1000).cast("string")).alias("transaction_id"), F.col("event_id").cast("string").alias("offset"), F.col("event_id").alias("seq"),
    )
