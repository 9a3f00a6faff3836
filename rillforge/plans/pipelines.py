"""The composed pipelines in batch: transactional, non-transactional, and snapshot."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered, stateless


@dataclass
class Config:
    schema: dict | None = None
    capacity: int = 1000
    exact_dedup: bool = False
    transform: stateless.Transform = field(default_factory=stateless.passthrough)
    partitions: int = 4
    strategy: stateless.PartitionStrategy = stateless.PartitionStrategy.KEY_HASH
    marker: str = stateless.MARKER_TABLE


@dataclass
class Output:
    events: DataFrame  # with emit_seq and partition
    invalid: DataFrame  # with error_reason, failed step SchemaValidation
    failed: DataFrame  # with error_reason, failed step Transform


def _dedup(df: DataFrame, config: Config) -> DataFrame:
    return ordered.dedup_fifo(df, config.capacity) if config.exact_dedup else ordered.dedup_keep_first(df)


def transactional(df: DataFrame, config: Config) -> Output:
    """Dedup, validate, drop markers, gate transactions, transform, route; in that order.

    Validation comes after dedup, so an invalid id blocks its resend, and before markers are dropped.
    """
    valid, invalid = stateless.split(stateless.validate(_dedup(df, config), config.schema))
    gated = ordered.tx_committed(stateless.drop_markers(valid, config.marker))
    done, failed = stateless.split(config.transform(gated))
    return Output(stateless.route(done, config.partitions, config.strategy), invalid, failed)


def non_transactional(df: DataFrame, config: Config) -> Output:
    """As above without validation and markers."""
    done, failed = stateless.split(config.transform(ordered.tx_committed(_dedup(df, config))))
    return Output(stateless.route(done, config.partitions, config.strategy), df.limit(0).withColumn("error_reason", F.lit(None).cast("string")), failed)


def snapshot(rows: DataFrame, key: str, total: int, size: int) -> DataFrame:
    """Chunks of a table with their row counts, all completed."""
    return ordered.process_chunks(ordered.plan_chunks(rows.sparkSession, total, size), rows, key, size, total)
