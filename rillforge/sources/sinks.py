"""Sinks: console, files by partition, peers, dead letters, and fan-out for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..envelope import COLUMNS, serialize
from ..operators.stateless import should_forward


class SinkError(Exception):
    """category: Connection, Delivery, Unreachable or Serialization."""

    def __init__(self, category: str, detail: str):
        super().__init__(f"{category}: {detail}")


def console(df: DataFrame, rows: int = 20) -> None:
    serialize(df).select("json").show(rows, truncate=False)


def topic_files(df: DataFrame, path: str) -> None:
    """key, value and partition as a broker's topic would hold them; one folder for each partition."""
    serialize(df, "value").select("key", "value", "partition").write.mode("append").partitionBy("partition").parquet(path)


def broker(df: DataFrame, servers: str, topic: str) -> None:
    """The Kafka sink, where its connector is on the class path."""
    serialize(df, "value").select("key", "value", F.lit(topic).alias("topic"), F.col("partition").cast("int")).write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def forward(df: DataFrame, cluster: str, path: str) -> None:
    """Envelopes for a peer cluster with their sizes."""
    forwarded(df, cluster).write.mode("append").json(path)


def forwarded(df: DataFrame, cluster: str) -> DataFrame:
    return serialize(df, "payload").select(F.lit(cluster).alias("cluster_id"), "id", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"))


def dead_letters(failed: DataFrame, reason: Column, step: str, retries: int = 1, at: Column | None = None) -> DataFrame:
    """failed_event, error_reason, failed_step, timestamp, retry_attempts."""
    return failed.select(
        F.struct(*COLUMNS).alias("failed_event"), reason.alias("error_reason"), F.lit(step).alias("failed_step"), (at if at is not None else F.current_timestamp()).alias("timestamp"), F.lit(retries).alias("retry_attempts")
    )


def forward_to_peers(df: DataFrame, peers, path: str) -> list[str]:
    """Forward to each active peer but the local cluster; what came from a peer doesn't go back to it. Gives the folders."""
    out = []
    for node in peers.nodes:
        if node["is_active"] and node["cluster_id"] != peers.local:
            out.append(f"{path}/{node['cluster_id']}")
            forward(df.where(should_forward(node["cluster_id"])), node["cluster_id"], out[-1])
    return out


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: every sink in turn; an error fails the batch, so offsets don't run ahead. A batch is kept for many sinks, not for one."""
    if len(sinks) == 1:
        return sinks[0]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def batch_files(path: str, format: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A sink that a repeated batch overwrites, so that retries don't write twice."""
    return lambda batch, batch_id: batch.write.mode("overwrite").format(format).save(f"{path}/batch_id={batch_id}")
