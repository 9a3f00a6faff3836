"""Structured Streaming forms: transaction buffer, FIFO dedup, watermark window, and the composed stream.

Dedup, window and the composed stream are steps of ``foreachBatch``: each micro-batch goes through the distributed
batch operator, with the state that the one before left in a folder. So no task holds all rows of a source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..envelope import COLUMNS, MUTATIONS, SCHEMA
from ..operators import ordered, stateless
from ..sources import sinks
from ..state import StateStore, latest_offsets

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A call's rows in arrival order, which the shuffle has lost."""
    parts = [x for x in rows if len(x)]
    return pd.concat(parts).sort_values("seq", kind="stable") if parts else pd.DataFrame(columns=COLUMNS)


def _plain(row: tuple) -> tuple:
    return tuple(None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row)


class TransactionBuffer(StatefulProcessor):
    """Keyed by source and transaction: mutations wait in state until their commit or rollback."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held = [_plain(tuple(r)) for r in self.rows.get()] if self.rows.exists() else []
        op = COLUMNS.index("operation")
        for row in map(_plain, _sorted(rows)[COLUMNS].itertuples(index=False)):
            if row[op] == "Commit":
                out += held
                held = []
            elif row[op] == "Rollback":
                held = []
            elif row[op] in MUTATIONS:
                held.append(row)
        if held:
            self.rows.put(held)
        else:
            self.rows.clear()
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def _run(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "None")


def buffer_transactions(stream: DataFrame) -> DataFrame:
    """Committed mutations, and rows without transaction as they are."""
    stream = stream.select(*COLUMNS)
    tx = _run(stream.where("transaction_id is not null"), ["source_database", "transaction_id"], TransactionBuffer(), SCHEMA)
    return tx.unionByName(stream.where("transaction_id is null"))


class Memory:
    """State between micro-batches in a folder: batch n reads what batch n - 1 left, and replaces what an earlier run of itself left."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path, schema

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/batch_id={batch_id - 1}")

    def write(self, df: DataFrame, batch_id: int) -> None:
        sinks.batch_files(self.path)(df, batch_id)
        spark = df.sparkSession  # no run of a batch can need what was there before its predecessor
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch_id={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def _on_disk(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.DISK_ONLY)


QUEUES = "source_database string, seq long, id string"
Write = Callable[[DataFrame, int], None]


def dedup(path: str, write: Write, capacity: int = 1000) -> Write:
    """A foreachBatch function: writes the events whose id isn't among the last ``capacity`` accepted ones of their source."""
    memory = Memory(path, QUEUES)

    def run(batch: DataFrame, batch_id: int) -> None:
        kept, queues, ranges = ordered.fifo(batch.select(*COLUMNS), capacity, held=memory.read(batch.sparkSession, batch_id), keep=_on_disk)
        try:
            memory.write(queues.repartition("source_database"), batch_id)
            write(kept, batch_id)
        finally:
            ranges.unpersist()

    return run


def mark_windows(path: str, write: Write, marker: str = stateless.MARKER_TABLE) -> Write:
    """A foreachBatch function: writes events with in_window and swallows markers; any two markers make a window."""
    memory = Memory(path, "source_database string")

    def run(batch: DataFrame, batch_id: int) -> None:
        flagged, open_, ranges = ordered.window_flags(batch.select(*COLUMNS), marker, held=memory.read(batch.sparkSession, batch_id), keep=_on_disk)
        try:
            memory.write(open_, batch_id)
            write(flagged, batch_id)
        finally:
            ranges.unpersist()

    return run


def transactional(stream: DataFrame, schema: dict | None, partitions: int = 4) -> DataFrame:
    """The transactional pipeline as a streaming frame: valid, committed and routed events.

    Ids are remembered for good, which ``dropDuplicates`` spreads over tasks; ``start`` is the form with a capacity.
    """
    valid = stateless.split(stateless.validate(_unique(stream), schema))[0]
    return stateless.route(buffer_transactions(stateless.drop_markers(valid)), partitions)


def _unique(stream: DataFrame) -> DataFrame:
    return stream.select(*COLUMNS).dropDuplicates(["id"])


@dataclass
class Running:
    """The query of a composed stream."""

    query: StreamingQuery

    def wait(self, seconds: float | None = None) -> None:
        self.query.awaitTermination(seconds)

    def stop(self) -> None:
        """A graceful stop: what has arrived is processed first, so that no batch is cut off."""
        if self.query.isActive:
            self.query.processAllAvailable()
            self.query.stop()


def start(
    stream: DataFrame, config, path: str, store: StateStore | None = None, is_leader: Callable[[], bool] = lambda: True, sinks_: tuple = (), available_now: bool = True,
) -> Running | None:
    """Run the transactional pipeline: events, dead letters and checkpoints go to folders of ``path``, offsets to ``store``.

    Only a leader starts queries (None otherwise): a standby reads nothing, so it drops nothing. A batch is
    written by its number, so one that runs again after a failure replaces itself; a sink that fails fails the
    batch, and the offset of a source is saved after all sinks have the batch.
    """
    if not is_leader():
        return None

    queues, open_ = Memory(f"{path}/state_queues", QUEUES), Memory(f"{path}/state_open", SCHEMA)
    bounded = config.capacity is not None

    def process(batch: DataFrame, batch_id: int, held: list[DataFrame]) -> None:
        spark = batch.sparkSession
        keep = lambda df: held.append(_on_disk(df)) or held[-1]
        unique = batch.select(*COLUMNS)
        if bounded:
            unique, after, _ = ordered.fifo(unique, config.capacity, held=queues.read(spark, batch_id), keep=keep)
            queues.write(after.repartition("source_database"), batch_id)
        told = keep(stateless.validate(unique, config.schema))
        bury(told.where("error_reason is not null"), batch_id)
        valid = stateless.drop_markers(told.where("error_reason is null").drop("error_reason"), config.marker)
        passed, waiting, _ = ordered.gate(valid, open_.read(spark, batch_id), keep)
        open_.write(waiting, batch_id)
        emit(passed, batch_id)

    def run(batch: DataFrame, batch_id: int) -> None:
        held: list[DataFrame] = []
        try:
            process(batch, batch_id, held)
        finally:
            for df in held:
                df.unpersist()

    def emit(batch: DataFrame, batch_id: int) -> None:
        done, failed = stateless.split(config.transform(batch))
        sinks.batch_files(f"{path}/letters_transform")(sinks.dead_letters(failed, F.col("error_reason"), "Transform"), batch_id)
        routed = stateless.route(done, config.partitions, config.strategy)
        sinks.fan_out(sinks.batch_files(f"{path}/events"), *sinks_)(routed, batch_id)
        if store is not None:
            for row in latest_offsets(routed).collect():  # one row for each source
                store.save_offset(row[0], row[1])

    def bury(batch: DataFrame, batch_id: int) -> None:
        sinks.batch_files(f"{path}/letters_validation")(sinks.dead_letters(batch, F.col("error_reason"), "SchemaValidation"), batch_id)

    source = stream if bounded else _unique(stream)
    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/checkpoint")
    return Running((writer.trigger(availableNow=True) if available_now else writer).start())
