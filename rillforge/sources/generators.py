"""Generated sources, resumption, retries, and a Python data source over them."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..envelope import COLUMNS, SCHEMA

T = TypeVar("T")


class SourceError(Exception):
    """category: Connection, Slot, Parse, DirectoryAccess or CommitLogParse."""

    def __init__(self, category: str, detail: str):
        super().__init__(f"{category}: {detail}")
        self.category = category


def retry_with_backoff(
    attempt: Callable[[], T], max_attempts: int = 5, initial_delay: float = 0.05, multiplier: float = 2.0, max_delay: float = 0.5,
    sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random,
) -> T:
    """The first success, or the error of the last attempt. The cap on delays comes before jitter of 0.75 to 1.25."""
    delay = initial_delay
    for n in range(1, max_attempts + 1):
        try:
            return attempt()
        except Exception:
            if n == max_attempts:
                raise
        sleep(min(delay, max_delay) * (0.75 + jitter() / 2))
        delay = min(delay * multiplier, max_delay)
    raise ValueError("max_attempts must be at least 1")


def resume_position(offset: Column) -> Column:
    """The offset as a number; 0 for null and for what isn't one."""
    return F.coalesce(offset.try_cast("bigint"), F.lit(0))


def start_after(offset: str | None) -> int:
    return int(offset) if offset is not None and offset.isascii() and offset.isdigit() else 0


def transactional(numbers: DataFrame, at: Column | None = None) -> DataFrame:
    """Users in transactions of four events, the last of them the commit. numbers: n from 1."""
    n = F.col("n")
    text = n.cast("string")
    after = F.to_json(F.struct(n.alias("id"), F.concat(F.lit("User "), text).alias("name"), F.concat(F.lit("user"), text, F.lit("@example.com")).alias("email")))
    return numbers.select(
        F.concat(F.lit("pg-evt-"), text).alias("id"), F.lit("app_db").alias("source_database"), F.lit("users").alias("source_table_or_collection"),
        F.when(n % 4 == 0, "Commit").when(n % 4 == 1, "Create").otherwise("Update").alias("operation"),
        (at if at is not None else F.current_timestamp()).cast("timestamp_ntz").alias("timestamp"), F.to_json(F.struct(n.alias("id"))).alias("key"),
        F.lit(None).cast("string").alias("before"), F.when(n % 4 != 0, after).alias("after"),
        F.concat(F.lit("tx-"), (F.floor((n - 1) / 4) + 1000).cast("string")).alias("transaction_id"), text.alias("offset"), n.alias("seq"),
    )


def commit_log(numbers: DataFrame, at: Column | None = None) -> DataFrame:
    """Sensor readings without transactions. numbers: n from 1."""
    n = F.col("n")
    when = (at if at is not None else F.current_timestamp()).cast("timestamp_ntz")
    sensor = F.concat(F.lit("sensor-"), (n % 10).cast("string"))
    return numbers.select(
        F.concat(F.lit("cas-evt-"), n.cast("string")).alias("id"), F.lit("app_keyspace").alias("source_database"), F.lit("sensor_readings").alias("source_table_or_collection"),
        F.lit("Create").alias("operation"), when.alias("timestamp"), F.to_json(F.struct(sensor.alias("sensor_id"), when.cast("string").alias("timestamp"))).alias("key"),
        F.lit(None).cast("string").alias("before"), F.to_json(F.struct(sensor.alias("sensor_id"), F.round(20.0 + n * 0.1, 3).alias("reading_value"), F.lit("OK").alias("status"))).alias("after"),
        F.lit(None).cast("string").alias("transaction_id"), n.cast("string").alias("offset"), n.alias("seq"),
    )


def numbers(spark: SparkSession, offset: str | None, count: int) -> DataFrame:
    start = start_after(offset)
    return spark.range(start + 1, start + count + 1).withColumnRenamed("id", "n")


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _row(n: int) -> tuple:
    import datetime

    after = None if n % 4 == 0 else f'{{"id":{n},"name":"User {n}","email":"user{n}@example.com"}}'
    kind = "Commit" if n % 4 == 0 else "Create" if n % 4 == 1 else "Update"
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    return (f"pg-evt-{n}", "app_db", "users", kind, now, f'{{"id":{n}}}', None, after, f"tx-{(n - 1) // 4 + 1000}", str(n), n)


def _reading(n: int) -> tuple:
    """A row as ``commit_log`` gives it."""
    import datetime

    now, sensor = datetime.datetime.now(datetime.UTC).replace(tzinfo=None), f"sensor-{n % 10}"
    after = f'{{"sensor_id":"{sensor}","reading_value":{round(20 + n * 0.1, 3)},"status":"OK"}}'
    return (f"cas-evt-{n}", "app_keyspace", "sensor_readings", "Create", now, f'{{"sensor_id":"{sensor}","timestamp":"{now}"}}', None, after, None, str(n), n)


def _connect(failures: list[int], category: str) -> None:
    """Connects by the policy of five attempts; the first ``failures`` attempts fail, as a server that starts up would."""

    def attempt() -> None:
        if failures[0] > 0:
            failures[0] -= 1
            raise SourceError(category, "the source is not ready")

    retry_with_backoff(attempt)


class GeneratorReader(DataSourceReader):
    def __init__(self, options: dict, row=_row, category: str = "Connection"):
        self.start, self.count, self.parts = start_after(options.get("offset")), int(options.get("count", 100)), int(options.get("partitions", 4))
        self.row, self.category, self.failures = row, category, int(options.get("failures", 0))

    def partitions(self) -> list[InputPartition]:
        step = max(1, -(-self.count // self.parts))
        return [_Range(self.start + 1 + i, min(self.start + self.count, self.start + i + step)) for i in range(0, self.count, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        _connect([self.failures], self.category)
        yield from map(self.row, range(partition.first, partition.last + 1))


class GeneratorStreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict, row=_row):
        self.row = row
        self.start, self.batch, self.limit = start_after(options.get("offset")), int(options.get("batch", 10)), int(options.get("count", 100))

    def initialOffset(self) -> dict:
        return {"n": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(start["n"] + self.batch, self.start + self.limit)
        return map(self.row, range(start["n"] + 1, end + 1)), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return map(self.row, range(start["n"] + 1, end["n"] + 1))


class TransactionalSource(DataSource):
    """``spark.read.format("rillforge_users")`` and its stream; options offset, count, partitions, batch."""

    @classmethod
    def name(cls) -> str:
        return "rillforge_users"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GeneratorReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return GeneratorStreamReader(self.options)


class CommitLogSource(TransactionalSource):
    """``spark.read.format("rillforge_sensors")`` and its stream, with the same options."""

    @classmethod
    def name(cls) -> str:
        return "rillforge_sensors"

    def reader(self, schema) -> DataSourceReader:
        return GeneratorReader(self.options, _reading, "DirectoryAccess")

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return GeneratorStreamReader(self.options, _reading)


def register(spark: SparkSession) -> None:
    for source in (TransactionalSource, CommitLogSource):
        spark.dataSource.register(source)


def resumed(spark: SparkSession, store, source: str, format: str, count: int) -> DataFrame:
    """``count`` events of a generated source after the offset that ``store`` has of it, from the start if it has none."""
    register(spark)
    return spark.read.format(format).option("count", count).option("offset", store.get_offset(source) or "0").load()


__all__ = ["COLUMNS", "CommitLogSource", "register", "resumed", "SourceError", "TransactionalSource", "commit_log", "numbers", "resume_position", "retry_with_backoff", "start_after", "transactional"]
