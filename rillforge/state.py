"""Offsets and schemas in a folder of Parquet tables, and schema compatibility."""

from __future__ import annotations

import json
from enum import Enum

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SchemaCompatibility(Enum):
    NONE = "None"
    BACKWARD = "Backward"
    FORWARD = "Forward"
    FULL = "Full"


class IncompatibleSchema(Exception):
    pass


def check_compatibility(old: dict, new: dict, mode: SchemaCompatibility) -> str | None:
    """Why the new schema is refused, or None. Shared fields keep their type in every mode but NONE."""
    if mode is SchemaCompatibility.NONE:
        return None
    a, b = old.get("fields"), new.get("fields")
    if not isinstance(a, dict) or not isinstance(b, dict):
        return "Incompatibility: schema has no 'fields' object"
    for name in sorted(a.keys() & b.keys()):
        if a[name] != b[name]:
            return f"Incompatibility: field '{name}' changed from {a[name]} to {b[name]}"
    if mode in (SchemaCompatibility.BACKWARD, SchemaCompatibility.FULL) and (gone := sorted(a.keys() - b.keys())):
        return f"Incompatibility: field '{gone[0]}' was deleted"
    if mode in (SchemaCompatibility.FORWARD, SchemaCompatibility.FULL) and (new_ := sorted(b.keys() - a.keys())):
        return f"Incompatibility: field '{new_[0]}' was added"
    return None


class StateStore:
    """Key-value state: an append-only log of (kind, name, version, value); the last version counts.

    One writer at a time, as the leader is; of two that meet, the greater value of a version counts.
    """

    SCHEMA = "kind string, name string, version long, value string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # any other failure is no empty state
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def latest(self) -> DataFrame:
        return self.table().groupBy("kind", "name").agg(F.max("version").alias("version"), F.max(F.struct("version", "value"))["value"].alias("value"))

    def _put(self, kind: str, name: str, value: str) -> int:
        last = self.table().where((F.col("kind") == kind) & (F.col("name") == name)).agg(F.max("version")).first()[0]
        version = (last or 0) + 1
        self.spark.createDataFrame([(kind, name, version, value)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return version

    def _get(self, kind: str, name: str) -> str | None:
        row = self.latest().where((F.col("kind") == kind) & (F.col("name") == name)).first()
        return row.value if row else None

    def save_offset(self, source: str, offset: str) -> None:
        self._put("offset", source, offset)

    def get_offset(self, source: str) -> str | None:
        return self._get("offset", source)

    def save_schema(self, source: str, schema: dict) -> int:
        return self._put("schema", source, json.dumps(schema, sort_keys=True))

    def get_schema(self, source: str) -> dict | None:
        text = self._get("schema", source)
        return json.loads(text) if text is not None else None

    def register_schema(self, source: str, schema: dict, mode: SchemaCompatibility = SchemaCompatibility.NONE) -> int:
        """Check against the schema in force, then store as its next version; the first isn't checked."""
        old = self.get_schema(source)
        if old is not None and (why := check_compatibility(old, schema, mode)):
            raise IncompatibleSchema(why)
        return self.save_schema(source, schema)

    def save_progress(self, table: str, done: int, total: int) -> None:
        self.save_offset(f"{table}_snapshot_progress", f"{done}/{total}")


def latest_offsets(df: DataFrame, source: str = "source_database") -> DataFrame:
    return df.groupBy(source).agg(F.max_by("offset", "seq").alias("offset"))
