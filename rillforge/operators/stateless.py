"""Filters, validation, routing and row transforms: expressions only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..envelope import COLUMNS, serialize

MARKER_TABLE = "cdc_watermarks"
PREFIX = "Validation failed: "


class PartitionStrategy(Enum):
    KEY_HASH = "key"
    TENANT_PREFIX = "tenant"
    ROUND_ROBIN = "id"


def drop_markers(df: DataFrame, marker: str = MARKER_TABLE) -> DataFrame:
    return df.where(~F.col("source_table_or_collection").eqNullSafe(F.lit(marker)))


def should_forward(local: str) -> Column:
    """False for what came from ``local`` itself; the test is a plain prefix, so it also holds for longer names."""
    return ~F.coalesce(F.startswith("transaction_id", F.lit(f"remote-{local}")), F.lit(False))


def _type(variant: Column, field: str) -> Column:
    """Spark's type of a field, VOID for JSON null, SQL null where it is missing."""
    escaped = field.replace("\\", "\\\\").replace("'", "\\'")
    return F.schema_of_variant(F.try_variant_get(variant, f"$['{escaped}']", "variant"))


def validation_error(schema: dict | None, operation: Column, after: Column, parsed: Column | None = None) -> Column:
    """Null if the event is valid, else the first failure in order of field names.

    parsed: ``try_parse_json(after)`` as a column of its own, so that it is parsed once.
    """
    none = F.lit(None).cast("string")
    if schema is None:
        return none
    fields = schema.get("fields")
    if not isinstance(fields, dict):
        return F.lit(PREFIX + "Schema has no 'fields' object")
    v = parsed if parsed is not None else F.try_parse_json(after)
    checks = [
        F.when(after.isNull(), PREFIX + "Event payload 'after' is missing"),
        F.when(~F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)), PREFIX + "Event payload is not a JSON object"),
    ]
    for name in sorted(fields):
        wanted = fields[name]
        if not isinstance(wanted, str):
            checks.append(F.lit(f"{PREFIX}Schema type of '{name}' is not a string"))
            continue
        kind = _type(v, name)
        numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE)")
        path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        good = {
            "integer": numeric & (F.try_variant_get(v, path, "double") % 1 == 0), "float": numeric, "string": kind == "STRING", "boolean": kind == "BOOLEAN",
        }.get(wanted)
        checks.append(F.when(kind.isNull(), f"{PREFIX}Missing required field '{name}'"))
        if good is None:
            checks.append(F.lit(f"{PREFIX}Unsupported schema type: {wanted}"))
        else:
            found = F.to_json(F.try_variant_get(v, path, "variant"))
            checks.append(F.when(~F.coalesce(good, F.lit(False)), F.concat(F.lit(f"{PREFIX}Field '{name}' expected {wanted}, found "), F.coalesce(found, F.lit("null")))))
    return F.when(operation.isin("Create", "Update"), F.coalesce(*checks))


def validate(df: DataFrame, schema: dict | None) -> DataFrame:
    """Adds error_reason; the payload is parsed once for all fields."""
    return df.withColumn("__parsed", F.try_parse_json("after")).withColumn("error_reason", validation_error(schema, F.col("operation"), F.col("after"), F.col("__parsed"))).drop("__parsed")


def bucket_of(text: Column, n: int, fast: bool = False) -> Column:
    """A partition in [0, n): the first 32 bits of the MD5, or xxhash64."""
    if n <= 1:
        return F.lit(0).cast("long")
    if fast:
        return F.pmod(F.xxhash64(text), F.lit(n))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(n)


def tenant() -> Column:
    """after.tenant_id if it is a JSON string, else the source database."""
    v = F.try_parse_json("after")
    return F.when(_type(v, "tenant_id") == "STRING", F.try_variant_get(v, "$.tenant_id", "string")).otherwise(F.col("source_database"))


def route(df: DataFrame, n: int, strategy: PartitionStrategy = PartitionStrategy.KEY_HASH, fast: bool = False) -> DataFrame:
    text = {PartitionStrategy.KEY_HASH: F.col("key"), PartitionStrategy.TENANT_PREFIX: tenant(), PartitionStrategy.ROUND_ROBIN: F.col("id")}[strategy]
    return df.withColumn("partition", bucket_of(F.coalesce(text, F.lit("")), n, fast))


Transform = Callable[[DataFrame], DataFrame]


def passthrough(max_bytes: int | None = None) -> Transform:
    """Identity; envelopes longer than ``max_bytes`` fail."""

    def run(df: DataFrame) -> DataFrame:
        if max_bytes is None:
            return df.withColumn("error_reason", F.lit(None).cast("string"))
        return serialize(df, "__j").withColumn("error_reason", F.when(F.octet_length("__j") > max_bytes, F.lit("MemoryAccess: envelope is too long"))).drop("__j")

    return run


def replace_text(old: str, new: str) -> Transform:
    """Every occurrence in the serialized envelope, so in any field's text."""

    def run(df: DataFrame) -> DataFrame:
        swap = lambda c: F.replace(F.col(c), F.lit(old), F.lit(new)).alias(c)
        kept = [swap(c) if c not in ("timestamp", "seq") and c in COLUMNS else F.col(c) for c in df.columns]
        return df.select(*kept, F.lit(None).cast("string").alias("error_reason"))

    return run


def envelope_function(function: Callable[[bytes], bytes]) -> Transform:
    """A function from envelope JSON to envelope JSON, run in Arrow batches; an exception fails its row only."""

    @F.arrow_udf("payload string, error string")
    def call(texts: pa.Array) -> pa.Array:
        payloads, errors = [], []
        for text in texts.to_pylist():
            try:
                payloads.append(function(text.encode()).decode())
                errors.append(None)
            except Exception as e:
                payloads.append(None)
                errors.append(f"Transform: {type(e).__name__}: {e}")
        return pa.StructArray.from_arrays([pa.array(payloads, pa.string()), pa.array(errors, pa.string())], names=["payload", "error"])

    def run(df: DataFrame) -> DataFrame:
        out = serialize(df, "__json").withColumn("__out", call("__json")).withColumn("__v", F.try_parse_json("__out.payload"))
        get = lambda c: F.try_variant_get("__v", f"$.{c}", "string")
        nested = lambda c: F.to_json(F.try_variant_get("__v", f"$.{c}", "variant"))
        bad = F.when(F.col("__out.error").isNull() & F.col("__v").isNull(), F.lit("Serialization: output is not JSON")).otherwise(F.col("__out.error"))
        done = [
            F.when(bad.isNull(), F.nullif(nested(c), F.lit("null")) if c in ("key", "before", "after") else get(c)).otherwise(F.col(c)).alias(c) if c in COLUMNS and c not in ("timestamp", "seq") else F.col(c)
            for c in df.columns
        ]
        return out.select(*done, bad.alias("error_reason"))

    return run


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without error_reason, without that column, and rows with one."""
    return df.where("error_reason is null").drop("error_reason"), df.where("error_reason is not null")


__all__ = ["Iterator", "PartitionStrategy"]
