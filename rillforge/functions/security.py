"""Field masking, hashing and encryption with rotating keys."""

from __future__ import annotations

import hashlib
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MaskingRule(Enum):
    REDACT = "redact"
    HASH = "hash"
    ENCRYPT = "encrypt"


class KeyStore:
    """Versions count from 1; old versions stay readable."""

    def __init__(self, first: bytes):
        self._keys = {1: first}
        self.version = 1

    def active(self) -> tuple[int, bytes]:
        return self.version, self._keys[self.version]

    def by_version(self, version: int) -> bytes | None:
        return self._keys.get(version)

    def rotate(self, key: bytes) -> int:
        self.version += 1
        self._keys[self.version] = key
        return self.version


def djb2(text: Column) -> Column:
    """16 hex digits of h = h * 33 + byte from 5381, modulo 2 ** 64; decimals, as ANSI mode forbids overflow."""
    raw = text.cast("binary")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("decimal(20,0)")
    step = lambda h, i: F.pmod(h.cast("decimal(22,0)") * F.lit(33).cast("decimal(3,0)") + byte(i), F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw))).otherwise(F.array().cast("array<int>"))
    return F.lower(F.lpad(F.conv(F.aggregate(places, F.lit(5381).cast("decimal(20,0)"), step).cast("string"), 10, 16), 16, "0"))


KEYS = "__keys"


def with_keys(df: DataFrame, keys: KeyStore) -> DataFrame:
    """``df`` with the column ``KEYS``: a map from version to key. Keys are data of a one-row table, no literals, so plans, UI and event logs don't show them."""
    held = {v: hashlib.sha256(keys.by_version(v)).digest() for v in range(1, keys.version + 1)}
    one = df.sparkSession.createDataFrame([(1, held)], f"__one int, {KEYS} map<int,binary>")
    # one row of a key for each version, so it may be broadcast
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one", "left").drop("__one")


def encrypt(text: Column, version: int) -> Column:
    """ENC:v{version}:{base64 of AES-GCM}, in a frame ``with_keys``; the key never enters the result."""
    return F.concat(F.lit(f"ENC:v{version}:"), F.base64(F.aes_encrypt(text, F.col(KEYS)[version], F.lit("GCM"))))


def decrypt(text: Column) -> Column:
    """What ``encrypt`` made, by the key of its version, in a frame ``with_keys``; null for an unknown version."""
    parts = F.split(text, ":", 3)
    key = F.try_element_at(F.col(KEYS), F.substring(parts[1], 2, 10).try_cast("int"))
    return F.when(key.isNotNull(), F.aes_decrypt(F.unbase64(parts[2]), key, F.lit("GCM")).cast("string"))


def encrypt_column(df: DataFrame, name: str, keys: KeyStore) -> DataFrame:
    return with_keys(df, keys).withColumn(name, encrypt(F.col(name), keys.version)).drop(KEYS)


def decrypt_column(df: DataFrame, name: str, keys: KeyStore) -> DataFrame:
    return with_keys(df, keys).withColumn(name, decrypt(F.col(name))).drop(KEYS)


def mask(json: Column, rules: dict[str, MaskingRule], keys: KeyStore | None = None, compat: bool = False) -> Column:
    """In a frame ``with_keys`` if keys are given. Top-level fields of a JSON object masked by rule; text without such a field stays as it is.

    Encryption without a key store is an error, unless ``compat``: then strings become a fixed text
    and other values stay.
    """
    if keys is None and not compat and MaskingRule.ENCRYPT in rules.values():
        raise ValueError("encryption needs a key store")
    fields = F.try_parse_json(json).try_cast("map<string,variant>")

    def value(k: Column, x: Column) -> Column:
        is_text = F.schema_of_variant(x) == "STRING"
        text = F.try_variant_get(x, "$", "string")
        out = x
        for name, rule in rules.items():
            if rule is MaskingRule.REDACT:
                new = F.lit("[REDACTED]").cast("variant")
            elif rule is MaskingRule.HASH:
                new = F.when(is_text, djb2(text).cast("variant")).otherwise(x)
            elif keys is not None:
                new = encrypt(F.to_json(x), keys.version).cast("variant")
            else:
                new = F.when(is_text, F.lit("[ENCRYPTED_WITHOUT_KMS]").cast("variant")).otherwise(x)
            out = F.when(k == name, new).otherwise(out)
        return out

    touched = F.arrays_overlap(F.map_keys(fields), F.array(*[F.lit(x) for x in sorted(rules)])) if rules else F.lit(False)
    return F.when(F.coalesce(touched, F.lit(False)), F.to_json(F.transform_values(fields, value))).otherwise(json)


def apply_rules(df: DataFrame, rules: dict[str, MaskingRule], keys: KeyStore | None = None, compat: bool = False) -> DataFrame:
    """before and after masked; keys of events aren't."""
    masked = {c: mask(F.col(c), rules, keys, compat) for c in ("before", "after")}
    return with_keys(df, keys).withColumns(masked).drop(KEYS) if keys is not None else df.withColumns(masked)
