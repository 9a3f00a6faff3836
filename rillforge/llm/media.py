"""Media columns stored as content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has ``2 ** -AVERAGE_BITS`` odds,
within bounds of length. A chunk is known by the SHA-256 of its bytes; Spark joins on the digest
leave one stored copy (zstd) of each. The stored form of a payload is the ordered list of its
chunks' digests and stored lengths, followed by the chunks. Reading back joins each list to the
chunk store, expands the chunks in order, checks each against its digest and the whole against
the payload's own digest, and computes features from the bytes so read.

Chunks are compressed with a dictionary learned from a sample of texts. It is a chunk of the store itself,
and every stored form names it by its digest, so media can be read with the store alone. Tables with other
texts have another dictionary, hence other stored forms of an equal text.

Exact copies share one list, so a payload is read back once however many rows have it. Chunk bytes
are moved twice, compressed: to the store by digest and to the reader by payload. A chunk that very
many lists share is *common*: the lists meet it in ``PARTS`` parts, each with a copy of it, not in one task.

Defined results: null text is the empty payload before padding; repeated rows give repeated
results; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Query, small_batches, table, uniform

UNIT = 576
PAD = 255
#: Bytes at a payload's end that tail_crc32 is of.
TAIL = 32
MIN_CHUNK, AVERAGE_BITS, MAX_CHUNK = 2048, 13, 32768
WINDOW = 32
LEVEL = 9
#: Documents and characters of each that the compression dictionary may learn from.
DICTIONARY_DOCUMENTS, DICTIONARY_CHARS, DICTIONARY_BYTES = 600, 20_000, 1 << 16
MAGIC = b"CDCM2"
#: Lists of one task that may hold a chunk before it counts as common there, and the parts that common chunks are joined in.
COMMON, PARTS = 64, 256
GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), np.uint32)


def payload_of(text: str | None, unit: int = UNIT) -> bytes:
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def chunks_of(payload: bytes) -> list[bytes]:
    """Cut a payload; the chunks joined are the payload. No chunk for no bytes."""
    n = len(payload)
    if n <= MIN_CHUNK:
        return [payload] if n else []
    h = GEAR[np.frombuffer(payload, np.uint8)]
    width = 1
    while width < WINDOW:  # sums over 2 * width bytes from sums over width bytes
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    ends = np.flatnonzero(h >> np.uint32(32 - AVERAGE_BITS) == 0) + 1
    out, start = [], 0
    while start < n:
        k = np.searchsorted(ends, start + MIN_CHUNK)
        end = min(n, start + MAX_CHUNK, int(ends[k]) if k < len(ends) else n)
        out.append(payload[start:end])
        start = end
    return out


def features_of(payload: bytes) -> str:
    """Sample count, mean, deviation and entropy of the bytes."""
    x = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = x / max(1, x.sum())
    at = np.arange(256)
    mean = float((p * at).sum())
    deviation = float(np.sqrt(max(0.0, (p * (at - mean) ** 2).sum())))
    bits = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"n={len(payload)};mean={mean:.3f};std={deviation:.3f};bits={bits:.4f}"


def _compressor(words: bytes | None) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(words) if words else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True, write_dict_id=False)


def _decompressor(words: bytes | None) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()


def learn_dictionary(docs: DataFrame) -> bytes | None:
    """A compression dictionary from a bounded sample of texts; None if there are too few."""
    n = docs.count()
    if n == 0:
        return None
    rows = (
        docs.where(F.col("text").isNotNull() & (F.length("text") <= DICTIONARY_CHARS) & (uniform(F.lit("zstd"), F.col("doc_id"), F.col("text")) < DICTIONARY_DOCUMENTS / n))
        .select("text").distinct().collect()
    )
    samples = sorted({chunk for r in rows for chunk in chunks_of(payload_of(r.text))})
    if len(samples) < 64:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return None


_REFS = pa.schema([("key", pa.binary()), ("seq", pa.int32()), ("n_chunks", pa.int32()), ("digest", pa.binary()), ("common", pa.bool_())])
_STORE = pa.schema([("digest", pa.binary()), ("stored", pa.binary())])
_READ = pa.schema([
    ("key", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
    ("media_sha256", pa.binary()), ("feature", pa.string()), ("n_chunks", pa.int32()), ("verified", pa.bool_()),
])


def _lists(common: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        met: Counter[bytes] = Counter()
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0).to_pylist():
                payload = payload_of(text)
                key = hashlib.sha256(payload).digest()
                if key not in seen:
                    seen.add(key)
                    parts = chunks_of(payload)
                    for i, x in enumerate(parts):
                        digest = hashlib.sha256(x).digest()
                        met[digest] += 1
                        rows.append((key, i, len(parts), digest, met[digest] > common))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_REFS), _REFS, strict=True)], schema=_REFS)

    return lists


def _chunks(words: bytes | None):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, seen = _compressor(words).compress, set()
        for batch in batches:
            digests, stored = [], []
            for text in batch.column(0).to_pylist():
                for x in chunks_of(payload_of(text)):
                    digest = hashlib.sha256(x).digest()
                    if digest not in seen:
                        seen.add(digest)
                        digests.append(digest)
                        stored.append(compress(x))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(stored, pa.binary())], schema=_STORE)

    return chunks


def _reader(words: bytes | None):
    """Rows (key, seq, digest, stored) sorted by key and seq to one row for each key."""

    named = hashlib.sha256(words).digest() if words else bytes(32)

    def finish(key: bytes, digests: list[bytes], stored: list[bytes], expand) -> tuple:
        parts = [expand(x) for x in stored]
        payload = b"".join(parts)
        whole = hashlib.sha256(payload)
        ok = whole.digest() == key and all(hashlib.sha256(x).digest() == d for x, d in zip(parts, digests, strict=True))
        head = MAGIC + named + len(stored).to_bytes(4, "big") + b"".join(d + len(x).to_bytes(4, "big") for d, x in zip(digests, stored, strict=True))
        media = hashlib.sha256(head)
        for x in stored:
            media.update(x)
        return (key, len(payload), whole.digest(), zlib.crc32(payload[-TAIL:]), len(head) + sum(map(len, stored)), media.digest(), features_of(payload), len(stored), ok)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = _decompressor(words).decompress
        now, digests, stored = None, [], []
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_READ), _READ, strict=True)], schema=_READ)
        for batch in batches:
            rows = []
            for key, digest, chunk in zip(batch.column("key").to_pylist(), batch.column("digest").to_pylist(), batch.column("stored").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        rows.append(finish(now, digests, stored, expand))
                    now, digests, stored = key, [], []
                digests.append(digest)
                stored.append(chunk)
            yield pack(rows)
        if now is not None:
            yield pack([finish(now, digests, stored, expand)])

    return read


def payload_bytes(text: Column) -> Column:
    n = F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
    return F.greatest(F.ceil(n / F.lit(UNIT)), F.lit(1)) * UNIT


def payload_key(text: Column) -> Column:
    """SHA-256 of the padded payload."""
    raw = F.coalesce(text, F.lit(""))
    pad = (payload_bytes(text) - F.octet_length(raw)).cast("int")
    return F.unhex(F.sha2(F.concat(raw.cast("binary"), F.unhex(F.repeat(F.lit(f"{PAD:02X}"), pad))), 256))


def chunk_lists(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """key, seq, n_chunks, digest, common: the ordered chunk list of each distinct payload, and whether a task met the chunk in many before."""
    found = docs.select("text").mapInArrow(_lists(common), "key binary, seq int, n_chunks int, digest binary, common boolean")
    return found.groupBy("key", "seq").agg(F.min("n_chunks").alias("n_chunks"), F.min("digest").alias("digest"), F.max("common").alias("common"))


def chunk_store(docs: DataFrame, words: bytes | None = None) -> DataFrame:
    """digest, stored: one compressed copy of each distinct chunk, and the dictionary as it is."""
    found = docs.select("text").mapInArrow(_chunks(words), "digest binary, stored binary")
    if words:  # before the shuffle by digest, which a union above it would have to be repeated for
        found = found.unionByName(docs.sparkSession.createDataFrame([(hashlib.sha256(words).digest(), words)], "digest binary, stored binary"))
    return found.dropDuplicates(["digest"])


def read_back(lists: DataFrame, store: DataFrame, words: bytes | None = None) -> DataFrame:
    """Verified payload digests and features of each key, from the stored chunks alone."""
    rare = lists.where("not common").join(store, "digest").select("key", "seq", "digest", "stored")
    # of key and digest: a part of the key alone lets the join's filter sink below the lists' exchange, which then isn't reused
    shared = lists.where("common").select("key", "seq", "digest", F.pmod(F.xxhash64("key", "digest"), F.lit(PARTS)).alias("part"))
    copies = store.join(shared.select("digest", "part").distinct(), "digest")
    joined = rare.unionByName(shared.join(copies, ["digest", "part"]).select("key", "seq", "digest", "stored"))
    types = "key binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string, n_chunks int, verified boolean"
    return joined.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(_reader(words), types)


def store_and_read(docs: DataFrame, common: int = COMMON) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    words = learn_dictionary(docs)
    read = read_back(chunk_lists(docs, common), chunk_store(docs, words), words)
    keys = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), payload_key(F.col("text")).alias("key"))
    hexed = {c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")}
    return keys.join(read, "key", "left").drop("key").withColumns(hexed)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store_and_read(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks", "verified")


QUERIES: dict[str, Query] = {"op9_media_columns": op9_media_columns}
