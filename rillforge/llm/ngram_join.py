"""Similarity self-join of documents by their word 5-grams: Jaccard of 0.8 or more, chosen-path join.

1. Every text becomes its set of hashed 5-word shingles (a shorter text with words is one shingle).
   Texts with equal sets are one *set*; all that follows works on distinct sets.
2. Chosen paths: in each of several independent runs a set chooses the shingles whose hash is below
   a threshold in proportion to 1 / size, so that two sets at the limit are expected to choose
   ``SHARED`` shingles in common, and goes into the bucket of each. A bucket of at most ``LIMIT`` sets
   is brute-forced. A larger one first compares its members with a few pivots: members close to a pivot
   are joined to it and leave (whatever is within the limit of such a member is joined to the same
   pivot); the others go down into sub-buckets, by shingles chosen anew for the path from a reserve
   sample. What is still large at the last level is brute-forced in pairs of blocks. The number of
   runs follows from the target recall.
   Buckets compare sketches (one-permutation minhash) with a margin and give spanning edges only, so
   their components are candidate groups: a pair within the limit is in one group, but for the recall.
3. Exact check. A group of one block compares all pairs by their whole sets. A larger one has a *core*,
   the shingles that more than half of its sets have, and each set is kept as its difference from the
   core. With a the core's shingles that a set lacks, b those that it adds, and c what the differences of
   two sets share, the sets are within the limit t exactly if the sum of their a + t b is at most
   (1 - t) |core| + (1 + t) c. So sets whose a + t b is at most half of (1 - t) |core| are *settled*: all
   are within the limit of each other, and their links are one sum. Pairs with a set that is not are
   compared by their differences, in pairs of blocks. This gives each set's links, copies counted, and
   the exact classes.

No step emits the pairs of a group, and none collects groups, edges or labels on the driver.

Result: one row per document with ``class_id`` (the least doc_id of its connected class) and
``n_links`` (the other documents with Jaccard 0.8 or more to it, equal sets among them).

Defined results: null texts and texts without a word link to nothing and are classes of their own,
with class_id = doc_id; rows repeated with the same id are documents of their own; in a class whose
ids are all null, class_id is null. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Query, checkpointed, small_batches, table
from .components import UnionFind, connected_components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Shingles that two sets at the limit are expected to choose in common, in a run and at a deeper level.
SHARED, SHARED_BELOW = 3.0, 1.8
LIMIT = 200
LEVELS = 3
RESERVE = 32
PIVOTS = 16
BINS = 128
#: Sketch estimates: an edge in a small bucket, an edge to a pivot, close enough to a pivot to leave.
EDGE, PIVOT_EDGE, LEAVES = 0.62, 0.3, 0.7
#: Sets of a group that are compared in one block, and about as many shingles (8 bytes each) as they have.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Members of a bucket whose sketches are compared in one block.
SKETCH_BLOCK = 2048
#: Rows that one task compares with pivots; each task's edges are a forest of its own.
PIVOT_ROWS = 25_000
#: Ids of sets (8 bytes each) that may be broadcast.
BROADCAST_SETS = 4_000_000

_BASE, _ODD = 0x9E3779B97F4A7C15, [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of uint64 that scatters its input."""
    x = (x ^ np.uint64((seed * 0x9FB21C651E98DF25 + 0x2545F4914F6CDD1D) % (1 << 64))) * np.uint64(_ODD[0])
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD[1])
    return x ^ (x >> np.uint64(29))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty if it has no word."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    solid = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _tables(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_ODD[4]))
    k = min(words, len(word))
    out = np.full(len(word) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(_ODD[2]) + word[i : len(word) - k + 1 + i]
    return np.unique(mix(out, 1))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def sketch(hashes: np.ndarray) -> bytes:
    """A byte for each of ``BINS`` ranges of hashes: the least hash in it, cut to 1..255; 0 for none."""
    first = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    low = hashes[np.minimum(first, len(hashes) - 1)]
    there = (first < len(hashes)) & (low >> np.uint64(57) == np.arange(BINS, dtype=np.uint64))
    return np.where(there, mix(low, 2) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard of sketches (..., BINS)."""
    equal = ((a == b) & (a != 0)).sum(axis=-1)
    return equal / np.maximum(1, ((a != 0) | (b != 0)).sum(axis=-1))


def runs_needed(recall: float = RECALL, shared: float = SHARED, below: float = SHARED_BELOW, levels: int = LEVELS) -> int:
    """Runs until a pair at the limit is missed with odds of at most 1 - recall, at the deepest level."""
    found = 1.0
    for _ in range(levels - 1):
        found = 1 - math.exp(-below * found)
    return max(1, math.ceil(math.log(1 - recall) / (-shared * found)))


def _below(h: np.ndarray, expected: float) -> np.ndarray:
    """Which hashes of a set are below expected / size."""
    share = expected / len(h)
    return np.ones(len(h), bool) if share >= 1 else h < np.uint64(int(share * 2**64))


def chosen(hashes: np.ndarray, runs: int, shared: float = SHARED, threshold: float = THRESHOLD) -> np.ndarray:
    """Buckets of a set at the first level, all runs together."""
    parts = []
    for run in range(runs):
        h = mix(hashes, 10 + run)
        parts.append(h[_below(h, shared / threshold)])
    return np.unique(np.concatenate(parts)).view(np.int64)


def reserve(hashes: np.ndarray) -> np.ndarray:
    """The sample that the deeper levels choose from."""
    h = mix(hashes, 3)
    return h[_below(h, RESERVE)].view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker holds few rows as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_SETS = pa.schema([
    ("doc_id", pa.int64()), ("set_id", pa.int64()), ("size", pa.int64()), ("buckets", pa.list_(pa.int64())), ("reserve", pa.list_(pa.int64())), ("sketch", pa.binary()),
])
_SETS_SQL = "doc_id long, set_id long, size long, buckets array<long>, reserve array<long>, sketch binary"


def _to_sets(runs: int) -> Callable:
    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = shingles(text)
                if not len(h):
                    rows.append((doc_id, None, 0, None, None, None))
                    continue
                key = set_id(h)
                if key in seen:  # the set's data travel once from each task
                    rows.append((doc_id, key, len(h), None, None, None))
                else:
                    seen.add(key)
                    rows.append((doc_id, key, len(h), chosen(h, runs), reserve(h), sketch(h)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _SETS, strict=True)], schema=_SETS)

    return to_sets


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*edges, strict=True) if edges else [[], []])], schema=_EDGES)


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows sorted by key, one table for each value, also where a value spans batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch])
        values = list(zip(*(whole[k].to_pylist() for k in key), strict=True))
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                part = whole.slice(start, i - start)
                if held and values[start] == last:
                    held.append(part)
                else:
                    if held:
                        yield pa.concat_tables(held)
                    held, last = [part], values[start]
                start = i
    if held:
        yield pa.concat_tables(held)


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _spanning(ids: list[int], near: Callable[[int], np.ndarray], union: UnionFind) -> list[tuple[int, int]]:
    """Edges of a forest over the pairs (i, j), j < i, that near(i) marks."""
    out = []
    for i in range(1, len(ids)):
        for j in np.flatnonzero(near(i)):
            if union.join(ids[i], ids[int(j)]):
                out.append((ids[i], ids[int(j)]))
    return out


def _small_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of each bucket; rows (bucket, set_id, sketch) come sorted by bucket."""
    union, edges = UnionFind(), []  # what earlier buckets of the task have joined need not be joined again
    for group in _groups(batches, ("bucket",)):
        ids = group["set_id"].to_pylist()
        roots = {union.find(x) for x in ids}
        if len(roots) > 1:
            s = _sketches(group["sketch"])
            edges += _spanning(ids, lambda i, s=s: similarity(s[:i], s[i]) >= EDGE, union)
        if len(edges) > 20_000:
            yield _edge_batch(edges)
            edges = []
    yield _edge_batch(edges)


def _pivot_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, set_id, sketch, pivots): edges to pivots, and whether the set leaves the bucket."""
    union = UnionFind()
    for batch in _slices(batches):
        u, v, bucket, stays = [], [], [], []
        for b, x, s, pivots in zip(*(batch.column(c).to_pylist() for c in ("bucket", "set_id", "sketch", "pivots")), strict=True):
            leaves = False
            if pivots:
                e = similarity(np.frombuffer(b"".join(p["sketch"] for p in pivots), np.uint8).reshape(-1, BINS), np.frombuffer(s, np.uint8))
                leaves = bool((e >= LEAVES).any())
                for k in np.flatnonzero(e >= PIVOT_EDGE):
                    if union.join(x, pivots[int(k)]["set_id"]):
                        u.append(x)
                        v.append(pivots[int(k)]["set_id"])
                        bucket.append(None)
                        stays.append(False)
            if not leaves:
                u.append(x)
                v.append(None)
                bucket.append(b)
                stays.append(True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(bucket, pa.int64()), pa.array(stays, pa.bool_())], names=["u", "v", "bucket", "stays"])


def _deeper(level: int, shared: float, threshold: float):
    """The sub-buckets that a set chooses from its reserve, anew for each path."""

    @F.arrow_udf("array<long>")
    def paths(buckets: pa.Array, reserves: pa.Array) -> pa.Array:
        out = []
        for b, r in zip(buckets.to_pylist(), reserves.to_pylist(), strict=True):
            tokens = np.array(r, np.int64).view(np.uint64)
            h = mix(tokens ^ np.uint64(b % (1 << 64)), 40 + level)
            out.append(h[_below(h, shared / threshold)].view(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return paths


def _block_pairs(rows: DataFrame, blocks: Column, settled: Column | None = None, settled_blocks: Column | None = None) -> DataFrame:
    """Deal the rows of each group into blocks and each block to the pairs of blocks it is part of.

    Adds pair_a, pair_b (block numbers, a <= b) and side (0: block a, 1: block b). A group of one
    block has the one pair (0, 0). Settled rows have the first ``settled_blocks`` blocks, the others
    ``blocks`` more; pairs of two blocks of settled rows are left out.
    """
    low, lows = (F.lit(False), F.lit(0)) if settled is None else (settled, settled_blocks)
    of = F.greatest(F.when(F.col("__low"), F.col("__s")).otherwise(F.col("__k")), F.lit(1))
    dealt = rows.withColumns({"__k": blocks.cast("int"), "__s": lows.cast("int"), "__low": low}).where("__k > 0")
    dealt = dealt.withColumn("__b", F.when(F.col("__low"), 0).otherwise(F.col("__s")) + F.pmod(F.xxhash64("set_id", F.lit("block")), of.cast("long")).cast("int"))
    spread = dealt.withColumn("__o", F.explode(F.sequence(F.when(F.col("__low"), F.col("__s")).otherwise(0), F.col("__s") + F.col("__k") - 1)))
    return spread.select(
        *rows.columns, F.least("__b", "__o").alias("pair_a"), F.greatest("__b", "__o").alias("pair_b"), F.when(F.col("__b") <= F.col("__o"), 0).otherwise(1).alias("side")
    )


def _blocks_by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches, ("bucket", "pair_a", "pair_b")):
        ids, side, s, union = group["set_id"].to_pylist(), np.array(group["side"].to_pylist()), _sketches(group["sketch"]), UnionFind()
        own = group["pair_a"][0].as_py() == group["pair_b"][0].as_py()
        yield _edge_batch(_spanning(ids, lambda i: (similarity(s[:i], s[i]) >= EDGE) & (own | (side[:i] != side[i])), union))  # noqa: B023


def candidate_edges(sets: DataFrame, below: float = SHARED_BELOW, threshold: float = THRESHOLD, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """Edges (u, v) whose components hold every pair within the limit, but for the recall."""
    slim = sets.select("set_id", "sketch")
    members = sets.select("set_id", F.explode("buckets").alias("bucket"))
    found: list[DataFrame] = []
    for level in range(1, levels + 1):
        sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        members = checkpointed(members.join(sizes, "bucket"))
        small = members.where(F.col("n") <= limit).join(slim, "set_id").select("bucket", "set_id", "sketch")
        found.append(checkpointed(small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_small_buckets, "u long, v long").distinct()))
        hot = members.where(F.col("n") > limit)
        if not (n_hot := hot.count()):
            break
        hot = checkpointed(hot.join(slim, "set_id"))
        draw = F.pmod(F.xxhash64("set_id", "bucket"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        pivots = hot.where(draw < F.lit(float(PIVOTS)) / F.col("n")).groupBy("bucket").agg(F.collect_list(F.struct("set_id", "sketch")).alias("pivots"))
        step = checkpointed(hot.select("bucket", "set_id", "sketch").join(pivots, "bucket", "left").coalesce(-(-n_hot // PIVOT_ROWS)).mapInArrow(_pivot_step, "u long, v long, bucket long, stays boolean"))
        found.append(step.where("not stays").select("u", "v").distinct())
        stay = step.where("stays").select(F.col("u").alias("set_id"), "bucket")
        if level < levels:
            deeper = _deeper(level, below, threshold)
            members = stay.join(sets.select("set_id", "reserve"), "set_id").select("set_id", F.explode(deeper("bucket", "reserve")).alias("bucket"))
        else:
            left = stay.join(stay.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket").join(slim, "set_id")
            pairs = _block_pairs(left, F.ceil(F.col("n") / F.lit(SKETCH_BLOCK))).select("bucket", "pair_a", "pair_b", "side", "set_id", "sketch")
            keys = ("bucket", "pair_a", "pair_b")
            found.append(pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_blocks_by_sketch, "u long, v long").distinct())
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def intersections(a: list[np.ndarray], b: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, or of a with itself."""
    both = a if b is None else a + b
    flat = np.concatenate(both)
    if not len(flat):
        return np.zeros((len(a), len(both) - len(a) if b is not None else len(a)), np.float32)
    owner = np.repeat(np.arange(len(both), dtype=np.int32), [len(x) for x in both])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    token = np.cumsum(new, dtype=np.int32) - 1
    often = np.bincount(token) > 1
    number = np.cumsum(often, dtype=np.int32) - 1
    keep = often[token]
    token, owner = number[token[keep]], owner[keep]
    n = len(a)
    out = np.zeros((n, len(both) - n if b is not None else n), np.float32)
    for at in range(0, int(often.sum()), width):
        i, j = np.searchsorted(token, [at, at + width])
        x = np.zeros((len(both), width), np.float32)
        x[owner[i:j], token[i:j] - at] = 1
        out += x[:n] @ (x.T if b is None else x[n:].T)
    return out


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, n, hashes): how many of the batch's sets of a group have each shingle."""
    for batch in batches:
        component, n = batch.column("component").to_numpy(), batch.column("n").to_numpy()
        sets = [np.frombuffer(x, np.int64) for x in batch.column("hashes").to_pylist()]
        for c in np.unique(component):
            own = np.flatnonzero(component == c)
            tokens, counts = np.unique(np.concatenate([sets[i] for i in own]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(tokens), c)), pa.array(np.full(len(tokens), n[own[0]])), pa.array(tokens), pa.array(counts.astype(np.int64))], names=["component", "n", "token", "sets"]
            )


def settles(lacks: np.ndarray, adds: np.ndarray, core: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether sets that differ from the core so much are within the limit of all others of the kind."""
    return 2 * (lacks + threshold * adds) <= (1 - threshold) * core + 1e-9


_DIFFERENCES = pa.schema([
    ("component", pa.int64()), ("blocks", pa.int64()), ("set_id", pa.int64()), ("copies", pa.int64()), ("core", pa.int64()), ("lacks", pa.int64()), ("settled", pa.bool_()), ("hashes", pa.binary()),
])


def _differences(threshold: float) -> Callable:
    """Rows (component, blocks, set_id, copies, hashes, tokens): sets as differences from their group's core, the tokens."""

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, core = None, np.zeros(0, np.uint64)
        for batch in batches:
            components, tokens = batch.column("component").to_pylist(), batch.column("tokens")
            sizes, lacks, hashes = [], [], []
            for i, (component, x) in enumerate(zip(components, batch.column("hashes").to_pylist(), strict=True)):
                if component != of:
                    of, core = component, np.zeros(0, np.uint64)
                    if tokens[i].is_valid:
                        core = np.sort(tokens[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                own = np.frombuffer(x, np.uint64)
                hashes.append(np.setxor1d(core, own, assume_unique=True))
                sizes.append(len(core))
                lacks.append((len(hashes[-1]) + len(core) - len(own)) // 2)
            a, size = np.array(lacks, np.int64), np.array(sizes, np.int64)
            settled = settles(a, np.array([len(h) for h in hashes], np.int64) - a, size, threshold)
            kept = [batch.column(c).cast(pa.int64()) for c in ("component", "blocks", "set_id", "copies")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(size), pa.array(a), pa.array(settled, pa.bool_()), pa.array([h.tobytes() for h in hashes], pa.binary())], schema=_DIFFERENCES)

    return differences


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with what ``groups`` (component, blocks, ...) has of their group; a group's rows meet it in as many parts as it has blocks."""
    parts = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).drop("blocks")
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64("set_id", F.lit("part")), F.col("blocks").cast("long")).cast("int"))
    return dealt.join(parts, ["component", "__part"]).drop("__part")


def _differing(large: DataFrame, threshold: float, block: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Of groups of several blocks (component, n, blocks, set_id, copies, hashes): pairs of blocks to compare, and the links of settled sets."""
    counts = large.select("component", "n", "hashes").mapInArrow(_token_counts, "component long, n long, token long, sets long").groupBy("component", "n", "token").agg(F.sum("sets").alias("sets"))
    # more than half of the sets have each of them, so a core is smaller than two sets of mean size
    cores = counts.where(2 * F.col("sets") > F.col("n")).groupBy("component").agg(F.collect_list("token").alias("tokens"))
    groups = large.groupBy("component").agg(F.max("blocks").alias("blocks")).join(cores, "component", "left")
    rows = _with_group(large.select("component", "blocks", "set_id", "copies", "hashes"), groups).select("component", "blocks", "set_id", "copies", "hashes", "tokens")
    rows = checkpointed(rows.mapInArrow(_differences(threshold), "component long, blocks long, set_id long, copies long, core long, lacks long, settled boolean, hashes binary"))
    shingles_of = F.octet_length("hashes") / 8

    def blocks_of(which: Column) -> Column:
        n, size = F.sum(F.when(which, 1).otherwise(0)), F.sum(F.when(which, shingles_of).otherwise(0))
        return F.greatest(F.ceil(n / F.lit(block)), F.ceil(size / F.lit(block_shingles))).cast("int")

    settled = F.col("settled")
    of_group = rows.groupBy("component").agg(
        F.max("blocks").alias("blocks"), blocks_of(settled).alias("low"), blocks_of(~settled).alias("high"), F.sum(F.when(settled, F.col("copies"))).alias("all_copies"), F.min(F.when(settled, F.col("set_id"))).alias("first")
    )
    known = _with_group(rows, of_group)
    pairs = _block_pairs(known.select("component", "set_id", "copies", "core", "lacks", "hashes", "settled", "low", "high"), F.col("high"), settled, F.col("low"))
    alike = known.where(settled).select(F.col("set_id").alias("u"), F.explode(F.array(
        F.struct(F.lit(None).cast("long").alias("v"), (F.col("all_copies") - F.col("copies")).alias("links")), F.struct(F.col("first").alias("v"), F.lit(0).cast("long").alias("links"))
    )).alias("x")).select("u", "x.v", "x.links")
    return pairs.drop("settled", "low", "high"), alike


def _exact(threshold: float) -> Callable:
    """Rows (component, pair_a, pair_b, side, set_id, copies, core, lacks, hashes): links of each set, and spanning edges of exact links.

    Sets are differences from a core of ``core`` shingles, of which each lacks ``lacks``; whole sets have a core of none.
    """

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("component", "pair_a", "pair_b")):
            own = group["pair_a"][0].as_py() == group["pair_b"][0].as_py()
            side = np.array(group["side"].to_pylist())
            ids, copies = np.array(group["set_id"].to_pylist(), np.int64), np.array(group["copies"].to_pylist(), np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
            left = np.arange(len(ids)) if own else np.flatnonzero(side == 0)
            right = left if own else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            core, lacks = group["core"][0].as_py(), np.array(group["lacks"].to_pylist(), np.float64)
            common = intersections([sets[i] for i in left], None if own else [sets[i] for i in right]).astype(np.float64)
            common += core - lacks[left][:, None] - lacks[right][None]
            size = core + np.array([len(x) for x in sets], np.float64) - 2 * lacks
            near = common >= threshold * (size[left][:, None] + size[right][None] - common) - 1e-9
            if own:
                np.fill_diagonal(near, False)
            rows: dict[int, int] = {}
            for at, n in [*zip(left, near @ copies[right], strict=True), *([] if own else zip(right, near.T @ copies[left], strict=True))]:
                rows[int(at)] = rows.get(int(at), 0) + int(n)
            union, u, v, links = UnionFind(), [], [], []
            for at, n in rows.items():
                u.append(int(ids[at]))
                v.append(None)
                links.append(n)
            for i in range(len(left)):
                for j in np.flatnonzero(near[i, : i if own else None]):
                    if union.join(int(ids[left[i]]), int(ids[right[j]])):
                        u.append(int(ids[left[i]]))
                        v.append(int(ids[right[j]]))
                        links.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links, pa.int64())], schema=_LINKS)

    return exact


def _set_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in _slices(batches):
        ids, hashes = [], []
        for text in batch.column(0).to_pylist():
            h = shingles(text)
            if len(h) and (key := set_id(h)) not in seen:
                seen.add(key)
                ids.append(key)
                hashes.append(h.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["set_id", "hashes"])


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, broadcast_sets: int = BROADCAST_SETS) -> DataFrame:
    """doc_id, class_id and n_links of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = checkpointed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_to_sets(runs_needed(recall)), _SETS_SQL))
    counted = rows.where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.max("size").alias("size"))
    sets = rows.where("buckets is not null").select("set_id", "buckets", "reserve", "sketch").dropDuplicates(["set_id"])
    sets = checkpointed(sets)
    groups = checkpointed(connected_components(candidate_edges(sets, threshold=threshold, limit=limit)).withColumnsRenamed({"node": "set_id"}))
    in_groups = groups.select("set_id")
    if in_groups.count() <= broadcast_sets:
        in_groups = F.broadcast(in_groups)
    hashes = docs.select("text").mapInArrow(_set_hashes, "set_id long, hashes binary").join(in_groups, "set_id", "left_semi").dropDuplicates(["set_id"])
    members = groups.join(counted.select("set_id", "copies", "size"), "set_id")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    # the hashes, which are heavy, join last and so are moved once before they are dealt out
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("shingles") / F.lit(block_shingles)))
    members = checkpointed(members.join(sizes, "component").withColumn("blocks", blocks).select("component", "n", "blocks", "set_id", "copies"))
    grouped = hashes.join(members, "set_id")
    alike = None
    if members.where("blocks > 1").isEmpty():
        whole, pairs = grouped, None
    else:
        grouped = checkpointed(grouped)
        whole = grouped.where("blocks = 1")
        pairs, alike = _differing(grouped.where("blocks > 1"), threshold, block, block_shingles)
    none = F.lit(0).cast("long")
    whole = _block_pairs(whole.select("component", "set_id", "copies", none.alias("core"), none.alias("lacks"), "hashes"), F.lit(1))
    keys = ("component", "pair_a", "pair_b")
    links = (whole if pairs is None else whole.unionByName(pairs)).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_exact(threshold), "u long, v long, links long")
    links = checkpointed(links if alike is None else links.unionByName(alike))
    n_links = links.where("v is null").groupBy(F.col("u").alias("set_id")).agg(F.sum("links").alias("links"))
    classes = connected_components(links.where("v is not null").select("u", "v")).withColumnsRenamed({"node": "set_id"})
    named = counted.join(classes, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("least").alias("class_id"))
    of_set = named.join(least, "component").join(n_links, "set_id", "left").select("set_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "set_id").join(of_set, "set_id", "left").select(
        "doc_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op5_ngram_join": op5_ngram_join}

#: All pairs by an inverted index of shingles, classes by transitive closure.
ORACLE_SQL: dict[str, str] = {
    "op5_ngram_join": r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs)
),
windows AS (
  SELECT r, i, lead(word, 4) OVER w AS last, concat_ws(' ', word, lead(word) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS shingle
  FROM words WINDOW w AS (PARTITION BY r ORDER BY i)
),
shingled AS (SELECT r, list_sort(list(DISTINCT shingle)) AS shingles FROM windows WHERE last IS NOT NULL OR i = 1 GROUP BY r),
sets AS (
  SELECT row_number() OVER () AS s, shingles, len(shingles) AS size, count(*) AS copies, min(doc_id) AS least, list(r) AS members
  FROM shingled JOIN docs USING (r) GROUP BY shingles
),
tokens AS (SELECT s, size, unnest(shingles) AS shingle FROM sets),
edges AS (
  SELECT a.s AS u, b.s AS v FROM tokens a JOIN tokens b ON a.shingle = b.shingle AND a.s <> b.s
  GROUP BY a.s, b.s, a.size, b.size HAVING 10 * count(*) >= 8 * (a.size + b.size - count(*))
),
reached AS (
  SELECT s, s AS m FROM sets
  UNION
  SELECT reached.s, edges.v FROM reached JOIN edges ON edges.u = reached.m
),
classes AS (SELECT reached.s, min(least) AS class_id FROM reached JOIN sets ON sets.s = reached.m GROUP BY reached.s),
links AS (SELECT u AS s, CAST(sum(copies) AS BIGINT) AS n FROM edges JOIN sets ON sets.s = edges.v GROUP BY u),
found AS (
  SELECT unnest(members) AS r, class_id, copies - 1 + coalesce(n, 0) AS n_links FROM sets JOIN classes USING (s) LEFT JOIN links USING (s)
)
SELECT doc_id, CASE WHEN found.r IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(n_links, 0) AS n_links
FROM docs LEFT JOIN found USING (r)
"""
}
