"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is to be taken ``target / source_size`` times, a number of at most
``max_copies``. Its whole part is taken for sure; the fractions are rounded so that the words taken
keep their sum: two documents with fractional copies are paired, and mass that counts the same
number of words moves from one to the other, in a random direction that leaves both expectations
as they are, until one of the two is integral. The other goes into the next pair. Every group of
rows so leaves one residual per source; residuals are regrouped and paired again, level by level,
until each source has one, whose fraction is settled by a draw.

A source's taken words therefore differ from its target by less than the size of one document.

A source has as many groups as its number of rows asks for, so a hot source is many groups. Rows go to
groups by a hash of their content; rows that repeat each other are told apart by a number (``ordinals``),
so a row that is repeated without end is spread like any other.

Defined results: null text has size 0 and takes nothing; the null source is a source of its own and
comes last; repeated rows are documents of their own; an empty table gives an empty result. Draws
are hashes of row content and group, so reruns agree; of rows that repeat each other it is open which
takes what, as they are alike.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Query, checkpointed, small_batches, table, uniform, word_count

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3.0
#: Rows that one group of the first level aims at, and residuals that one group of a later level pairs.
GROUP_ROWS = 512
FAN_IN = 64


def targets(sizes: list[int], weights: list[float], total: float, max_copies: float = MAX_COPIES) -> list[float]:
    """Share ``total`` by weight; what exceeds ``max_copies * size`` is reshared among the others.

    If every source stops at its limit, the rest of the total stays unused.
    """
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(total)
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > max_copies * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = max_copies * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def target_table(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, int]:
    """One row per source: source, source_size, target, groups; and the most groups that a source has.

    A driver-side loop over sources, of which there are few; the documents stay on the executors.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.n) for r in rows]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], sum(sizes), max_copies)
    groups = [max(1, -(-r.rows // group_rows)) for r in rows]
    found = sized.sparkSession.createDataFrame(
        [(r.source, n, t, g) for r, n, t, g in zip(rows, sizes, wanted, groups, strict=True)], "source string, source_size long, target double, groups long"
    )
    return found, max(groups, default=1)


def _count_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: defaultdict[int, int] = defaultdict(int)
    for batch in batches:
        nth = []
        for x in batch.column("row_hash").to_pylist():
            nth.append(seen[x])
            seen[x] += 1
        yield batch.append_column("nth", pa.array(nth, pa.int64()))


def ordinals(rows: DataFrame) -> DataFrame:
    """rows (..., row_hash, part) with ``ordinal``, which counts the rows of one row_hash from 0.

    Each part counts its own, then the counts of a hash's parts are summed, one row for each part: the
    repeats of a row never meet in a task. ``part`` is the partition that ``rows`` are checkpointed in.
    """
    counted = rows.mapInArrow(_count_repeats, f"{rows._jdf.schema().toDDL()}, nth long")
    parts = rows.groupBy("row_hash", "part").agg(F.count("*").alias("n"))
    several = parts.groupBy("row_hash").agg(F.count("*").alias("k")).where("k > 1").select("row_hash")
    before = Window.partitionBy("row_hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.join(several, "row_hash").select("row_hash", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return counted.join(offsets, ["row_hash", "part"], "left").withColumn("ordinal", F.col("nth") + F.coalesce("offset", F.lit(0))).drop("nth", "offset", "part")


def _draw(*parts: object) -> float:
    return struct.unpack(">Q", hashlib.blake2b(repr(parts).encode(), digest_size=8).digest())[0] / 2.0**64


def _pivot(rows: list[tuple], level: int) -> tuple[list[tuple[int, int]], tuple[int, float] | None]:
    """Settle all rows but one at most. rows: (row hash, size, fraction) with 0 < fraction < 1 and size > 0.

    Gives (position, 0 or 1) of the settled rows, and (position, fraction) of the residual.
    """
    done: list[tuple[int, int]] = []
    carry: tuple[int, float] | None = None
    tiny = 1e-12
    for j, (key, size, q) in enumerate(rows):
        if carry is None:
            carry = (j, q)
            continue
        i, p = carry
        a = rows[i][1]
        up, down = min((1 - p) * a, q * size), min(p * a, (1 - q) * size)
        if _draw(level, rows[i][0], key, j) * (up + down) < down:
            p, q = p + up / a, q - up / size
        else:
            p, q = p - down / a, q + down / size
        carry = None
        for at, x in ((i, p), (j, q)):
            if x < tiny or x > 1 - tiny:
                done.append((at, int(x > 0.5)))
            else:
                carry = (at, x)
    return done, carry


_FIELDS = ["row", "doc_id", "source", "size", "whole", "fraction", "row_hash", "bucket", "groups", "extra"]
_LEVEL = "row long, doc_id long, source string, size long, whole long, fraction double, row_hash long, bucket long, groups long, extra long"
_OUT = ("row", "doc_id", "source", "size")


def _settle(level: int):
    """applyInArrow function for one (source, bucket): rows settled get ``extra``, the residual keeps it null."""

    def settle(group: pa.Table) -> pa.Table:
        # large documents first: the residual is then likely a small one
        group = group.sort_by([("size", "descending"), ("row_hash", "ascending")])
        hashes, sizes, fractions = (group[c].to_pylist() for c in ("row_hash", "size", "fraction"))
        done, carry = _pivot(list(zip(hashes, sizes, fractions, strict=True)), level)
        extra: list[int | None] = [None] * len(hashes)
        for at, x in done:
            extra[at] = x
        if carry is not None:
            fractions[carry[0]] = carry[1]
        out = group.set_column(_FIELDS.index("extra"), "extra", pa.array(extra, pa.int64()))
        return out.set_column(_FIELDS.index("fraction"), "fraction", pa.array(fractions, pa.float64()))

    return settle


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: float = MAX_COPIES,
    group_rows: int = GROUP_ROWS,
    fan_in: int = FAN_IN,
    row: str | None = None,
) -> DataFrame:
    """row, doc_id, source, size, source_size, target, copies and taken of every row of ``docs`` (doc_id, text, source).

    row: a long column of ``docs`` to carry along, by which the caller knows its rows again; null if not given.
    """
    small_batches(docs.sparkSession)
    sized = docs.select(
        (F.col(row) if row else F.lit(None)).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text", "source").alias("row_hash"), F.spark_partition_id().alias("part"),
    )
    sized = checkpointed(sized)
    wanted, groups = target_table(sized, weights, max_copies, group_rows)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    told = ordinals(sized).withColumn("row_hash", F.xxhash64("row_hash", "ordinal"))
    # the sources' table is as long as the list of sources; Spark's own size limit decides on broadcasting it
    rows = (
        told.join(wanted, told.source.eqNullSafe(wanted.source), "left").select("row", "doc_id", told.source, "size", "row_hash", "groups", ratio.alias("ratio"))
        .withColumn("whole", F.floor(F.col("ratio") + F.lit(1e-9)).cast("long"))
        .withColumn("fraction", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    )
    # rows that have nothing to round are settled as they come
    plain = (F.col("size") == 0) | (F.col("fraction") < 1e-9)
    open_ = checkpointed(rows.select(
        "row", "doc_id", "source", "size", "whole", "fraction", "row_hash", F.pmod(F.xxhash64("row_hash", F.lit("bucket")), "groups").alias("bucket"), "groups", F.when(plain, F.lit(0)).cast("long").alias("extra"),
    ))
    done = lambda df, extra: df.select(*_OUT, (F.col("whole") + extra).alias("copies"))
    settled = [done(open_.where(F.col("extra").isNotNull()), F.col("extra"))]
    open_, level = open_.where(F.col("extra").isNull()), 0
    while True:
        ran = checkpointed(open_.groupBy("source", "bucket").applyInArrow(_settle(level), _LEVEL))
        settled.append(done(ran.where(F.col("extra").isNotNull()), F.col("extra")))
        residual = ran.where(F.col("extra").isNull())
        if groups == 1:
            break
        groups, level = -(-groups // fan_in), level + 1
        open_ = residual.withColumn("groups", F.ceil(F.col("groups") / F.lit(fan_in))).withColumn("bucket", F.pmod("bucket", "groups"))
    last = (uniform(F.lit("last"), F.col("row_hash"), F.col("source")) < F.col("fraction")).cast("long")
    settled.append(done(residual, last))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return (
        out.join(wanted, out.source.eqNullSafe(wanted.source), "left")
        .select("row", "doc_id", out.source, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES: dict[str, Query] = {"op6_mix_sources": op6_mix_sources}
