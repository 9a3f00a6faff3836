"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed, shared_folder

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Java regular expression for a run of them.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch. Texts are of any length, so a batch of Spark's 10,000 rows and 64 MB is large in the JVM and in Python.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by ``ARROW_ROWS`` and ``ARROW_BYTES``; lower settings stay.

    Spark reads the bounds when a query starts, so they can't be set for one operator alone. Every
    operator here that runs Python calls this, so no result or memory depends on which ran before.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(key))[0]) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library, which has no such call
    _libc = None


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name like ``name`` that none of ``taken`` has, whatever the case."""
    used = {x.lower() for x in taken}
    return next(x for x in (f"__{name}_{i}" for i in count()) if x.lower() not in used)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of each row that is the same whenever the plan runs.

    Row numbers follow a scan's partitions, so they hold for tables; what comes from a shuffle, whose
    order may change, is checkpointed first.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = checkpointed(df)
    return df.withColumn(name, F.monotonically_increasing_id())


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where nothing may be learned from the row. A null id counts as held out."""
    return F.coalesce(remainder(doc_id, modulus) == 0, F.lit(True))


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` as long; null text has none.

    A word starts where a non-space follows a space or the start of the text.
    """
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(flat, F.lit("[^ ]+")).cast("long")


def uniform(*columns: Column) -> Column:
    """A pseudo-random number in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def fit_window(text: Column, key: Column, chars: int) -> Column:
    """What a fit reads of a text: all of it up to ``chars`` characters, else a window of that length at a place drawn by ``key``."""
    room = F.length(text) - chars
    start = F.when(room > 0, F.pmod(F.xxhash64(F.lit("window"), key), F.greatest(room, F.lit(0)) + 1) + 1).otherwise(1)
    return F.substr(text, start.cast("int"), F.lit(chars))


def stratified(df: DataFrame, by: str, per_value: int, key: list[str], seed: str, values: int = 256) -> DataFrame:
    """About ``per_value`` rows of each of the ``values`` commonest values of ``by``.

    Rows are picked by a hash of ``key``, so the sample is the same on every run. It is meant for
    fitting only and its size is bounded by ``per_value * values`` in expectation; values beyond the
    commonest ``values`` aren't learned.
    """
    counts = df.groupBy(by).count().orderBy(F.desc("count"), by).limit(values).collect()
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col(by) == F.lit(row[by]), F.lit(min(1.0, per_value / row["count"]))).otherwise(share)
    return df.where(uniform(F.lit(seed), *[F.col(k) for k in key]) < share)


Query = Callable[[SparkSession, str], DataFrame]
