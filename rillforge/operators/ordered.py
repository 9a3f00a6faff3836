"""Operators that depend on order within a source: dedup, transactions, watermarks, snapshots, limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..envelope import MUTATIONS, TERMINATORS
from ..shared import checkpointed
from .stateless import MARKER_TABLE, drop_markers


def dedup_keep_first(df: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """The first row of each id: what the bounded form gives while repeats stay within its capacity.

    An aggregate, not a window: map-side partial results keep hot ids off one task.
    """
    others = [c for c in df.columns if c not in by]
    first = df.groupBy(*by).agg(F.min(F.struct("seq", *[c for c in others if c != "seq"])).alias("__r"))
    return first.select(*[c if c in by else F.col(f"__r.{c}").alias(c) for c in df.columns])


class FifoDedup:
    """Remembers the last ``capacity`` accepted ids; a repeat doesn't make its id younger."""

    def __init__(self, capacity: int):
        self.capacity, self.seen, self.queue = capacity, set(), deque()

    def check(self, id: str) -> bool:
        if id in self.seen:
            return True
        self.seen.add(id)
        self.queue.append(id)
        if len(self.queue) > self.capacity:
            self.seen.discard(self.queue.popleft())
        return False


#: Rows that a task of a scan in order takes, and how many times the capacity they are at least: the queues at
#: the tasks' ends meet on the driver.
SCAN_ROWS, SCAN_QUEUES = 250_000, 64


def in_ranges(df: DataFrame, order: list[str], rows: int, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``df`` in total order over tasks of about ``rows`` rows, numbered by __part; kept, so that all passes over it agree."""
    n = max(1, -(-df.count() // rows))
    return keep(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))


def _fifo_pass(capacity: int, source: str, starts: Broadcast, emit: str):
    """One task's rows in order, its first source with the queue of ``starts``.

    emit: "end" gives the first source, the last one and its queue; "queues" those of the sources that
    end in the task (starts names the tasks whose last source goes on in the next).
    """
    lists = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("ids", pa.list_(pa.string()))])

    def told(part: int, first: str | None, last: str | None, state: FifoDedup) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, first, last, list(state.queue)), lists, strict=True)], schema=lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queues, going_on = starts.value
        part = first = now = state = None
        for batch in batches:
            for name, id in zip(batch.column(source).to_pylist(), batch.column("id").to_pylist(), strict=True):
                if state is None or name != now:
                    if state is not None and emit == "queues":
                        yield told(part, first, now, state)
                    now, new = name, FifoDedup(capacity)
                    if state is None:
                        part, first = batch.column("__part")[0].as_py(), name
                        for x in queues.get(part, ()):
                            new.check(x)
                    state = new
                state.check(id)
        if state is not None and (emit == "end" or emit == "queues" and part not in going_on):
            yield told(part, first, now, state)

    return run


def _accepted(capacity: int, starts: Broadcast):
    """Whether the dedup accepts each of one task's rows in order: only what tells this goes to Python, not the row.

    Not deterministic to the optimizer, so that no filter of a later step takes rows away below it.
    """

    @F.arrow_udf("boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        now = state = None
        for sources, ids, turns, parts in batches:
            keep = []
            for name, id, turn in zip(sources.to_pylist(), ids.to_pylist(), turns.to_pylist(), strict=True):
                if state is None:
                    now, state = name, FifoDedup(capacity)
                    for x in starts.value[0].get(parts[0].as_py(), ()):
                        state.check(x)
                elif name != now:
                    now, state = name, FifoDedup(capacity)
                keep.append(not state.check(id) and turn > 0)
            yield pa.array(keep, pa.bool_())

    return run.asNondeterministic()


def fifo(
    df: DataFrame, capacity: int, source: str = "source_database", held: DataFrame | None = None, rows: int = SCAN_ROWS, keep: Callable[[DataFrame], DataFrame] = checkpointed,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that the bounded dedup accepts, each source in seq order; each source's queue afterwards (source, seq, id); and the kept input.

    held: queues before the first rows, in the same form. The order is cut into tasks. Each runs from the queue
    that the one before it was found to end with, at first an empty one, until no start changes; then every
    task has started from the true end of the one before it. A round settles one task at least, and all but
    always all of them, as queues forget their start; only tasks whose start changed run again.
    """
    spark = df.sparkSession
    turns = df.withColumn("__turn", F.lit(1))
    if held is not None:
        turns = turns.unionByName(held.withColumn("__turn", F.lit(0)), allowMissingColumns=True)
    ranges = in_ranges(turns, [source, "__turn", "seq", "id"], max(rows, SCAN_QUEUES * capacity), keep)
    told = "part int, first string, last string, ids array<string>"

    def at(emit: str, of: DataFrame) -> DataFrame:
        return of.select(source, "id", "__part").mapInArrow(_fifo_pass(capacity, source, spark.sparkContext.broadcast((queues, going_on)), emit), told)

    queues: dict[int, list[str]] = {}
    going_on: set[int] = set()
    ends: dict[int, Row] = {}
    changed = None
    while changed is None or changed:
        found = at("end", ranges).rdd
        ends |= {r.part: r for r in spark.sparkContext.runJob(found, list, changed)}
        after, going_on = {}, set()
        for a, b in pairwise(sorted(ends)):
            if ends[a].last == ends[b].first:
                after[b] = ends[a].ids
                going_on.add(a)
        changed = [b for b in after if after[b] != queues.get(b, [])]
        queues = after
    # where no source ends, none tells its queue
    ending = [int(a) for a in ends if a not in going_on or ends[a].first != ends[a].last]
    left = at("queues", ranges.where(F.col("__part").isin(ending))).select(F.col("last").alias(source), F.posexplode("ids").alias("seq", "id"))
    accepted = _accepted(capacity, spark.sparkContext.broadcast((queues, going_on)))
    kept = ranges.withColumn("__keep", accepted(source, "id", "__turn", "__part")).where("__keep").select(*df.columns)
    return kept, left.select(source, F.col("seq").cast("long"), "id"), ranges


def dedup_fifo(df: DataFrame, capacity: int = 1000, source: str = "source_database", rows: int = SCAN_ROWS) -> DataFrame:
    """The exact bounded form: each source in seq order, in tasks of about ``rows`` rows that hand their queues on."""
    return fifo(df, capacity, source, rows=rows)[0]


def with_terminator(df: DataFrame, source: str = "source_database", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Adds terminator and terminator_seq, the next Commit or Rollback at or after each row of its transaction in ``order``."""
    # backwards, so that the frame only grows: one pass over a transaction of any length
    w = Window.partitionBy(source, "transaction_id").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.when(F.col("operation").isin(*TERMINATORS), F.struct(F.col("operation").alias("op"), F.col("seq").alias("at")))
    return df.withColumn("__t", F.last_value(end, True).over(w)).withColumns({"terminator": F.col("__t.op"), "terminator_seq": F.col("__t.at")}).drop("__t")


def _open(df: DataFrame, ended: str | None) -> DataFrame:
    rows = with_terminator(df.where(F.col("transaction_id").isNotNull()))
    match = F.col("terminator").isNull() if ended is None else F.col("terminator") == ended
    return rows.where(F.col("operation").isin(*MUTATIONS) & match)


def tx_committed(df: DataFrame) -> DataFrame:
    """Rows that reach the sinks, with emit_seq: mutations at their commit, rows without transaction at once.

    Rows without a transaction pass by the window, so they aren't one large partition.
    """
    free = df.where(F.col("transaction_id").isNull()).withColumn("emit_seq", F.col("seq"))
    done = _open(df, "Commit").withColumn("emit_seq", F.col("terminator_seq")).drop("terminator", "terminator_seq")
    return free.unionByName(done)


def gate(df: DataFrame, held: DataFrame, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``tx_committed`` lets pass, without emit_seq; the mutations still open afterwards; and the kept rows.

    held: mutations open before the first rows of ``df``, whatever their seq.
    """
    rows = df.where(F.col("transaction_id").isNotNull()).withColumn("__turn", F.lit(1)).unionByName(held.withColumn("__turn", F.lit(0)))
    told = keep(with_terminator(rows, order=("__turn", "seq")).where(F.col("operation").isin(*MUTATIONS)))
    pick = lambda match: told.where(match).select(*df.columns)
    return df.where(F.col("transaction_id").isNull()).unionByName(pick("terminator = 'Commit'")), pick("terminator is null"), told


def tx_rolled_back(df: DataFrame) -> DataFrame:
    return _open(df, "Rollback").drop("terminator", "terminator_seq")


def tx_in_flight(df: DataFrame) -> DataFrame:
    return _open(df, None).drop("terminator", "terminator_seq")


def tx_prune(df: DataFrame, max_open: int, source: str = "source_database") -> DataFrame:
    """Mutations in flight; those of a source with more than ``max_open`` open transactions are all dropped."""
    flight = tx_in_flight(df)
    # distinct transactions are counted in two steps, so a source's rows needn't meet in one task
    counts = flight.select(source, "transaction_id").distinct().groupBy(source).agg(F.count("*").alias("__n"))
    return flight.join(_small(counts), source).where(F.col("__n") <= max_open).drop("__n")


#: Rows that may be broadcast: marker intervals, or one row for each source.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if a count of it allows one; else the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def load_chunk(rows: DataFrame, position: str = "pos") -> DataFrame:
    """Snapshot rows by key; of repeated keys the last."""
    return rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), position).alias("__r")).select("key", "__r.*")


def windows(log: DataFrame, marker: str = MARKER_TABLE, source: str = "source_database") -> DataFrame:
    """Open intervals (source, low, high) from marker rows; an unclosed one has no high."""
    marks = log.where((F.col("source_table_or_collection") == marker) & F.col("operation").isin("Create", "Commit")).select(source, "seq")
    w = Window.partitionBy(source).orderBy("seq")
    return marks.select(source, F.col("seq").alias("low"), F.lead("seq").over(w).alias("high"), F.row_number().over(w).alias("n")).where("n % 2 = 1").drop("n")


def window_flags(
    log: DataFrame, marker: str = MARKER_TABLE, source: str = "source_database", held: DataFrame | None = None, rows: int = SCAN_ROWS, keep: Callable[[DataFrame], DataFrame] = checkpointed,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events with in_window and without markers; the sources whose window is open afterwards; and the kept input.

    Any two Create or Commit markers make a window. held: sources with an open window before the first rows.
    Tasks count the markers of their rows; those of a source's earlier tasks tell how a task starts.
    """
    is_marker = F.col("source_table_or_collection").eqNullSafe(F.lit(marker))
    turns = log.withColumns({"__turn": F.lit(1), "__toggle": F.coalesce(is_marker & F.col("operation").isin("Create", "Commit"), F.lit(False)), "__event": ~is_marker})
    if held is not None:
        turns = turns.unionByName(held.select(source, F.lit(0).alias("__turn"), F.lit(True).alias("__toggle"), F.lit(False).alias("__event")), allowMissingColumns=True)
    ranges = in_ranges(turns, [source, "__turn", "seq"], rows, keep)
    # of each source with markers, how many each of its tasks has; only tasks that a source goes on in need a start, one each
    counts = ranges.groupBy("__part", source).agg(F.count_if("__toggle").alias("n"))
    before = F.sum("n").over(Window.partitionBy(source).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    open_ = {r["__part"] for r in counts.withColumn("before", before).where("before % 2 = 1").select("__part", F.col(source)).collect()}
    starts = log.sparkSession.sparkContext.broadcast(open_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, inside = False, None, False
        for batch in batches:
            flags = []
            for name, toggle in zip(batch.column(source).to_pylist(), batch.column("__toggle").to_pylist(), strict=True):
                if not begun:
                    begun, now, inside = True, name, batch.column("__part")[0].as_py() in starts.value
                elif name != now:
                    now, inside = name, False
                inside ^= toggle
                flags.append(inside)
            out = batch.append_column("in_window", pa.array(flags, pa.bool_()))
            yield out.filter(batch.column("__event")).drop_columns(["__turn", "__toggle", "__event", "__part"])

    after = counts.groupBy(source).agg(F.sum("n").alias("n")).where("n % 2 = 1").select(source)
    return ranges.mapInArrow(run, StructType([*log.schema.fields, StructField("in_window", BooleanType())])), after, ranges


def reconcile(chunk: DataFrame, log: DataFrame, marker: str = MARKER_TABLE, source: str = "source_database") -> DataFrame:
    """Chunk rows (key, after, timestamp, ...) as left by the log's events inside marker windows.

    Any delete of a key drops its row; else the last create or update gives after (null too) and timestamp.
    """
    # few markers make few spans; broadcast, they leave the log's events where they are
    spans = _small(windows(log, marker, source).withColumnRenamed(source, "__s"))
    events = drop_markers(log, marker).where(F.col("operation").isin("Create", "Update", "Delete"))
    inside = events.join(spans, (events[source] == F.col("__s")) & (F.col("seq") > F.col("low")) & (F.col("high").isNull() | (F.col("seq") < F.col("high"))), "left_semi")
    gone = F.max((F.col("operation") == "Delete").cast("int")).alias("__gone")
    last = F.max(F.when(F.col("operation") != "Delete", F.struct("seq", "after", "timestamp"))).alias("__last")
    patch = inside.groupBy("key").agg(gone, last)
    out = chunk.join(patch, "key", "left").where(F.coalesce("__gone", F.lit(0)) == 0)
    has = F.col("__last").isNotNull()
    return out.withColumns({c: F.when(has, F.col(f"__last.{c}")).otherwise(F.col(c)) for c in ("after", "timestamp")}).drop("__gone", "__last")


def pairwise_winner(a: Column, b: Column) -> Column:
    """Of two events (structs with timestamp) the later; a on a tie."""
    return F.when(a["timestamp"] >= b["timestamp"], a).otherwise(b)


def last_write_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is greatest by ``order``, by a partial aggregate."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*key, "__r.*").select(*df.columns)


def plan_chunks(spark: SparkSession, total: int, size: int) -> DataFrame:
    """chunk_id, min_key, max_key over keys 1 to total."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    i = F.col("id")
    return spark.range(max(0, -(-total // size))).select(i.cast("int").alias("chunk_id"), (i * size + 1).alias("min_key"), F.least((i + 1) * size, F.lit(total)).alias("max_key"))


def chunk_rows(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Each row with its chunk, by arithmetic instead of a range join; one task reads one chunk or more."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    return rows.withColumn("chunk_id", F.floor((F.col(key) - 1) / F.lit(size)).cast("int"))


def process_chunks(chunks: DataFrame, rows: DataFrame, key: str, size: int, total: int) -> DataFrame:
    """chunk_id, n_rows and status of every chunk; empty chunks complete too."""
    counts = chunk_rows(rows.where((F.col(key) >= 1) & (F.col(key) <= total)), key, size).groupBy("chunk_id").agg(F.count("*").alias("n_rows"))
    return chunks.join(counts, "chunk_id", "left").select("chunk_id", "min_key", "max_key", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit("Completed").alias("status"))


def run_chunks(chunks: DataFrame, work: Callable[[int, int, int], int], workers: int = 4) -> DataFrame:
    """chunks with n_rows, status and error after ``work(chunk_id, min_key, max_key)``, which tells the rows it did.

    A chunk is Completed, or Failed with the error's text; a failing chunk stops no other. Chunks that are
    Completed already (a status column) aren't run again, so a second run takes up what is left.
    """
    if workers < 1:
        raise ValueError("chunks need a worker")
    known = chunks if "status" in chunks.columns else chunks.withColumns({"n_rows": F.lit(0).cast("long"), "status": F.lit("Pending"), "error": F.lit(None).cast("string")})
    todo = known.where("status <> 'Completed'").select("chunk_id", "min_key", "max_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows.append((*chunk, int(work(*chunk)), "Completed", None))
                except Exception as e:
                    rows.append((*chunk, 0, "Failed", f"{type(e).__name__}: {e}"))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["chunk_id", "min_key", "max_key", "n_rows", "status", "error"])

    done = todo.repartition(workers, "chunk_id").mapInArrow(run, "chunk_id int, min_key long, max_key long, n_rows long, status string, error string")
    return done.unionByName(known.where("status = 'Completed'").select("chunk_id", "min_key", "max_key", "n_rows", "status", "error"))


def progress(done: DataFrame) -> DataFrame:
    return done.agg(F.concat(F.count_if(F.col("status") == "Completed").cast("string"), F.lit("/"), F.count("*").cast("string")).alias("progress"))


def admission(df: DataFrame, arrival: str, capacity: int, rate: float, order: str = "seq", by: str | None = None) -> DataFrame:
    """Adds admitted: when a token bucket lets each unit arrival (in seconds) pass, first come first served.

    The order is global within ``by``; without it one task sees all rows, as one limiter does.
    """
    if capacity < 1 or rate <= 0:
        raise ValueError("capacity and rate must be positive, and one request must fit the capacity")
    keys = [by] if by else [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy(order)
    i = (F.row_number().over(w) - 1).alias("__i")
    ranked = df.withColumn("__i", i).withColumn("__d", F.max(F.col(arrival) - F.col("__i") / F.lit(rate)).over(w))
    last = (F.lag("__d").over(w) + F.col("__i") / F.lit(rate)) - F.lit((capacity - 1) / rate)
    return ranked.withColumn("admitted", F.greatest(F.col(arrival), F.coalesce(last, F.col(arrival)))).drop("__i", "__d")
