"""Texts as blocks of numbers, and the vocabulary in slices.

``coded`` reads each text once. A task cuts its texts into words (or pieces) and gathers them into
blocks of about ``BLOCK_BYTES`` of text. In a block each distinct word has a number, the frequent ones
low numbers, and each text is a row of numbers. The block's words are dealt into slices by their hash:
a slice is the part of the whole corpus's vocabulary that one task works on, and a block sends a slice
its own words of it in one row. What a slice finds out about its words it answers in one row for
each block, word by word in the order sent.

So each distinct word of the corpus is worked on once, no task and no broadcast holds the vocabulary,
and what travels are packed arrays: at most the distinct words of each block, there and back. A word,
however frequent, is sent once by each block, and a block is made of one task's rows in their order, so
neither hot words nor repeated rows meet in one task. The number of slices follows from the corpus's
bytes by a power law (``slices_for``), as the vocabulary does.

Rows have the columns of ``CODED``. slice ``TEXTS`` marks a block's texts: ids (doc_id of each text),
marks (a byte each), lengths (numbers of each text), data (the numbers), more (the slice of each of the block's
words). Other slices mark the words sent to them: lengths and data (the words), more (how often unmarked
texts of the block have each).
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

TEXTS = -1
#: Bytes of text that a block aims at; one text is never split.
BLOCK_BYTES = 12 << 20
#: Slices grow with the corpus's bytes / SLICE_BYTES to the power of SLICE_POWER.
SLICE_BYTES, SLICE_POWER = 4 << 20, 0.7
CODED = "block long, slice int, ids array<long>, marks binary, lengths binary, data binary, more binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("slice", pa.int32()), ("ids", pa.list_(pa.int64())), ("marks", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary()), ("more", pa.binary())])


def pack(x: np.ndarray) -> bytes:
    """Integers from 0 to 2 ** 32 - 1 as compressed planes of bytes."""
    x = np.ascontiguousarray(x, "<u4")
    planes = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    raw = x.view(np.uint8).reshape(-1, 4)
    return bytes([planes]) + len(x).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw[:, :planes].T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes, n = data[0], int.from_bytes(data[1:5], "little")
    out = np.zeros((n, 4), np.uint8)
    if planes and n:
        out[:, :planes] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:]), np.uint8).reshape(planes, n).T
    return out.view("<u4").ravel()


def pack_bytes(words: list[bytes]) -> tuple[bytes, bytes]:
    """Lengths and joined bytes."""
    return pack(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.ZstdCompressor(level=1).compress(b"".join(words))


def unpack_bytes(lengths: bytes, data: bytes) -> list[bytes]:
    ends = np.concatenate([[0], np.cumsum(unpack(lengths), dtype=np.int64)]).tolist()
    joined = zstandard.ZstdDecompressor().decompress(data)
    return [joined[a:b] for a, b in pairwise(ends)]


def slices_for(docs: DataFrame, text: str = "text") -> int:
    """How many slices the vocabulary of ``docs`` is worked on in."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, round((total / SLICE_BYTES) ** SLICE_POWER))


def _block_rows(block: int, number: dict, flat: array, ids: list, marks: bytearray, lengths: list[int], slices: int) -> pa.RecordBatch:
    """A block's rows from the numbers that words took as they came."""
    codes = np.frombuffer(flat, np.uint32) if len(flat) else np.zeros(0, np.uint32)
    counts = np.bincount(codes, minlength=len(number))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    codes = rank[codes]
    names = list(number)
    words = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in map(names.__getitem__, order.tolist())]
    of = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % np.uint32(slices)
    unmarked = np.bincount(codes[np.repeat(np.frombuffer(marks, np.uint8) == 0, lengths)], minlength=len(words))
    rows = [(block, TEXTS, ids, bytes(marks), pack(np.array(lengths, np.uint32)), pack(codes), pack(of))]
    by_slice = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[by_slice], np.arange(slices + 1))
    for s in range(slices):
        own = by_slice[ends[s] : ends[s + 1]]
        if len(own):
            rows.append((block, s, None, None, *pack_bytes([words[i] for i in own.tolist()]), pack(unmarked[own])))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _cut(split: Callable[[str], list], slices: int, block_bytes: int, end: object) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        number: defaultdict = defaultdict()
        flat, ids, marks, lengths, size = array("I"), [], bytearray(), [], 0

        def start() -> None:
            nonlocal number, flat, ids, marks, lengths, size
            number, flat, ids, marks, lengths, size = defaultdict(), array("I"), [], bytearray(), [], 0
            number.default_factory = number.__len__
            if end is not None:
                number[end]  # noqa: B018  the end has a number in every block

        start()
        for batch in batches:
            for doc_id, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or ""
                before = len(flat)
                flat.extend(map(number.__getitem__, split(text)))
                if end is not None:
                    flat.append(number[end])
                ids.append(doc_id)
                marks.append(mark)
                lengths.append(len(flat) - before)
                size += len(text)
                if size >= block_bytes:
                    yield _block_rows(block, number, flat, ids, marks, lengths, slices)
                    block += 1
                    start()
        if ids:
            yield _block_rows(block, number, flat, ids, marks, lengths, slices)
        start()
        give_back()

    return cut


def coded(docs: DataFrame, split: Callable[[str], list], slices: int, mark: Column | None = None, end: object = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``CODED`` of docs (doc_id, text), dealt out by block. end: a word that follows each text.

    ``docs`` must give the same rows in the same order whenever a task runs again, as tables do.
    """
    small_batches(docs.sparkSession)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(mark, F.lit(False)).cast("int") if mark is not None else F.lit(0))
    return marked.mapInArrow(_cut(split, slices, block_bytes, end), CODED).repartition("block")


class Texts:
    """A block's texts, from its row."""

    def __init__(self, row: dict):
        self.ids, self.marks = row["ids"], np.frombuffer(row["marks"], np.uint8)
        self.lengths, self.codes, self._of = unpack(row["lengths"]), unpack(row["data"]), unpack(row["more"])
        self.by_slice = np.argsort(self._of, kind="stable")  # the words in the order of their slices' answers
        self.ends = np.cumsum(self.lengths, dtype=np.int64)

    @property
    def n_words(self) -> int:
        return len(self._of)

    def slice_ends(self) -> dict[int, tuple[int, int]]:
        """Where each slice's words stand in ``by_slice``."""
        slices, starts = np.unique(self._of[self.by_slice], return_index=True)
        return {int(s): (int(a), int(b)) for s, a, b in zip(slices, starts, np.append(starts[1:], len(self._of)), strict=True)}

    def joined(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        """Answers of all slices by the block's numbers."""
        parts = [answers[s] for s in sorted(answers)]
        whole = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if len(whole) != self.n_words:
            raise ValueError("a block has changed since its words were sent: docs must be a table, or checkpointed")
        out = np.empty_like(whole)
        out[self.by_slice] = whole
        return out


WORDS = "block long, slice int, lengths binary, data binary, more binary"


def words_sent(rows: DataFrame, *also: str) -> DataFrame:
    """The words that blocks send, by slice, with further binary columns. A Python step, so that ``rows`` stays one exchange that both ends of a query read."""

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.not_equal(batch.column("slice"), TEXTS)).select(["block", "slice", "lengths", "data", "more", *also])

    return rows.mapInArrow(word_rows, ", ".join([WORDS, *(f"{c} binary" for c in also)])).repartition("slice").sortWithinPartitions("slice", "block")


def by_slice(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(block, slice, *columns) of rows one by one."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("block", "slice", *columns)), strict=True)
