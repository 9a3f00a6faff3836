"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut into pieces by the pattern of the vocabulary. The distinct pieces of the whole corpus are
gathered in slices (``blocks``), so each is encoded once, however many texts, tasks or copies have it.
In a slice, pieces are held as chains of byte tokens; an inverted index leads from a pair of tokens
to the places where the pair stands. Merges are replayed in rank order over all new pieces of the slice
(up to ``REPLAY_BYTES`` at a time, which bounds memory; pieces don't depend on each other): the pairs
of the lowest rank that occurs are merged at every place of their index, which changes the two
neighbouring pairs of each place and nothing else. A piece that is a token needs no merge. The ids go
back to the blocks, whose texts are written from the ids of their pieces, and decoded from these ids.

Memory is bounded by bytes of text in a block and by distinct pieces in a slice; nothing is kept from one
to the next.

Defined results: a null text is read as the empty text, which has no tokens; repeated rows give
repeated results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import Query, give_back, table

#: Bytes of new pieces that are replayed as one.
REPLAY_BYTES = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


#: Classes of this common form of pattern, and what they are in Python's own ``re`` for most Latin characters.
_CLASSES = ((r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+"), (r"\p{L}+", r"[^\W\d_]+"), (r"\p{N}+", r"\d+"))
_LATIN = 0x250


@cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of the pattern. Texts of characters that ``re`` and ``regex`` class alike are cut by ``re``, which is faster."""
    slow = regex.compile(pattern).findall
    parts, letters = pattern.split("|"), " ?" + _CLASSES[1][0]
    if letters in parts and all(x.startswith("'") for x in parts[: parts.index(letters)]):
        # what comes before can't start where a run of letters does, so the commonest alternative may go first
        parts.insert(0, parts.pop(parts.index(letters)))
    plain = "|".join(parts)
    for ours, theirs in _CLASSES:
        plain = plain.replace(ours, theirs)
    if "\\p" in plain:
        return slow
    odd = [c for c in map(chr, range(_LATIN)) if any(bool(regex.fullmatch(a, c)) != bool(re.fullmatch(b, c)) for a, b in (*_CLASSES, (r"\s", r"\s")))]
    strange = re.compile(f"[^\x00-{chr(_LATIN - 1)}]" + (f"|[{''.join(map(re.escape, odd))}]" if odd else "")).search
    fast = re.compile(plain).findall
    return lambda text: slow(text) if strange(text) else fast(text)


class MergeReplay:
    """Encodes pieces by one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: f"{rank}," for rank in self.tokens}
        self.byte_rank = [ranks[bytes([b])] for b in range(256)]

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each piece: the piece's own where it is a token, else by replay."""
        out: list = [self.ranks.get(p) for p in pieces]
        at = [i for i, x in enumerate(out) if x is None]
        out = [(x,) for x in out]
        for i, ids in zip(at, self.replay([pieces[i] for i in at]), strict=True):
            out[i] = ids
        return out

    def replay(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each piece, all pieces being merged together. A pair (a, b) is the number a << 32 | b."""
        joined = b"".join(pieces)
        n = len(joined)
        if not n:
            return [() for _ in pieces]
        first = np.array(self.byte_rank, np.int64)[np.frombuffer(joined, np.uint8)]
        ends = np.cumsum([len(p) for p in pieces])
        starts = [0, *ends[:-1].tolist()]
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[starts] = -1
        pairs = first[:-1] << 32 | first[1:]
        places = np.flatnonzero(after[:-1] >= 0)
        order = places[np.argsort(pairs[places], kind="stable")]
        distinct, at = np.unique(pairs[order], return_index=True)
        token, after, before = first.tolist(), after.tolist(), before.tolist()
        ranks, tokens = self.ranks, self.tokens
        index: dict[int, list[int] | None] = {}  # from a pair to its places; None: the pair is no token
        of_rank: dict[int, list[int]] = {}  # pairs in the index, by the rank of their merge
        waiting: list[int] = []

        def stand(pair: int, places: list[int]) -> None:
            rank = ranks.get(tokens[pair >> 32] + tokens[pair & 0xFFFFFFFF])
            if rank is None:
                index[pair] = None
                return
            index[pair] = places
            if rank in of_rank:
                of_rank[rank].append(pair)
            else:
                of_rank[rank] = [pair]
                heapq.heappush(waiting, rank)

        for pair, own in zip(distinct.tolist(), np.split(order, at[1:]), strict=True):
            stand(pair, own.tolist())
        while waiting:
            rank = heapq.heappop(waiting)
            same = of_rank.pop(rank)
            # places go from left to right; pairs of one rank may overlap (a, aa and aa, a), so they go together
            standing = index.pop(same[0]) if len(same) == 1 else [x for pair in same for x in index.pop(pair)]
            standing.sort()
            for place in standing:
                right = after[place]
                # a merge to the left may have taken the place, or changed the pair
                if right < 0 or token[place] < 0 or (token[place] << 32 | token[right]) not in same:
                    continue
                token[place] = rank
                token[right] = -1
                beyond = after[right]
                after[place] = beyond
                if beyond >= 0:
                    before[beyond] = place
                    pair = rank << 32 | token[beyond]
                    if pair not in index:
                        stand(pair, [place])
                    elif (places := index[pair]) is not None:
                        places.append(place)
                left = before[place]
                if left >= 0:
                    pair = token[left] << 32 | rank
                    if pair not in index:
                        stand(pair, [left])
                    elif (places := index[pair]) is not None:
                        places.append(left)
        whole = np.array(token)
        left = whole >= 0
        found, until = whole[left].tolist(), np.cumsum(left)[ends - 1].tolist()
        return [tuple(found[a:b]) for a, b in pairwise([0, *until])]


@cache
def _encoder(path: str) -> MergeReplay:
    return MergeReplay(load_ranks(path))


def _replay(path: str, replay_bytes: int) -> Callable:
    """Rows ``blocks.WORDS`` sorted by slice to the ids of their words: lengths and joined ids."""

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        now, number, lengths, flat = None, {}, [], []
        new: list[bytes] = []
        held: list[tuple[int, int, np.ndarray]] = []  # rows that wait for an answer

        def answers() -> pa.RecordBatch:
            ids = encoder.encode(new)
            lengths.extend(map(len, ids))
            flat.append(np.fromiter((i for x in ids for i in x), np.uint32))
            new.clear()
            whole = np.concatenate(flat)
            flat[:] = [whole]
            n = np.array(lengths, np.int64)
            starts = np.cumsum(n) - n
            rows = []
            for block, s, own in held:
                k = n[own]
                place = np.repeat(starts[own] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                rows.append((block, s, blocks.pack(k.astype(np.uint32)), blocks.pack(whole[place])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "slice", "lengths", "data"])

        size, sent = 0, 0
        for block, s, packed, data in blocks.by_slice(batches, "lengths", "data"):
            if s != now:
                if held:
                    yield answers()
                now, size, sent = s, 0, 0
                number.clear()
                lengths.clear()
                flat.clear()
            words = blocks.unpack_bytes(packed, data)
            own = np.empty(len(words), np.int64)
            for i, word in enumerate(words):
                k = number.get(word)
                if k is None:
                    k = number[word] = len(number)
                    new.append(word)
                    size += len(word)
                own[i] = k
            held.append((block, s, own))
            sent += len(own)
            if size >= replay_bytes or sent >= replay_bytes:
                yield answers()
                size, sent = 0, 0
        if held:
            yield answers()
        number.clear()
        give_back()

    return replay


def _finish(path: str, write: Callable[[MergeReplay, list[list[int]], blocks.Texts], pa.Table]) -> Callable:
    """cogroup function: a block's rows and the answers to it. write: from ids of each of the block's words to a result."""

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        encoder = _encoder(path)
        text_rows = rows.filter(pc.equal(rows["slice"], blocks.TEXTS)).to_pylist()
        (row,) = text_rows
        texts = blocks.Texts(row)
        got = {s: (blocks.unpack(n), blocks.unpack(x)) for s, n, x in zip(*(answers[c].to_pylist() for c in ("slice", "lengths", "data")), strict=True)}
        flat = np.concatenate([got[s][1] for s in sorted(got)]).tolist() if got else []
        ends = np.cumsum(np.concatenate([[0], *(got[s][0] for s in sorted(got))]).astype(np.int64)).tolist()
        ids: list = [flat[a:b] for a, b in pairwise(ends)]
        if len(ids) != texts.n_words:
            raise ValueError("a block has changed since its words were sent: docs must be a table, or checkpointed")
        ordered: list = [None] * len(ids)
        for code, x in zip(texts.by_slice.tolist(), ids, strict=True):
            ordered[code] = x
        out = write(encoder, ordered, texts)
        return out

    return finish


def _digests(encoder: MergeReplay, ids: list[list[int]], texts: blocks.Texts) -> pa.Table:
    number, token = encoder.digits.__getitem__, encoder.tokens.__getitem__
    digits = [number(x[0]) if len(x) == 1 else "".join(map(number, x)) for x in ids].__getitem__
    decoded = [b"".join(map(token, x)) for x in ids].__getitem__
    per_word = np.fromiter(map(len, ids), np.int64, len(ids))
    columns: tuple[list, list, list, list] = ([], [], [], [])
    start = 0
    for doc_id, end in zip(texts.ids, texts.ends.tolist(), strict=True):
        codes = texts.codes[start:end]
        start = end
        numbers = codes.tolist()
        columns[0].append(doc_id)
        columns[1].append(int(per_word[codes].sum()))
        columns[2].append(hashlib.sha256("".join(map(digits, numbers))[:-1].encode()).hexdigest())
        columns[3].append(hashlib.sha256(b"".join(map(decoded, numbers))).hexdigest())
    give_back()
    return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "n_tokens": pa.array(columns[1], pa.int64()), "ids_sha256": pa.array(columns[2], pa.string()), "decoded_sha256": pa.array(columns[3], pa.string())})


def _id_lists(encoder: MergeReplay, ids: list[list[int]], texts: blocks.Texts) -> pa.Table:
    flat = np.fromiter((i for x in ids for i in x), np.int32)
    per_word = np.fromiter(map(len, ids), np.int64, len(ids))
    starts = np.cumsum(per_word) - per_word
    k = per_word[texts.codes]
    place = np.repeat(starts[texts.codes] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
    until = np.concatenate([[0], np.cumsum(k)])[np.concatenate([[0], texts.ends])]
    lists = pa.ListArray.from_arrays(pa.array(until.astype(np.int32)), pa.array(flat[place] if len(flat) else flat, pa.int32()))
    return pa.table({"doc_id": pa.array(texts.ids, pa.int64()), "ids": lists})


def _encoded(docs: DataFrame, write: Callable, schema: str, path: str | None, pattern: str | None, block_bytes: int, replay_bytes: int) -> DataFrame:
    path = path or default_vocabulary()
    pattern = pattern or default_pattern()
    docs = docs.select("doc_id", "text")
    rows = blocks.coded(docs, lambda text: splitter(pattern)(text), blocks.slices_for(docs), block_bytes=block_bytes)
    answers = blocks.words_sent(rows).mapInArrow(_replay(path, replay_bytes), "block long, slice int, lengths binary, data binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(path, write), schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, block_bytes: int = blocks.BLOCK_BYTES, replay_bytes: int = REPLAY_BYTES) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs (doc_id, text)."""
    return _encoded(docs, _id_lists, "doc_id long, ids array<int>", path, pattern, block_bytes, replay_bytes)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, block_bytes: int = blocks.BLOCK_BYTES, replay_bytes: int = REPLAY_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids stand for) of every row of docs (doc_id, text)."""
    return _encoded(docs, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, block_bytes, replay_bytes)


def decode_column(ids: Column, path: str | None = None) -> Column:
    """Bytes of an array of token ids; null for null."""
    path = path or default_vocabulary()

    @F.arrow_udf("binary")
    def decoded(lists: pa.Array) -> pa.Array:
        token = _encoder(path).tokens
        return pa.array([None if x is None else b"".join([token[i] for i in x]) for x in lists.to_pylist()], pa.binary())

    return decoded(ids)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op7_byte_bpe": op7_byte_bpe}
