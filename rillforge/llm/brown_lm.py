"""Scores of a class-based bigram language model in the manner of Brown et al.

Tokens are words with A-Z lower-cased, and one end after each text. Training:

1. Words that may be frequent: those frequent enough in the batches of training texts that they can
   make up ``1 / CORE`` of all tokens (``frequent``). Bigrams tell which do.
2. Units of the exchange: each word that makes up at least ``1 / CORE`` of all tokens is a unit (there
   are ``CORE`` at most), as is the end; every other word stands in one of ``SIGNATURES`` units by
   the hash of its last letters and closing mark. Bigrams of units are counted over all training texts.
3. Exchange clustering: units are visited by frequency and each moves to the class that most raises
   the likelihood of the class bigram model, until a round moves none. The bigram counts have at most
   (CORE + 1 + SIGNATURES) ** 2 cells whatever the corpus, so this runs in the driver.
4. Every further word of the training texts, however rare, gets its class by its own counts with the
   classes before and after it: the class under which these are likeliest. The counts meet in the word's
   slice of the vocabulary (``blocks``), so the clustered vocabulary is the vocabulary of the corpus.
   Signatures only give the classes of neighbours in this pass, and of words that training has not seen.
5. Class bigrams are counted anew with the classes of all words.

P(word | class before) = P(class | class before) * P(word | class): transitions with Witten-Bell
smoothing, emissions (c + 0.1) / (N_class + 0.1 * (V_class + 1)), which leaves mass for unseen words.

Steps 4 and 5 and the scores cut each text once: texts stand in blocks of numbers, in the order of their
rows, repeated rows like others. A block sends each slice its own distinct words there, with the neighbours
of their training tokens, and the slice answers with the words' counts and classes. So no task needs the
vocabulary as a whole and nothing that grows is broadcast. The block then has the class of each token,
from which step 5 and the scores are reckoned row by row.

Defined results: null texts are empty, that is one end; a null doc_id counts as held out; repeated
rows count and score each; without training texts every count is 0. Extra columns are ignored.
``docs`` must be a table or other plan that gives the same rows in the same order, else it is checkpointed.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import Query, checkpointed, give_back, held_out, numbered, small_batches, table

END = b""
FOLDS = 10
CLASSES = 64
CORE = 2048
SIGNATURES = 512
ADDED = 0.1
ROUNDS = 6
#: Tokens that one block of texts aims at, and characters of a token and the space after it in ordinary text.
BLOCK_TOKENS, TOKEN_CHARS = 2_500_000, 6.5
#: Words of a slice whose counts of neighbours are laid out at once.
LAID_OUT = 16_384
#: Characters of text that are counted as one, whatever the size of Arrow batches.
COUNTED_CHARS = 24 << 20
MARKS = ".,;:!?\"'()[]{}#$%&*|<>-_/\\"


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only, and bytes.split() cuts at 0x20 and 0x09 to 0x0D only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def signature(word: bytes) -> int:
    text = word.decode("utf-8", "replace")
    bare = text.rstrip(MARKS)
    return zlib.crc32(f"{bare[-2:]}|{text[len(bare):][:1]}".encode()) % SIGNATURES


def _gathered(batches: Iterator[pa.RecordBatch], chars: int = COUNTED_CHARS) -> Iterator[list[str | None]]:
    """Texts of several batches together, so that a word is told once for many texts."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        held += texts
        size += sum(len(x) for x in texts if x)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held
    give_back()


def _count_frequent(share: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _gathered(batches):
            counts: Counter[bytes] = Counter()
            for text in texts:
                counts.update(words_of(text))
                counts[END] += 1
            total = counts.total()
            found = [(w, n) for w, n in counts.items() if n * share >= total or w == END]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64()), pa.array([total] * len(found), pa.int64())], names=["word", "n", "of"])

    return count


def frequent(texts: DataFrame, core: int = CORE) -> tuple[int, list[bytes]]:
    """The number of tokens of texts (text), and all words but the end that can make up ``1 / core`` of them.

    A batch tells the counts of words that are ``1 / share`` of it, so a word has at most its told
    count and ``1 / share`` of the other batches. With a share of 8 * core the words are 8 / 7 * core at most.
    """
    share = 8 * core
    told = checkpointed(texts.select("text").mapInArrow(_count_frequent(share), "word binary, n long, of long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("of").alias("of")))
    ends = told.where(F.col("word") == F.lit(END)).first()
    n = int(ends.of) if ends else 0
    found = told.where(((F.col("n") * share + n - F.col("of")) * core >= F.lit(n * share)) & (F.col("word") != F.lit(END)))
    return n, [bytes(r.word) for r in found.select("word").orderBy("word").collect()]


@dataclass
class Units:
    """Words to units: those of ``core`` their own, all others by signature."""

    core: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.core) + SIGNATURES

    def of(self, word: bytes) -> int:
        found = self.core.get(word)
        return len(self.core) + signature(word) if found is None else found

    def of_all(self, words: list[bytes]) -> np.ndarray:
        """``of`` each word. A signature is told by the last four bytes where these are ASCII and hold two characters before the marks."""
        core, tails, out = self.core, {}, []
        for word in words:
            unit = core.get(word)
            if unit is None:
                tail = word[-4:]
                unit = tails.get(tail)
                if unit is None:
                    unit = self.of(word)
                    if tail.isascii() and len(tail.decode().rstrip(MARKS)) >= 2:
                        tails[tail] = unit
            out.append(unit)
        return np.array(out, np.int64)

    def sequence(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct words (the end first), all tokens as numbers of them, and where each text's tokens start."""
        number: defaultdict[bytes, int] = defaultdict(None, {END: 0})
        number.default_factory = number.__len__
        flat: list[int] = []
        starts = []
        for text in texts:
            starts.append(len(flat))
            flat.extend(map(number.__getitem__, words_of(text)))
            flat.append(0)
        return list(number), np.array(flat, np.int64), np.array(starts, np.int64)


def _count_bigrams(units: Units):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = units.size
        for texts in _gathered(batches):
            distinct, flat, starts = units.sequence(texts)
            if not len(flat):
                continue
            unit = units.of_all(distinct)[flat]
            before = np.concatenate([[units.of(END)], unit[:-1]])
            code, n = np.unique(before * m + unit, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code // m, pa.int32()), pa.array(code % m, pa.int32()), pa.array(n, pa.int64())], names=["u", "v", "n"])

    return count


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """A class for each unit, from bigram counts [before, after]."""
    m = len(counts)
    total = counts.sum(axis=0)
    order = np.argsort(-total, kind="stable")
    cls = np.empty(m, np.int64)
    cls[order] = np.arange(m) % classes
    one = np.zeros((m, classes))
    one[np.arange(m), cls] = 1
    right, left = counts @ one, counts.T @ one  # of each unit: counts with each class after and before it
    n = one.T @ right
    for _ in range(rounds):
        moved = 0
        for w in order:
            if total[w] == 0:
                continue
            a, same = cls[w], counts[w, w]
            r, lft = right[w].copy(), left[w].copy()
            r[a] -= same
            lft[a] -= same
            n[a] -= r
            n[:, a] -= lft
            n[a, a] -= same
            rows, columns = n.sum(axis=1), n.sum(axis=0)
            base = _xlogx(n)
            up, down = _xlogx(n + r[None]) - base, _xlogx(n + lft[:, None]) - base
            d = np.arange(classes)
            gain = up.sum(axis=1) - up[d, d] + down.sum(axis=0) - down[d, d]
            gain += _xlogx(n[d, d] + r + lft + same) - base[d, d]
            out, into = r.sum() + same, lft.sum() + same
            gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(columns + into) - _xlogx(columns)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            n[b] += r
            n[:, b] += lft
            n[b, b] += same
            if b != a:
                moved += 1
                cls[w] = b
                right[:, a] -= counts[:, w]
                right[:, b] += counts[:, w]
                left[:, a] -= counts[w]
                left[:, b] += counts[w]
        if not moved:
            break
    return cls


@dataclass
class BrownModel:
    units: Units
    core_counts: np.ndarray  # of each core word
    cls: np.ndarray  # of each unit
    likely: np.ndarray  # [class before, or classes + class after; class]: log P of one such neighbour of a word of the class
    n_tokens: int

    @property
    def classes(self) -> int:
        return self.likely.shape[1]


def _log_transition(n: np.ndarray) -> np.ndarray:
    """Natural log of P(class | class before) with Witten-Bell smoothing, from class bigram counts."""
    of_class = n.sum(axis=0)
    prior = (of_class + 0.5) / (of_class.sum() + 0.5 * len(n))
    followers = np.maximum(1, (n > 0).sum(axis=1, keepdims=True))
    return np.log((n + followers * prior[None]) / (n.sum(axis=1, keepdims=True) + followers))


def fit(texts: DataFrame, classes: int = CLASSES, core: int = CORE) -> BrownModel:
    """Steps 1 to 3 on texts (text)."""
    if not 0 < classes <= 128:
        raise ValueError("a class and its side have one byte")
    n_tokens, words = frequent(texts, core)
    may = Units({END: 0} | {w: i + 1 for i, w in enumerate(words)})
    found = texts.select("text").mapInArrow(_count_bigrams(may), "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n")).toArrow()
    u, v, times = (found[c].to_numpy() for c in ("u", "v", "n"))
    total = np.zeros(may.size, np.int64)
    np.add.at(total, v, times)
    are = sorted((-int(total[i]), w) for w, i in may.core.items() if w != END and total[i] * core >= n_tokens)
    units = Units({END: 0} | {w: i + 1 for i, (_, w) in enumerate(are)})
    core_counts = np.array([int(total[0])] + [-k for k, _ in are], np.int64)
    m = units.size
    # words that aren't frequent after all go to their signatures
    to = np.array([units.of(w) for w in may.core] + [len(units.core) + i for i in range(SIGNATURES)], np.int64)
    counts = np.zeros((m, m))
    np.add.at(counts, (to[u], to[v]), times)
    cls = exchange(counts, classes)
    one = np.zeros((m, classes))
    one[np.arange(m), cls] = 1
    n = one.T @ counts @ one
    step = _log_transition(n)
    # a word of class c has log P(c | before) + log P(after | c) - log N_c for each token, up to what all classes share
    likely = np.concatenate([step - np.log(n.sum(axis=0) + 1)[None], step.T])
    return BrownModel(units, core_counts, cls, likely, n_tokens)


CODED = "block long, slice int, ids array<long>, marks binary, lengths binary, data binary, more binary, near binary"
_TYPES = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(np.uint8).tobytes())


def _bytes_of(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def _block_rows(block: int, ids: list, out: list[bool], texts: list[str | None], model: BrownModel, slices: int) -> pa.RecordBatch:
    units, core = model.units, len(model.units.core)
    distinct, flat, starts = units.sequence(texts)
    length = np.diff(np.append(starts, len(flat)))
    unit = units.of_all(distinct)
    order = np.argsort(-np.bincount(flat, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # of each word, by rank: its unit if it is a core word, else its slice after those
    of = unit[order]
    rare = np.flatnonzero(of >= core)
    names = [distinct[i] for i in order[rare].tolist()]
    of[rare] = core + np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % slices
    rows = [(block, blocks.TEXTS, ids, np.array(out, np.uint8).tobytes(), blocks.pack(length), blocks.pack(rank[flat]), blocks.pack(of), None)]
    sent = np.argsort(of[rare], kind="stable")  # the words in the order in which slices get them
    place = np.full(len(distinct), -1, np.int64)
    place[order[rare[sent]]] = np.arange(len(sent))
    own = place[flat]
    # never the last token, which is an end; the first one comes after an end, as the last one is
    at = np.flatnonzero((own >= 0) & np.repeat(~np.array(out, bool), length))
    at = at[np.argsort(own[at], kind="stable")]
    c = model.cls[unit].astype(np.uint8)[flat]
    before, after = c[at - 1], c[np.minimum(at + 1, len(c) - 1)]
    times = np.bincount(own[at], minlength=len(sent))
    until = np.concatenate([[0], np.cumsum(times)])
    found, begins = np.unique(of[rare[sent]], return_index=True)
    for s, a, b in zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(sent)], strict=True):
        near = slice(until[a], until[b])
        rows.append((block, s - core, None, None, *blocks.pack_bytes([names[i] for i in sent[a:b].tolist()]), blocks.pack(times[a:b]), _squeezed(np.concatenate([before[near], after[near]]))))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[x.split()[0] for x in CODED.split(", ")])


def _coded(docs: DataFrame, shared, slices: int, chars: int) -> DataFrame:
    """Blocks of docs (doc_id, text, out) and the words that they send, dealt out by block. out: nothing is learned from the text.

    slice ``TEXTS`` marks a block's texts: ids, marks (out), lengths, data (each token's word) and more (each word's unit, or its
    slice). Other slices mark the words sent to them: lengths and data (the words), more (training tokens of each) and near (the
    classes before and then those after each of these).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for x, y in zip(held, row, strict=True):
                    x.append(y)
                size += len(row[2] or "")
                if size >= chars:
                    yield _block_rows(block, *held, shared.value, slices)
                    held, size, block = ([], [], []), 0, block + 1
        if held[0]:
            yield _block_rows(block, *held, shared.value, slices)
        held = ([], [], [])
        give_back()

    return docs.select("doc_id", "out", "text").mapInArrow(cut, CODED).repartition("block")


def _slices(batches: Iterator[pa.RecordBatch], model: BrownModel) -> Iterator[tuple]:
    """Of each slice: its number, words, training tokens and class of each, and who sent which of them: [(block, words)].

    A word without training tokens has the class of its signature.
    """
    classes, sides = model.classes, len(model.likely)
    number: defaultdict[bytes, int] = defaultdict()
    senders: list[tuple[int, np.ndarray]] = []
    tokens: list[tuple[np.ndarray, np.ndarray]] = []

    def told(s: int) -> tuple:
        word = np.concatenate([x for x, _ in tokens])
        near = np.concatenate([x for _, x in tokens], axis=1)
        order = np.argsort(word, kind="stable")
        word, near = word[order], near[:, order]
        n = np.bincount(word, minlength=len(number))
        until = np.concatenate([[0], np.cumsum(n)])
        cls = np.empty(len(number), np.int64)
        for a in range(0, len(n), LAID_OUT):
            b = min(a + LAID_OUT, len(n))
            at = slice(until[a], until[b])
            cell = (word[at].astype(np.int64) - a) * sides
            cells = np.bincount(cell + near[0, at], minlength=(b - a) * sides) + np.bincount(cell + classes + near[1, at], minlength=(b - a) * sides)
            cls[a:b] = np.round(cells.reshape(-1, sides).astype(np.float64) @ model.likely, 9).argmax(axis=1)
        words = list(number)
        new = np.flatnonzero(n == 0)
        cls[new] = model.cls[model.units.of_all([words[i] for i in new.tolist()])]
        return s, words, n, cls, senders

    now = None
    for block, s, lengths, data, more, near in blocks.by_slice(batches, "lengths", "data", "more", "near"):
        if s != now:
            if senders:
                yield told(now)
            now, number, senders, tokens = s, defaultdict(), [], []
            number.default_factory = number.__len__
        words = blocks.unpack_bytes(lengths, data)
        own = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
        senders.append((block, own))
        tokens.append((np.repeat(own, blocks.unpack(more)), _bytes_of(near).reshape(2, -1)))
    if senders:
        yield told(now)
    give_back()


def assign(texts: DataFrame, shared) -> DataFrame:
    """word, n, cls of every word of texts (text) that isn't a core word; shared: the broadcast model of ``fit``."""
    small_batches(texts.sparkSession)
    docs = texts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("out"), "text")

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, n, cls, _ in _slices(batches, shared.value):
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(cls, pa.int32())], names=["word", "n", "cls"])

    rows = _coded(docs, shared, blocks.slices_for(docs), round(BLOCK_TOKENS * TOKEN_CHARS))
    return blocks.words_sent(rows, "near").mapInArrow(classed, "word binary, n long, cls int")


#: Stands for the block of an answer that tells of a slice's words as a whole, and for n_tokens of their row.
NONE = -1


def _answered(shared) -> object:
    """To each block the counts and classes of the words it sent, in that order; to ``NONE`` how many trained words each class has."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _, n, cls, senders in _slices(batches, shared.value):
            rows = [(block, s, blocks.pack(n[own]), _squeezed(cls[own])) for block, own in senders]
            rows.append((NONE, s, blocks.pack(np.bincount(cls[n > 0], minlength=shared.value.classes)), b""))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "slice", "n", "cls"])

    return answer


ROWS = "doc_id long, held_out boolean, n_tokens long, n_known long, lexical double, classes binary"
_ROWS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("lexical", pa.float64()), ("classes", pa.binary())])


def _classed(shared) -> object:
    """cogroup function: a block's rows and the answers to it, to n_tokens, n_known, lexical score and the tokens' classes of each text."""

    def classed(rows: pa.Table, answers: pa.Table) -> pa.Table:
        model = shared.value
        got = sorted(zip(answers["slice"].to_pylist(), answers["n"].to_pylist(), answers["cls"].to_pylist(), strict=True))
        if not len(rows):
            distinct = sum(blocks.unpack(n).astype(np.int64) for _, n, _ in got)
            return pa.Table.from_pylist([{"n_tokens": NONE, "classes": distinct.astype("<i8").tobytes()}], schema=_ROWS)
        (row,) = rows.filter(pc.equal(rows["slice"], blocks.TEXTS)).to_pylist()
        codes, length, of = blocks.unpack(row["data"]), blocks.unpack(row["lengths"]).astype(np.int64), blocks.unpack(row["more"])
        core = of < len(model.units.core)
        rare = np.flatnonzero(~core)
        rare = rare[np.argsort(of[rare], kind="stable")]
        n, c = np.zeros(len(of)), np.zeros(len(of), np.uint8)
        n[core], c[core] = model.core_counts[of[core]], model.cls[of[core]]
        if got:
            told = np.concatenate([blocks.unpack(x) for _, x, _ in got])
            if len(told) != len(rare):
                raise ValueError("a block has changed since its words were sent: docs must be a table, or checkpointed")
            n[rare], c[rare] = told, np.concatenate([_bytes_of(x) for _, _, x in got])
        ends = np.cumsum(length)
        starts = ends - length
        total = lambda x: np.add.reduceat(x[codes], starts)
        code = c[codes].tobytes()
        out = [row["ids"], np.frombuffer(row["marks"], np.uint8).astype(bool), length, total((n > 0).astype(np.int64)), total(np.log10(n + ADDED)), [code[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]]
        give_back()
        return pa.table([pa.array(x, f.type) for x, f in zip(out, _ROWS, strict=True)], schema=_ROWS)

    return classed


def _bigram_codes(column: pa.Array, end: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """class before * classes + class of all tokens, and where each text's tokens start; texts end with an end."""
    c = np.frombuffer(b"".join(column.to_pylist()), np.uint8).astype(np.int64)
    lengths = pc.binary_length(column).to_numpy()
    return np.concatenate([[end], c[:-1]]) * classes + c, np.cumsum(lengths) - lengths


def score_documents(docs: DataFrame, classes: int = CLASSES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    # the number makes sure of the rows' order
    docs = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row").select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("out"), "text")
    model = fit(docs.where(~F.col("out")), classes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most CORE words and a few tables of fixed size
    rows = _coded(docs, shared, blocks.slices_for(docs), round(block_tokens * TOKEN_CHARS))
    answers = blocks.words_sent(rows, "near").mapInArrow(_answered(shared), "block long, slice int, n binary, cls binary")
    told = checkpointed(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_classed(shared), ROWS))
    met = told.where(F.col("n_tokens") != NONE)
    end = int(model.cls[0])

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_bigram_codes(batch.column(0), end, classes)[0], minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    found = met.where(~F.col("held_out")).select("classes").mapInArrow(bigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(classes * classes)
    n[found["code"].to_numpy()] = found["n"].to_numpy()
    n = n.reshape(classes, classes)
    # distinct words of each class
    distinct = np.bincount(model.cls[: len(model.units.core)][model.core_counts > 0], minlength=classes).astype(np.float64)
    for r in told.where(F.col("n_tokens") == NONE).select("classes").collect():  # one row
        distinct += np.frombuffer(r.classes, "<i8")
    base = np.log10(model.n_tokens + ADDED * (distinct.sum() + 1))
    table_ = (_log_transition(n) / np.log(10) - np.log10(n.sum(axis=0) + ADDED * (distinct + 1))[None]).ravel()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, starts = _bigram_codes(batch.column("classes"), end, classes)
                lexical = batch.column("lexical").to_numpy()
                columns = ["doc_id", "held_out", "n_tokens", "n_known"]
                scores = [pa.array(lexical - base * batch.column("n_tokens").to_numpy()), pa.array(lexical + np.add.reduceat(table_[code], starts))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *scores], names=[*columns, "base_score", "score"])

    scored = met.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity by held_out, of the model and of the unigram base."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op8_brown_lm": op8_brown_lm}
