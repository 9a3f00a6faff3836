"""Quality by co-training two views of a document.

The text view counts pairs of character classes, hashed letter bigrams and trigrams and the share
of distinct words. The metadata view knows the page's language, source, length and layout (lines,
line lengths, shares of capitals, digits, marks and spaces). Both are logistic regressions. Starting
from labelled rows, each round fits both; each then labels the unlabelled rows that it is surest of
and hands them to the other. At the end both are calibrated on labelled rows that neither has seen,
and the score is the logistic of the mean of their calibrated log-odds.

Only the fit uses samples: about ``per_class`` labelled rows of each label and ``pool`` unlabelled
ones, in expectation; of longer texts it reads a window of ``max_fit_chars`` characters at a drawn place.
Scores read every whole text.

Defined results: null text counts as empty, null language and source as values of their own;
repeated rows give repeated scores; without both labels every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language
from .common import Query, fit_window, give_back, held_out, small_batches, stratified, table, uniform

PER_CLASS = 1500
POOL = 2500
ROUNDS = 4
EXCHANGED = 120
MAX_FIT_CHARS = 10_000
FOLDS = 5
GRAMS = 1 << 12
HASHED = 256

#: Classes of code points below 128: 32 to 47, 58 to 64, 91 to 96 and 123 to 126 each their own.
_ASCII = np.zeros(128, np.int64)
_own = [i for i in range(32, 127) if not chr(i).isalnum()]
for _i in range(128):
    _ASCII[_i] = 1 if chr(_i).islower() else 2 if chr(_i).isupper() else 3 if chr(_i).isdigit() else 4 if chr(_i) == "\n" else 6 + _own.index(_i) if _i in _own else 5
CLASSES = 6 + len(_own) + 2  # and letters and others beyond


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < 128
    letter = language._letters()[points]
    return np.where(low, _ASCII[np.where(low, points, 0)], np.where(letter, CLASSES - 2, CLASSES - 1))


def text_view(texts: list[str]) -> np.ndarray:
    n_pairs = CLASSES * CLASSES
    out = np.zeros((len(texts), n_pairs + GRAMS + 16), np.float32)
    for i, text in enumerate(texts):
        c = _classes(text)
        if len(c) > 1:
            pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=n_pairs)
            out[i, :n_pairs] = np.sqrt(pairs / len(c))
        ids = language.gram_ids(text, GRAMS)
        if len(ids):
            grams = np.sqrt(np.bincount(ids, minlength=GRAMS).astype(np.float32))
            out[i, n_pairs : n_pairs + GRAMS] = grams / np.linalg.norm(grams)
        words = text.split()
        out[i, n_pairs + GRAMS + min(14, int(15 * len(set(words)) / len(words))) if words else -1] = 1
    return out


def _hashed(kind: str, value: str | None) -> int:
    return xxhash.xxh32_intdigest(f"{kind}={value!r}".encode("utf-8", "surrogatepass")) % HASHED


def metadata_view(texts: list[str], langs: list[str | None], sources: list[str | None]) -> np.ndarray:
    names = ["chars", "lines", "line", "longest", "capitals", "digits", "marks", "spaces"]
    steps = 24
    out = np.zeros((len(texts), HASHED + len(names) * steps), np.float32)
    for i, (text, lang, source) in enumerate(zip(texts, langs, sources, strict=True)):
        out[i, _hashed("lang", lang)] = 1
        out[i, _hashed("source", source)] = 1
        n, share = len(text), np.bincount(_classes(text), minlength=CLASSES) / max(1, len(text))
        lines = [len(x) for x in text.split("\n")]
        logs = [np.log2(1 + x) for x in (n, len(lines), n / len(lines), max(lines))]
        shares = [share[2], share[3], share[7 : CLASSES - 1].sum(), share[6]]
        for j, x in enumerate([*logs, *(np.log2(1 + 500 * s) for s in shares)]):
            out[i, HASHED + j * steps + min(steps - 1, int(x))] = 1
    return out


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150, rate: float = 0.1) -> Logistic:
    """Full-batch Adam; both labels weigh the same."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, steps + 1):
        d = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
        g = np.append(x.T @ d.astype(np.float32) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return Logistic(w, float(b))


def _calibrate(model: Logistic, x: np.ndarray, y: np.ndarray) -> Logistic:
    """Platt scaling, labels smoothed by their counts."""
    raw = model.raw(x).astype(float)[:, None]
    scale = max(1e-6, float(np.abs(raw).mean()))
    found = fit_logistic((raw / scale).astype(np.float32), y, l2=1e-3, steps=300)
    return Logistic(model.weights, model.bias, max(1e-3, float(found.weights[0])) / scale, found.bias)


@dataclass
class QualityModel:
    text: Logistic | None = None
    metadata: Logistic | None = None

    def score(self, texts: list[str | None], langs: list[str | None], sources: list[str | None], block: int = 128) -> np.ndarray:
        """Columns: combined score, text view's, metadata view's."""
        out = np.full((len(texts), 3), 0.5)
        if self.text is None or self.metadata is None:
            return out
        for at in range(0, len(texts), block):
            part = slice(at, at + block)
            some = [x or "" for x in texts[part]]
            a, b = self.text.log_odds(text_view(some)), self.metadata.log_odds(metadata_view(some, langs[part], sources[part]))
            odds = np.stack([(a + b) / 2, a, b], axis=1).astype(float)
            out[part] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        give_back()
        return out


def co_train(labelled: list[tuple], y: np.ndarray, pool: list[tuple], rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> QualityModel:
    """labelled, pool: rows (text, lang, source)."""
    if len(set(y.tolist())) < 2:
        return QualityModel()
    views = lambda rows: (text_view([r[0] or "" for r in rows]), metadata_view([r[0] or "" for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
    known, free = views(labelled), views(pool)
    probe = np.arange(len(y)) % 5 == 0
    if len(set(y[probe].tolist())) < 2 or len(set(y[~probe].tolist())) < 2:
        probe = np.zeros(len(y), bool)
    train, check = ~probe, probe if probe.any() else np.ones(len(y), bool)
    given: list[dict[int, int]] = [{}, {}]  # what each view has been handed: row of the pool to label
    models: list[Logistic] = []
    for turn in range(rounds + 1):
        models = []
        for view in (0, 1):
            ids = list(given[view])
            x = np.concatenate([known[view][train], free[view][ids]]) if ids else known[view][train]
            models.append(fit_logistic(x, np.concatenate([y[train], np.array([given[view][i] for i in ids], float)]) if ids else y[train]))
        if turn == rounds or not pool:
            break
        prior = float(y[train].mean())
        for view in (0, 1):
            odds = models[view].raw(free[view])
            order = np.argsort(odds, kind="stable")
            n_low, n_high = max(1, round(exchanged * (1 - prior))), max(1, round(exchanged * prior))
            fresh = [i for i in order if i not in given[1 - view]]
            for i in fresh[:n_low]:
                if odds[i] < -1:
                    given[1 - view][int(i)] = 0
            for i in fresh[::-1][:n_high]:
                if odds[i] > 1:
                    given[1 - view][int(i)] = 1
    return QualityModel(*(_calibrate(models[view], known[view][check], y[check]) for view in (0, 1)))


def fit_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, pool: int = POOL, max_fit_chars: int = MAX_FIT_CHARS) -> QualityModel:
    """Fit on docs (doc_id, text, lang, source) and labels (doc_id, quality) that may be learned from."""
    may = ~held_out(F.col("doc_id"), FOLDS)
    known = labels.where(may & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    short = docs.where(may).select("doc_id", "text", "lang", "source")
    window = fit_window(F.col("text"), F.col("doc_id"), max_fit_chars).alias("text")
    # at most about 2 * per_class ids, so they may be broadcast
    picked = F.broadcast(stratified(known, "quality", per_class, ["doc_id"], "quality", values=2))
    first = lambda df, *by: df.groupBy("doc_id", *by).agg(F.min(F.struct(window, "lang", "source")).alias("d")).select(*by, "d.*", "doc_id")
    rows = first(short.join(picked, "doc_id"), "quality").collect()
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r.doc_id)))
    n = short.select("doc_id").count()
    share = min(1.0, pool / max(1, n))
    free = first(short.where(uniform(F.lit("pool"), F.col("doc_id")) < share)).collect()
    taken = {r.doc_id for r in rows}
    free = sorted((r for r in free if r.doc_id not in taken), key=lambda r: xxhash.xxh64_intdigest(str(r.doc_id)))
    return co_train([(r.text, r.lang, r.source) for r in rows], np.array([int(r.quality) for r in rows], float), [(r.text, r.lang, r.source) for r in free])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    shared = spark.sparkContext.broadcast(fit_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))

    @F.arrow_udf("score double, text_score double, metadata_score double")
    def scored(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.Array:
        x = shared.value.score(texts.to_pylist(), langs.to_pylist(), sources.to_pylist())
        return pa.StructArray.from_arrays([pa.array(x[:, j]) for j in range(3)], names=["score", "text_score", "metadata_score"])

    out = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), scored("text", "lang", "source").alias("s"))
    return out.select("doc_id", "held_out", "s.*").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES: dict[str, Query] = {"op10_quality_classifier": op10_quality_classifier}
