"""Toxicity by a convolutional text classifier, trained in numpy.

Words are lower-cased, freed of marks at both ends and hashed twice: as a whole and by their first
``PREFIX`` letters. Each hash that enough sample documents have selects an embedding (the bucket
keeps 16 more bits of the hash, so another word rarely takes the same one); all other words share
one. Filters of widths 1, 2 and 3 run over the whole text; the maximum of each over the text goes
into a logistic output. Thresholds are calibrated by language, as predicted from the text by the
centroids of ``language``: the score is the logistic of the distance to the language's threshold.

Only the fit uses a sample: about ``per_class`` texts of each label; of texts longer than
``max_fit_chars`` characters it reads a window of that length at a drawn place. Scores read every whole text.

Defined results: null and empty texts are scored as texts without a word; repeated rows give
repeated scores; a document labelled twice counts as toxic if any label says so; null labels are
no labels. Without both labels in the sample every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language
from .common import Query, fit_window, give_back, held_out, small_batches, stratified, table

PREFIX = 4
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
BUCKET_BITS = 20
MIN_DOCUMENTS = 3
PER_CLASS = 3000
MAX_FIT_CHARS = 10_000
FOLDS = 5
#: Marks stripped from both ends of a word.
MARKS = ".,;:!?\"'()[]{}#$%&*|<>-_/\\«»“”‘’¡¿…"
#: Words between two texts, so that no filter sees both.
GAP = max(WIDTHS) - 1


def words_of(text: str | None) -> list[str]:
    return [w for w in (x.strip(MARKS) for x in (text or "").lower().split()) if w]


class Features:
    """From a word to its two embedding rows; row 0 is that of all other words."""

    def __init__(self, bits: int = BUCKET_BITS):
        self.bits = bits
        self.row = np.zeros(1 << bits, np.int32)
        self.print = np.zeros(1 << bits, np.uint16)
        self.size = 1

    def _keys(self, word: str) -> tuple[int, int]:
        whole = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        start = xxhash.xxh64_intdigest(word[:PREFIX].encode("utf-8", "surrogatepass"), seed=1) if len(word) > PREFIX else 0
        return whole, start

    def fit(self, documents: list[list[str]], at_least: int) -> None:
        seen: dict[int, int] = {}
        for words in documents:
            for key in {k for w in set(words) for k in self._keys(w) if k}:
                seen[key] = seen.get(key, 0) + 1
        for key, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
            bucket = key & ((1 << self.bits) - 1)
            if n >= at_least and not self.row[bucket]:
                self.row[bucket], self.print[bucket] = self.size, key >> 48
                self.size += 1

    def rows(self, words: list[str]) -> np.ndarray:
        keys = np.array([self._keys(w) for w in words], np.uint64).reshape(-1, 2)
        bucket = (keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return np.where(self.print[bucket] == (keys >> np.uint64(48)).astype(np.uint16), self.row[bucket], 0)


def _sequence(documents: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, and the documents as one sequence of word numbers with a gap after each; where each starts."""
    number: dict[str, int] = {"": 0}
    flat: list[int] = []
    starts = []
    for words in documents:
        starts.append(len(flat))
        flat += [number.setdefault(w, len(number)) for w in words]
        flat += [0] * (GAP + 1)
    flat += [0] * GAP
    return list(number), np.array(flat, np.int64), np.array(starts, np.int64)


@dataclass
class ToxicityModel:
    features: Features
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    language: language.LanguageModel | None = None
    threshold: dict[str, float] = field(default_factory=dict)

    def _forward(self, documents: list[list[str]], keep: bool = False):
        w = self.weights
        distinct, flat, starts = _sequence(documents)
        rows = self.features.rows(distinct)
        rows[0] = 0
        e = np.concatenate([w["whole"][rows[:, 0]], w["start"][rows[:, 1]]], axis=1)
        e[0] = 0  # the gap
        length = len(flat) - GAP
        pooled, argmax = [], []
        for width in WIDTHS:
            z = np.zeros((length, FILTERS), np.float32)
            for d in range(width):
                z += (e @ w[f"conv{width}"][d])[flat[d : d + length]]
            pooled.append(np.maximum.reduceat(z, starts, axis=0))
            if keep:
                ends = np.append(starts[1:], length)
                argmax.append(np.stack([a + np.argmax(z[a:b], axis=0) for a, b in zip(starts, ends, strict=True)]))
        z = np.concatenate(pooled, axis=1) + w["bias"]
        h = np.maximum(z, 0)
        logit = h @ w["out"] + w["out_bias"][0]
        return (logit, h, z, argmax, flat, rows, e) if keep else logit

    def train(self, documents: list[list[str]], y: np.ndarray, epochs: int = 5, batch: int = 48, rate: float = 0.02, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        n, f = self.features.size, FILTERS * len(WIDTHS)
        w = self.weights = {
            "whole": rng.normal(0, 0.1, (n, DIM)).astype(np.float32), "start": rng.normal(0, 0.1, (n, DIM)).astype(np.float32),
            "bias": np.zeros(f, np.float32), "out": rng.normal(0.3, 0.1, f).astype(np.float32) * np.resize([1, -1], f).astype(np.float32), "out_bias": np.zeros(1, np.float32),
        } | {f"conv{k}": rng.normal(0, 0.3, (k, 2 * DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(documents))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                logit, h, z, argmax, flat, rows, e = self._forward([documents[i] for i in some], keep=True)
                delta = ((1 / (1 + np.exp(-logit)) - y[some]) / len(some)).astype(np.float32)
                g = {"out": h.T @ delta, "out_bias": np.array([delta.sum()], np.float32)}
                dz = delta[:, None] * w["out"][None] * (z > 0)
                g["bias"] = dz.sum(axis=0)
                de = np.zeros_like(e)
                for j, width in enumerate(WIDTHS):
                    d = dz[:, j * FILTERS : (j + 1) * FILTERS]
                    g[f"conv{width}"] = np.zeros_like(w[f"conv{width}"])
                    for k in range(width):
                        ids = flat[argmax[j] + k]
                        for x in range(FILTERS):
                            g[f"conv{width}"][k][:, x] += e[ids[:, x]].T @ d[:, x]
                            np.add.at(de, ids[:, x], d[:, x : x + 1] * w[f"conv{width}"][k][:, x][None])
                de[0] = 0
                g["whole"], g["start"] = np.zeros_like(w["whole"]), np.zeros_like(w["start"])
                np.add.at(g["whole"], rows[:, 0], de[:, :DIM])
                np.add.at(g["start"], rows[:, 1], de[:, DIM:])
                step += 1
                lr = rate * (1 - epoch / (epochs + 1))
                for k, grad in g.items():
                    m, v = moment[k]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    w[k] -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + (lr * 1e-4) * w[k]).astype(np.float32)

    def calibrate(self, texts: list[str | None], logits: np.ndarray, y: np.ndarray, at_least: int = 20) -> None:
        """A threshold for each language that has enough rows of both labels, and one for all others."""
        self.threshold = {"": _best_threshold(logits, y)}
        if self.language is None:
            return
        names = np.array(self.language.predict(texts)[0], object)
        for name in sorted(set(names)):
            own = names == name
            if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= at_least:
                self.threshold[name] = _best_threshold(logits[own], y[own])

    def score(self, texts: list[str | None], chars: int = 500_000) -> np.ndarray:
        """0 to 1; 0.5 is the threshold of the text's language."""
        if not self.weights:
            return np.zeros(len(texts))
        logits, block, size = [], [], 0
        for text in texts:
            block.append(words_of(text))
            size += len(text or "")
            if size >= chars:
                logits.append(self._forward(block))
                block, size = [], 0
        if block:
            logits.append(self._forward(block))
        logit = np.concatenate(logits) if logits else np.zeros(0)
        if self.language is not None and len(self.threshold) > 1:
            names = self.language.predict(texts)[0]
            logit = logit - np.array([self.threshold.get(x, self.threshold[""]) for x in names])
        else:
            logit = logit - self.threshold.get("", 0.0)
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def _best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """Between the labels where the sum of both error rates is least; the middle of the widest such gap."""
    order = np.argsort(logits, kind="stable")
    x, t = logits[order].astype(float), y[order]
    missed = np.concatenate([[0], np.cumsum(t == 1)]) / max(1, (t == 1).sum())
    wrong = ((t == 0).sum() - np.concatenate([[0], np.cumsum(t == 0)])) / max(1, (t == 0).sum())
    cost = missed + wrong
    edges = np.concatenate([[x[0] - 2], x, [x[-1] + 2]])
    gaps = [(edges[i + 1] - edges[i], i) for i in np.flatnonzero(cost <= cost.min() + 1e-12)]
    _, i = max(gaps)
    return float((edges[i] + edges[i + 1]) / 2)


def fit(texts: list[str | None], labels: list[int], lang: language.LanguageModel | None = None, seed: int = 11, at_least: int = MIN_DOCUMENTS) -> ToxicityModel:
    """Train on four fifths of the rows, calibrate on the rest."""
    order = sorted(range(len(texts)), key=lambda i: xxhash.xxh64_intdigest((texts[i] or "").encode("utf-8", "surrogatepass")))
    one: dict[str, str] = {}  # one object for each word, however often it stands in the sample
    documents, y = [[one.setdefault(w, w) for w in words_of(texts[i])] for i in order], np.array([labels[i] for i in order], np.float32)
    model = ToxicityModel(Features(), language=lang)
    if len(set(labels)) < 2:
        return model
    rest = np.arange(len(order)) % 5 == 0
    own = np.flatnonzero(~rest) if 0 < (y[rest] == 1).sum() < rest.sum() and len(set(y[~rest])) == 2 else np.arange(len(order))
    model.features.fit([documents[i] for i in own], at_least)
    model.train([documents[i] for i in own], y[own], seed=seed)
    probe = np.flatnonzero(rest) if len(own) < len(order) else own
    logits = np.concatenate([model._forward(documents_) for documents_ in _blocks([documents[i] for i in probe])])
    model.calibrate([texts[order[i]] for i in probe], logits, y[probe])
    return model


def _blocks(documents: list[list[str]], n: int = 256) -> list[list[list[str]]]:
    return [documents[i : i + n] for i in range(0, len(documents), n)]


def fit_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_fit_chars: int = MAX_FIT_CHARS) -> ToxicityModel:
    """Fit on docs (doc_id, text, lang) and labels (doc_id, toxic) that may be learned from."""
    known = labels.where(~held_out(F.col("doc_id"), FOLDS) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most about 2 * per_class ids, so they may be broadcast; the texts of other documents aren't moved
    picked = stratified(known, "toxic", per_class, ["doc_id"], "toxicity", values=2)
    window = fit_window(F.col("text"), F.col("doc_id"), max_fit_chars)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min(window).alias("text")).select("text", "toxic").collect()
    lang = language.fit_documents(docs)
    return fit([r.text for r in rows], [int(r.toxic) for r in rows], lang)


def score_column(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        scores = pa.array(shared.value.score(texts.to_pylist()), pa.float64())
        give_back()
        return scores

    return scored(text)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), score_column(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES: dict[str, Query] = {"op4_toxicity": op4_toxicity}
