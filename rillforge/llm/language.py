"""Language identification by nearest centroids.

A text is a vector of hashed character bigrams and trigrams of its lower-cased letters (other
characters count as one space), weighted ``log(1 + tf) * idf`` and normalised. Each language has
several centroids, found by spherical k-means over its sample; the nearest by cosine decides. A
text whose cosine distance to the nearest centroid is greater than the rejection limit of that
language (a quantile of its sample's own distances, with a margin) is marked as rejected.

Only the fit uses a sample: about ``per_language`` texts of each of the 256 commonest languages; of texts
longer than ``max_fit_chars`` characters it reads a window of that length at a drawn place. Predictions
read every whole text.

Defined results: null texts and texts without a letter get ``und`` and score 0; repeated rows give
repeated results; without any labelled row every text gets ``und``. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Query, fit_window, held_out, small_batches, stratified, table

UNDETERMINED = "und"
DIMENSIONS = 1 << 13
CENTROIDS = 6
PER_LANGUAGE = 400
MAX_FIT_CHARS = 10_000
FOLDS = 5


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_ids(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed bigrams and trigrams of a text; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32).astype(np.uint32)
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1]
    points = np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]]).astype(np.uint32)
    shift = np.uint32(32 - (dimensions.bit_length() - 1))
    pairs = (points[:-1] * np.uint32(0x9E3779B1)) ^ (points[1:] * np.uint32(0x85EBCA6B))
    triples = (pairs[:-1] * np.uint32(0xC2B2AE35)) ^ (points[2:] * np.uint32(0x27D4EB2F))
    mix = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
    return np.concatenate([mix(pairs), mix(triples)]).astype(np.int64)


def counts(texts: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """log(1 + count) of each gram of each text, and which texts have a letter."""
    out = np.zeros((len(texts), dimensions), np.float32)
    known = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        ids = gram_ids(text or "", dimensions)
        if len(ids):
            known[i] = True
            out[i] = np.bincount(ids, minlength=dimensions)
    return np.log1p(out, out=out), known


def _normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of the rows of x, which have length 1."""
    k = min(k, len(x))
    chosen = [int(rng.integers(len(x)))]
    best = x @ x[chosen[0]]
    for _ in range(k - 1):  # the row farthest from those chosen
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    centroids = x[chosen]
    for _ in range(rounds):
        nearest = np.argmax(x @ centroids.T, axis=1)
        centroids = np.stack([x[nearest == j].mean(axis=0) if (nearest == j).any() else centroids[j] for j in range(k)])
        centroids = _normalised(centroids)
    return centroids.astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # index into languages of each centroid
    limit: np.ndarray  # lowest cosine of each language that isn't rejected
    idf: np.ndarray

    def predict(self, texts: list[str | None], block: int = 128) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to its nearest centroid and rejection of each text."""
        names: list[str] = []
        scores, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(texts), block):
            x, known = counts(texts[at : at + block], len(self.idf))
            if not len(self.owner):
                names += [UNDETERMINED] * len(known)
                continue
            cosine = _normalised(x * self.idf) @ self.centroids.T
            nearest = np.argmax(cosine, axis=1)
            value = cosine[np.arange(len(nearest)), nearest]
            language = self.owner[nearest]
            names += [self.languages[j] if ok else UNDETERMINED for j, ok in zip(language, known, strict=True)]
            scores[at : at + block] = np.where(known, np.clip(value, 0, 1), 0)
            rejected[at : at + block] = ~known | (value < self.limit[language])
        return names, scores, rejected


def fit(texts: list[str], languages: list[str], centroids: int = CENTROIDS, dimensions: int = DIMENSIONS, seed: int = 7) -> LanguageModel:
    order = sorted(range(len(texts)), key=lambda i: (languages[i], texts[i]))
    x, known = counts([texts[i] for i in order], dimensions)
    labels = np.array([languages[i] for i in order], object)
    x, labels = x[known], labels[known]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    x = _normalised(x * idf)
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    parts, owner, limit = [], [], []
    for j, name in enumerate(names):
        own = x[labels == name]
        found = _k_means(own, centroids, rng)
        parts.append(found)
        owner += [j] * len(found)
        limit.append(0.5 * float(np.quantile((own @ found.T).max(axis=1), 0.01)))
    return LanguageModel(names, np.concatenate(parts) if parts else np.zeros((0, dimensions), np.float32), np.array(owner, int), np.array(limit), idf)


def fit_documents(docs: DataFrame, per_language: int = PER_LANGUAGE, max_fit_chars: int = MAX_FIT_CHARS) -> LanguageModel:
    """Fit on the documents that may be learned from (doc_id, text, lang)."""
    usable = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"), FOLDS) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a row repeated with several languages is learned with the first by name
    drawn = stratified(usable, "lang", per_language, ["doc_id", "text"], "language").groupBy("doc_id", F.xxhash64("text").alias("h"), fit_window(F.col("text"), F.col("doc_id"), max_fit_chars).alias("text"))
    rows = drawn.agg(F.min("lang").alias("lang")).select("text", "lang").collect()
    return fit([r.text for r in rows], [r.lang for r in rows])


def predict_column(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct<lang_pred, score, rejected> of a text column."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: pa.Array) -> pa.Array:
        names, scores, rejected = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=["lang_pred", "score", "rejected"])

    return predicted(text)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_documents(docs)
    return docs.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), predict_column(spark, model, F.col("text")).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected"
    )


QUERIES: dict[str, Query] = {"op3_language_id": op3_language_id}
