"""Quality classifier (2): supervised subword embeddings.

Words and character n-grams (over UTF-8 bytes) are hashed to buckets, each with
a learned vector; a document is the mean of the vectors of all its features, and
a softmax layer gives the classes. Embeddings and softmax are trained together
by stochastic gradient descent in numpy on a bounded sample of labelled rows.

At scoring time the mean of vectors times the softmax weights equals the mean of
one number for each bucket, so workers get one float table and score whole
texts with vectorised lookups.

Defined cases. Null or empty text: scored by the bias alone. Null or other
labels: not learned from. Repeated label rows and repeated rows of an id count as often as they occur, within the bound. With
no label of a class the score is the share of label 1 (0.5 without any labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .textops import U64, Words, buffer_of, mix64, sliced

BUCKET_BITS = 18
#: The rate of the vectors, times that of the softmax weights: a bucket is a small part of its documents' means.
VECTOR_RATE = 10.0


@dataclass(frozen=True)
class Training:
    """most_rows bounds the labelled rows that are learned from; they are those with the smallest hash of their id."""

    most_rows: int = 6000
    dimensions: int = 8
    epochs: int = 5
    rate: float = 1.5
    grams: tuple[int, ...] = (2, 3)
    threshold: float = 0.3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    margin: np.ndarray  # by bucket: what the feature adds to the logit of label 1, before the mean
    bias: float
    grams: tuple[int, ...]


def features(column: pa.Array, grams: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets of all features in order, and the first and one past the last of each document."""
    words = Words(column)
    shift = U64(64 - BUCKET_BITS)
    own = words.hashes(2)
    # a pair is hashed without regard to order: a word next to itself always falls into the same bucket
    pair = mix64(own[:-1] ^ own[1:]) if len(own) else own
    found = [((own >> shift).astype(np.int32), words.first, 1), ((pair >> shift).astype(np.int32), words.first, 2)]
    raw = words.raw
    for n in grams:
        count = max(len(raw) - n + 1, 0)
        key = np.full(count, n, U64)
        for j in range(n):
            key = (key << U64(8)) | raw[j : j + count]
        found.append(((mix64(key) >> shift).astype(np.int32), words.offsets, n))
    out = []
    for buckets, edges, n in found:  # a document's last n - 1 places would reach into the next one
        lo = np.minimum(edges[:-1], len(buckets))
        out.append((buckets, lo, np.maximum(np.minimum(edges[1:] - n + 1, len(buckets)), lo)))
    return out


def document_buckets(column: pa.Array, grams: tuple[int, ...]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for buckets, lo, hi in features(column, grams):
        for d, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
            out[d].append(buckets[a:b])
    return [np.concatenate(x) for x in out]


def train(texts: pa.Array, labels: np.ndarray, how: Training) -> Model:
    """Learn bucket vectors and softmax weights; labels are 0 and 1."""
    size = 1 << BUCKET_BITS
    ones = float(labels.mean()) if len(labels) else 0.5
    if ones in (0.0, 1.0) or not len(labels):
        odds = np.clip(ones, 1e-3, 1 - 1e-3)
        return Model(np.zeros(size, np.float32), float(np.log(odds / (1 - odds))), how.grams)
    rng = np.random.default_rng(how.seed)
    vectors = rng.uniform(-1, 1, (size, how.dimensions)) / how.dimensions
    weights, bias = np.zeros((how.dimensions, 2)), np.zeros(2)
    docs = []
    for part in sliced(texts):
        docs += [np.unique(b, return_counts=True) for b in document_buckets(part, how.grams)]
    docs = [(b, (c / c.sum())[:, None]) if len(b) else None for b, c in docs]
    seen = np.zeros((size, 1))
    total, step = how.epochs * len(docs), 0
    for _ in range(how.epochs):
        for d in rng.permutation(len(docs)):
            rate = how.rate * (1 - step / total)
            step += 1
            if docs[d] is None:
                continue
            descend(vectors, weights, bias, seen, *docs[d], labels[d], rate)
    return Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]), how.grams)


def descend(vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, seen: np.ndarray, buckets: np.ndarray, share: np.ndarray, label: int, rate: float) -> None:
    """One step of gradient descent on the softmax loss of a document, in place; share is each bucket's part of the features.

    A bucket's gradient is the mean's, times its part of the mean. Its rate is its own:
    divided by the root of the squared gradients that it has ``seen``, since buckets
    differ in how often they occur by orders of magnitude.
    """
    mean = (vectors[buckets] * share).sum(0)
    logits = mean @ weights + bias
    p = np.exp(logits - logits.max())
    p /= p.sum()
    p[label] -= 1
    gradient = share * (weights @ p)
    weights -= rate * np.outer(mean, p)
    bias -= 0.1 * rate * p
    seen[buckets] += (gradient * gradient).mean(1, keepdims=True)
    vectors[buckets] -= VECTOR_RATE * rate * gradient / np.sqrt(seen[buckets] + 1e-12)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = []
    for part in sliced(column):
        total, count = np.zeros(len(part)), np.zeros(len(part))
        for buckets, lo, hi in features(part, model.grams):
            sums = np.concatenate([[0.0], np.cumsum(model.margin[buckets], dtype=np.float64)])
            total += sums[hi] - sums[lo]
            count += hi - lo
        out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + model.bias, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def fit(labelled: DataFrame, how: Training = Training()) -> Model:
    """Train on (doc_id, text, quality) rows: at most how.most_rows of them come to the driver."""
    rows = labelled.select(F.col("text").cast("binary").alias("text"), F.col("quality").cast("int").alias("quality")).toArrow()
    return train(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.binary()), rows.column("quality").to_numpy().astype(np.int64), how)


def training_rows(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """The labelled documents with the smallest hashes of their ids, how.most_rows at most; the ids are chosen before texts are read."""
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(how.most_rows)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return met.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("text"), "text").limit(how.most_rows)  # an id may have several rows


def score(docs: DataFrame, model: Model, threshold: float = Training.threshold) -> DataFrame:
    """docs with ``score`` and ``predicted`` (under free names if taken)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BUCKET_BITS floats, 1 MB

    def run(text: pa.Array) -> pa.Array:
        return pa.array(scores(text, shared.value), pa.float64())

    name = frames.free_name(docs, "score")
    scored = docs.withColumn(name, F.arrow_udf(run, "double")(docs.text.cast("binary")))
    return scored.withColumn(frames.free_name(docs, "predicted"), (F.col(name) >= threshold).cast("int"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = frames.unsigned_crc32(F.col("doc_id")) % 5 == 0
    labels = frames.table(spark, sf_dir, "labels").filter(~held_out)
    how = Training()
    model = fit(training_rows(docs, labels, how), how)
    return score(docs, model, how.threshold).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
