"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse scores."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import at_home, chunks, texts_of
from .textops import inside, mix, ngrams, owner, words

#: log2 of the number of features; labelled documents that the model is fitted on at most; passes over them.
BITS, SAMPLE, EPOCHS = 18, 6_000, 4
#: Step size, its offset, and the L1 and L2 weights of the updates.
STEP, OFFSET, L1, L2 = 0.3, 1.0, 0.05, 0.5


class Features(NamedTuple):
    """Feature numbers of all texts in a row, and each one's text; scale: 1 / sqrt(features of the text)."""

    index: np.ndarray
    text: np.ndarray
    scale: np.ndarray


def features(raw: np.ndarray, offsets: np.ndarray) -> Features:
    """Words and pairs of words, hashed. A word after itself is one feature whatever the word. Case is kept."""
    w = words(raw, offsets)
    pair = inside(w.first, 2)
    text = owner(w.first)
    two = ngrams(w.hash, 2)
    if len(two):
        two = np.where(w.hash[:-1] == w.hash[1:], np.uint64(1), two)
    hashes = np.concatenate([w.hash, mix(two[pair])])
    of = np.concatenate([text, text[: len(pair)][pair]])
    n = np.bincount(of, minlength=len(offsets) - 1)
    return Features((hashes & np.uint64((1 << BITS) - 1)).astype(np.int64), of, 1 / np.sqrt(np.maximum(n, 1)))


class Ftrl:
    """FTRL-proximal for logistic loss: sums of shifted gradients (z) and squared gradients (n) for each feature."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((OFFSET + np.sqrt(n)) / STEP + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / STEP * w
        self.n[at] = n + gradient**2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Weights, the bias last. Fitted on the SAMPLE labelled documents outside the held-out fold with the smallest hash
    of their doc_id (all, if there are fewer); only their features come to the driver. Without labels all are 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = texts_of(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                f = features(raw, offsets)
                at = np.searchsorted(f.text[np.argsort(f.text, kind="stable")], np.arange(len(part) + 1))
                index = f.index[np.argsort(f.text, kind="stable")]
                found = [np.unique(index[at[i] : at[i + 1]], return_counts=True) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([i.astype(np.int32).tobytes() for i, _ in found]), pa.array([(c * f.scale[k]).astype(np.float32).tobytes() for k, (_, c) in enumerate(found)])],
                    ["doc_id", "label", "at", "x"],
                )

    sample = rows.mapInArrow(run, "doc_id long, label double, at binary, x binary").toArrow()
    order = np.lexsort((sample.column("label").to_numpy(), sample.column("doc_id").to_numpy()))
    label_of, at, x = sample.column("label").to_numpy(), sample.column("at"), sample.column("x")
    model, random = Ftrl(), np.random.Generator(np.random.PCG64(3))
    for _ in range(EPOCHS):
        for i in random.permutation(order).tolist():
            rows_at = np.append(np.frombuffer(at[i].as_py(), np.int32), 1 << BITS)
            model.learn(rows_at, np.append(np.frombuffer(x[i].as_py(), np.float32), 1.0), label_of[i])
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, by its whole text only."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for rows, raw, offsets in chunks(batch):
                f = features(raw, offsets)
                logit = w[-1] + np.bincount(f.text, w[f.index], len(rows)) * f.scale
                p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = texts_of(docs)
    return rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels.quality outside the held-out fold (crc32 of the doc_id as text, modulo 4, is 2) and score all docs.

    score is the probability of label 1, predicted is 1 from 0.7 on. Null and empty texts have no features: their
    score is the bias. Labels that are null count for nothing; of contradicting labels of one doc_id the largest
    counts. Repeated rows are scored alike. Without any label every score is 0.5.
    """
    docs, labels = at_home(docs, labels)
    return score(docs, fit(docs, labels))
