"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

A word is a run of letters and digits or a run of other signs, lower-cased A-Z; the features of a
document are its distinct hashed words and word pairs, and one for its share of pairs of equal words,
each of value 1/sqrt(number of features).
Training follows the regularised leader coordinate by coordinate (sums of gradients and of their
squares, with an L1 threshold that keeps unused weights at zero), on a bounded sample of labelled
documents; a score is one sparse dot product.

Defined cases: a null, empty or blank text has no features and scores by the intercept alone. With no
labelled document every score is 0.5. Null labels are not labels. A repeated row is scored again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import labelled as L
from tessera.llm import text as T

#: Hash width of the weight table: 2**18 float32 weights, 1 MB to each task.
BITS = 18
#: Bound of the training sample.
MAX_TRAINING_DOCS = 12_000
#: FTRL: learning rate, its smoothing, and the L1 and L2 strengths.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.01
EPOCHS = 3
#: Start of the terms that stand for the share of pairs of equal words, in tenths.
REPEATS = T.U(0x5EED)
#: Offset of the intercept, which is the last weight.
INTERCEPT = 1 << BITS


def terms(data: np.ndarray, offsets: np.ndarray) -> L.Terms:
    """Distinct hashed words and word pairs of each document."""
    w = T.words(data, offsets, L.TERM_KINDS)
    single = T.word_hash(w, lower=True)
    owner = np.repeat(np.arange(len(offsets) - 1), w.count())
    at, first = T.windows(w.first, 2)
    pair = T.mix(single[at] * T.U(3) + single[at + 1])
    pair_owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    same = np.bincount(pair_owner[single[at] == single[at + 1]], minlength=len(offsets) - 1)
    tenths = (same * 10 // np.maximum(w.count(), 1)).astype(np.uint64)
    return L.distinct_terms(
        np.concatenate([single, pair, T.mix(tenths + REPEATS)]),
        np.concatenate([owner, pair_owner, np.arange(len(offsets) - 1)]),
        len(offsets) - 1,
        BITS,
    )


def _weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(
        np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    )


def fit(docs: list[np.ndarray], y: np.ndarray) -> bytes:
    """Weights after a few passes of FTRL, as float32."""
    z, n = np.zeros(INTERCEPT + 1), np.zeros(INTERCEPT + 1)
    for _ in range(EPOCHS):
        for found, label in zip(docs, y):
            at = np.append(found, INTERCEPT)
            x = np.full(len(at), 1 / np.sqrt(max(len(found), 1)))
            x[-1] = 1.0
            w = _weight(z[at], n[at])
            g = (L.sigmoid(w @ x) - label) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    return _weight(z, n).astype(np.float32).tobytes()


def train(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int = MAX_TRAINING_DOCS
) -> np.ndarray:
    rows = L.training_rows(docs, labels, label, allowed, bound)
    model = L.train_in_task(rows, terms, fit)
    return np.frombuffer(model, np.float32)


def scored(docs: DataFrame, weights: np.ndarray) -> tuple[DataFrame, str]:
    """``docs`` with the probability of label 1, and the name of that column."""

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, first = terms(data, offsets)
        size = np.sqrt(np.maximum(np.diff(first), 1))
        return L.sigmoid(L.doc_sums(weights[found], first) / size + weights[INTERCEPT])

    return L.score_documents(docs, score)


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, out: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Labels are read of documents only whose crc32 remainder is not ``out``.
    """
    held = L.remainder(F.col("doc_id"), modulus) == out
    weights = train(docs, labels, "quality", ~held)
    rows, name = scored(docs.select("doc_id", "text"), weights)
    return rows.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        F.col(name).alias("score"),
        F.when(F.col(name) >= 0.5, 1).otherwise(0).alias("predicted"),
    )
