"""Toxicity: a factorization machine over hashed terms.

The logit of a document is ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``. The pair part is the
interaction that additive weights miss, such as an insult next to the mention of a group; it costs
one pass by ``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``. Terms are the distinct words of
a document (runs of letters and digits, lower-cased A-Z) and the first bytes of each longer word, so
that inflected forms share a term. Terms of a single training document are dropped before the
fit. Training is AdaGrad over small batches on a bounded sample.

Defined cases: a null, empty or blank text has no terms and scores by ``w0`` alone. Without a
labelled document every score is 0.5. A repeated row is scored again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import labelled as L
from tessera.llm import text as T

#: Hash width, factors of each term, bound of the training sample.
BITS, FACTORS, MAX_TRAINING_DOCS = 18, 4, 12_000
#: Stems: leading bytes that stand for a longer word as well.
STEMS = (4, 5)
#: Training documents that a term must occur in.
MIN_DOCS = 2
EPOCHS, BATCH = 10, 128
#: Step sizes of the weights and of the factors, L1 strength of the weights, L2 of the factors.
RATE, PAIR_RATE, SPARSE, DECAY = 0.3, 0.1, 1e-3, 1e-3
#: Weight of a positive training document.
POSITIVE = 3.0
#: Scale of the terms in the pair part, which sums over the square of their number: ``PAIR_NORM`` over
#: the root of that number, and ``PAIR_SCALE`` at most.
PAIR_SCALE, PAIR_NORM = 0.3, 2.0

KINDS = np.where(L.TERM_KINDS == 1, 1, 0).astype(np.uint8)


def terms(data: np.ndarray, offsets: np.ndarray) -> L.Terms:
    """Distinct hashed words and stems of each document."""
    w = T.words(data, offsets, KINDS)
    owner = np.repeat(np.arange(len(offsets) - 1), w.count())
    hashes, owners = [T.word_hash(w, lower=True)], [owner]
    for size in STEMS:
        long = w.end - w.start > size
        stem = T.Words(w.data, w.start[long], w.start[long] + size, w.first)
        hashes.append(T.mix(T.word_hash(stem, lower=True) + T.U(size)))
        owners.append(owner[long])
    return L.distinct_terms(
        np.concatenate(hashes), np.concatenate(owners), len(offsets) - 1, BITS
    )


def pair_scale(first: np.ndarray) -> np.ndarray:
    """Scale of each term in the pair part of its document."""
    count = np.diff(first)
    return np.repeat(np.minimum(PAIR_SCALE, PAIR_NORM / np.sqrt(np.maximum(count, 1))), count)[:, None]


def logits(
    found: np.ndarray, first: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray
) -> np.ndarray:
    vx = v[found] * pair_scale(first)
    total = L.doc_sums(vx, first)
    pairs = 0.5 * ((total**2).sum(1) - L.doc_sums((vx**2).sum(1), first))
    return w0 + L.doc_sums(w[found], first) + pairs


def fit(docs: list[np.ndarray], y: np.ndarray) -> bytes:
    """``w0, w, v`` as float32."""
    size = 1 << BITS
    seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *docs]), minlength=size)
    kept = np.flatnonzero(seen >= MIN_DOCS)
    number = np.full(size, -1)
    number[kept] = np.arange(len(kept))
    docs = [number[d][number[d] >= 0] for d in docs]
    draw = np.random.Generator(np.random.PCG64(11))
    w, v = np.zeros(len(kept)), draw.normal(0, 0.05, (len(kept), FACTORS))
    w0, g0 = 0.0, 1e-8
    gw, gv = np.full(len(kept), 1e-8), np.full((len(kept), FACTORS), 1e-8)
    weight = np.where(y > 0, POSITIVE, 1.0)
    for _ in range(EPOCHS):
        for lo in range(0, len(docs), BATCH):
            part, label = docs[lo : lo + BATCH], y[lo : lo + BATCH]
            found = np.concatenate(part)
            first = np.concatenate([[0], np.cumsum([len(d) for d in part])])
            owner = np.repeat(np.arange(len(part)), np.diff(first))
            scale = pair_scale(first)
            vx = v[found] * scale
            total = L.doc_sums(vx, first)
            pairs = 0.5 * ((total**2).sum(1) - L.doc_sums((vx**2).sum(1), first))
            error = L.sigmoid(w0 + L.doc_sums(w[found], first) + pairs) - label
            error *= weight[lo : lo + BATCH] / len(part)
            step = np.bincount(found, error[owner], len(kept))
            gw += step**2
            rate = RATE / np.sqrt(gw)
            w -= rate * step
            w = np.sign(w) * np.maximum(np.abs(w) - rate * SPARSE, 0.0)
            for f in range(FACTORS):
                pull = error[owner] * (total[owner, f] - vx[:, f]) * scale[:, 0]
                step = np.bincount(found, pull, len(kept)) + DECAY * v[:, f]
                gv[:, f] += step**2
                v[:, f] -= PAIR_RATE * step / np.sqrt(gv[:, f])
            g0 += error.sum() ** 2
            w0 -= RATE * error.sum() / np.sqrt(g0)
    all_w, all_v = np.zeros(size), np.zeros((size, FACTORS))
    all_w[kept], all_v[kept] = w, v
    return np.concatenate([[w0], all_w, all_v.ravel()]).astype(np.float32).tobytes()


def train(docs: DataFrame, labels: DataFrame, label: str, allowed, bound: int = MAX_TRAINING_DOCS):
    """``w0, w, v`` fitted on at most ``bound`` labelled documents that are ``allowed``."""
    rows = L.training_rows(docs, labels, label, allowed, bound)
    model = np.frombuffer(L.train_in_task(rows, terms, fit), np.float32)
    size = 1 << BITS
    return float(model[0]), model[1 : size + 1], model[size + 1 :].reshape(size, FACTORS)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, out: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Labels are read of documents only whose crc32 remainder is not ``out``.
    """
    held = L.remainder(F.col("doc_id"), modulus) == out
    w0, w, v = train(docs, labels, "toxic", ~held)

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return L.sigmoid(logits(*terms(data, offsets), w0, w, v))

    rows, name = L.score_documents(docs.select("doc_id", "text"), score)
    return rows.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        F.col(name).alias("score"),
        F.when(F.col(name) >= 0.5, 1).otherwise(0).alias("predicted"),
    )
