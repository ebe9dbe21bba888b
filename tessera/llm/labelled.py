"""Bounded training samples of labelled documents, and hashed term features of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm import text as T

#: Byte classes for terms: 0 spaces, 1 letters and digits (all bytes past ASCII), 2 other signs.
TERM_KINDS = np.full(256, 2, np.uint8)
TERM_KINDS[T.SPACE] = 0
TERM_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1

#: Terms of consecutive documents: hashed term numbers, ascending and distinct within a document,
#: and the first term of each document.
Terms = tuple[np.ndarray, np.ndarray]


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal document number modulo ``modulus``; null for a null number."""
    return F.when(
        doc_id.isNotNull(), F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)
    )


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int
) -> DataFrame:
    """``text, label`` of at most ``bound`` documents that have a label and are ``allowed``.

    The sample is the ``bound`` smallest hashes of the document number among the labelled documents that
    ``docs`` holds, so it is the same at each run and independent of the order of rows; labels of other
    documents use nothing of the bound. A document labelled more than once counts with its
    largest label, a repeated doc_id with its smallest text. Only the bounded list of numbers is broadcast.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("_y"))
        .join(docs.filter("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return (
        docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_y").alias("label"))
    )


def distinct_terms(hashes: np.ndarray, owner: np.ndarray, n_docs: int, bits: int) -> Terms:
    """Hashed terms of each document once, as one sort over the slice."""
    key = np.unique((owner.astype(np.uint64) << T.U(32)) | (hashes >> T.U(64 - bits)))
    first = np.searchsorted(key, np.arange(n_docs + 1, dtype=np.uint64) << T.U(32))
    return (key & T.U(0xFFFFFFFF)).astype(np.int64), first


def train_in_task(
    rows: DataFrame,
    terms: Callable[[np.ndarray, np.ndarray], Terms],
    fit: Callable[[list[np.ndarray], np.ndarray], bytes],
) -> bytes:
    """Fit a model of bounded size on a bounded sample: terms in many tasks, the fit in one.

    Only term numbers reach the fitting task, and only the model reaches the driver.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0), batch.column(2)
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                found, first = terms(data, offsets)
                packed = [found[a:b].astype(np.int32).tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), labels.slice(lo, hi - lo), pa.array(packed, pa.binary())],
                    ["doc_id", "label", "terms"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            (i, y, t)
            for batch in batches
            for i, y, t in zip(*(batch.column(c).to_pylist() for c in range(3)))
        )
        order = np.random.Generator(np.random.PCG64(7)).permutation(len(rows))
        docs = [np.frombuffer(rows[k][2], np.int32).astype(np.int64) for k in order]
        model = fit(docs, np.array([rows[k][1] for k in order], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    taken = rows.mapInArrow(features, "doc_id long, label int, terms binary")
    return taken.coalesce(1).mapInArrow(learn, "model binary").first()["model"]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def doc_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each document, 0 for a document without terms."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def score_documents(
    docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> tuple[DataFrame, str]:
    """``docs`` with one more column for the score, and that column's name (none that exists).

    The given columns pass beside it in one Arrow job, without a join.
    """
    name = "score"
    while name in docs.columns:
        name = f"_{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = [score(d, o) for _, _, d, o in T.slices(batch.column(at))]
            column = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(run, schema), name
