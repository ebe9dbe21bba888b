"""Ranked lexical search by hashed max-sketches: bounds first, exact scores for what may still win.

A term's impact in a document falls with the document's length and rises with the term's count there. A
document's impacts fold into a sketch of ``WIDTH`` coordinates, each the largest impact of the terms that
hash to it. A query's weights times the sketch's values at its terms sum to a bound that the exact
score never passes. Every task takes its documents slice by slice, looks all queries up in the sketches of
a slice at once, and scores documents exactly in the order of falling bounds, until the next bound is below
the k-th best score the task has found so far. So no document that could enter a list is left out.

Counts over the corpus (documents with terms, all terms, documents that hold a query term) come from a
first pass, one partial sum for each task. Lists of tasks, k for each query, are merged in two
steps so that no query's lists meet in one task at once. Queries go out in blocks of about ``BLOCK_BYTES``
of text, a pass for each block; nothing that is sent grows with the documents.

Terms are runs of ASCII letters, digits and all characters past ASCII, A-Z lower-cased. They are matched
by 128 hash bits, two independent hashes of their bytes.

Defined cases: a null, empty or termless text counts nowhere and is never found; a query without terms finds
nothing. Each row is a document: repeated rows are ranked each. Rows without a doc_id are ranked, after
others of equal score. Rows that repeat an item_id count as one query, with the smallest text (a null
item_id is one as well). Equal scores stand by ascending doc_id. A query found in fewer than k documents
returns those. A task holds its longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import text as T

#: Coordinates of a sketch.
WIDTH = 4096
#: Text of the queries that one pass answers, in bytes.
BLOCK_BYTES = 1 << 20
#: Documents of each query scored between two looks at its threshold.
STEP = 16
#: Products looked up at once.
AT_ONCE = 2_000_000
#: Lists of this many groups of tasks are merged first.
MERGE_GROUPS = 64
NO_ID = np.iinfo(np.int64).max

#: Byte classes: 1 letters, digits and bytes past ASCII, 0 separators.
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class Queries(NamedTuple):
    """Distinct terms in the order of their hash, and the terms of each query in one array."""

    hashes: np.ndarray
    check: np.ndarray
    terms: np.ndarray
    first: np.ndarray


class Found(NamedTuple):
    """Query terms of some documents: document, number of the term, occurrences."""

    owner: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def _read(texts: list[str]) -> Queries:
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    sizes = np.array([len(t.encode()) + 1 for t in texts], np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    offsets[-1] = len(data)
    w = T.words(data, offsets, KINDS)
    h = T.word_hash(w, lower=True)
    hashes, at, terms = np.unique(h, return_index=True, return_inverse=True)
    return Queries(hashes, T.word_hash(w, 1, lower=True)[at], terms, w.first)


def _counts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return start, np.diff(np.append(start, len(key)))


def _lookup(q: Queries, w: T.Words, h: np.ndarray) -> Found:
    """The query terms that documents hold."""
    if not len(q.hashes) or not len(h):
        none = np.zeros(0, np.int64)
        return Found(none, none, none)
    term = np.minimum(np.searchsorted(q.hashes, h), len(q.hashes) - 1)
    at = np.flatnonzero(q.hashes[term] == h)
    some = T.Words(w.data, w.start[at], w.end[at], w.first)
    at = at[T.word_hash(some, 1, lower=True) == q.check[term[at]]]
    owner = np.searchsorted(w.first, at, side="right") - 1
    key = np.sort(owner * len(q.hashes) + term[at])
    start, tf = _counts(key)
    return Found(*np.divmod(key[start], len(q.hashes)), tf)


def _statistics(docs: DataFrame, q: Queries) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all terms, and documents that hold each query term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, df = np.zeros(2, np.int64), np.zeros(len(q.hashes), np.int64)
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column(0)):
                w = T.words(data, offsets, KINDS)
                n = w.count()
                totals += [np.count_nonzero(n), n.sum()]
                df += np.bincount(_lookup(q, w, T.word_hash(w, lower=True)).term, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append([-2, -1], some)), pa.array(np.append(totals, df[some]))], ["term", "n"]
        )

    partial = docs.select("text").mapInArrow(run, "term long, n long")
    # As many rows as the block's queries have distinct terms.
    sums = dict(partial.groupBy("term").agg(F.sum("n").alias("n")).collect())
    held = np.array([sums.get(k, 0) for k in range(len(q.hashes))], np.int64)
    return sums.get(-2, 0), sums.get(-1, 0), held


class Lists:
    """The k best documents of each query so far, and the score that a further one must reach."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.query = self.id = self.score = np.zeros(0, np.int64)
        self.floor = np.ones(n, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.floor[query]
        query, ids, score = (
            np.concatenate([old, new[good]])
            for old, new in ((self.query, query), (self.id, ids), (self.score, score))
        )
        order = np.lexsort((ids, -score, query))
        query = query[order]
        start, n = _counts(query)
        place = np.arange(len(query)) - np.repeat(start, n)
        order = order[place < self.k]
        self.query, self.id, self.score = query[place < self.k], ids[order], score[order]
        last = place[place < self.k] == self.k - 1
        self.floor[self.query[last]] = self.score[last]


def sketches(
    owner: np.ndarray, hashes: np.ndarray, impacts: np.ndarray, n_docs: int, width: int
) -> np.ndarray:
    """Coordinatewise maxima of the impacts of each document's terms."""
    out = np.zeros(n_docs * width, np.int64)
    np.maximum.at(out, owner * width + (hashes % T.U(width)).astype(np.int64), impacts)
    return out.reshape(n_docs, width)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _search(docs: DataFrame, q: Queries, k: int, width: int, step: int) -> DataFrame:
    """``query, doc_id, score``: the k best of each task for each query, by its number."""
    n_docs, n_terms, df = _statistics(docs, q)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df], np.int64)
    sizes = np.diff(q.first)
    some = np.flatnonzero(sizes)  # queries with terms
    starts, sizes = q.first[some], sizes[some]
    weights, columns = weight[q.terms], (q.hashes[q.terms] % T.U(width)).astype(np.int64)

    def slice_lists(lists: Lists, ids: np.ndarray, w: T.Words) -> None:
        h = T.word_hash(w, lower=True)
        n = w.count()
        m = 75 + (25 * n * n_docs) // max(n_terms, 1)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, owner))
        key, its = h[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (its[1:] != its[:-1])
        start = np.flatnonzero(new)
        tf = np.diff(np.append(start, len(key)))
        sketch = sketches(its[start], key[start], impact(tf, m[its[start]]), len(n), width)
        held = _lookup(q, w, h)
        exact = np.zeros((len(n), max(len(q.hashes), 1)), np.int64)
        exact[held.owner, held.term] = impact(held.tf, m[held.owner])
        rows = max(1, AT_ONCE // len(columns))
        for lo in range(0, len(n), rows):
            bound = np.add.reduceat(sketch[lo : lo + rows, columns] * weights, starts, axis=1)
            doc, query = np.nonzero(bound >= lists.floor[some])
            high = bound[doc, query]
            order = np.lexsort((-high, query))
            doc, query, high = doc[order] + lo, query[order], high[order]
            while len(doc):
                first, run = _counts(query)
                place = np.arange(len(query)) - np.repeat(first, run)
                now = place < step
                d, at = doc[now], query[now]
                flat = np.arange(sizes[at].sum()) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at])
                flat += np.repeat(starts[at], sizes[at])
                parts = exact[np.repeat(d, sizes[at]), q.terms[flat]] * weights[flat]
                score = np.add.reduceat(parts, np.cumsum(sizes[at]) - sizes[at])
                lists.add(some[at], ids[d], score)
                rest = ~now & (high >= lists.floor[some[query]])
                doc, query, high = doc[rest], query[rest], high[rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(len(q.first) - 1, k)
        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                w = T.words(data, offsets, KINDS)
                if len(w.start):
                    slice_lists(lists, ids[lo:hi], w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lists.query), pa.array(lists.id, mask=lists.id == NO_ID), pa.array(lists.score)],
            ["query", "doc_id", "score"],
        )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "query long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, width: int = WIDTH, step: int = STEP
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item.

    ``width`` is the size of the sketches, ``step`` the documents scored between two looks at the threshold;
    neither changes the result.
    """
    asked = items.groupBy("item_id").agg(F.min("text").alias("text")).filter("text IS NOT NULL")
    volume = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = math.ceil(volume / BLOCK_BYTES) or 1
    found = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        listed = own.orderBy("item_id").collect()  # one block's texts
        q = _read([r.text for r in listed])
        if not len(q.terms):
            continue
        names = docs.sparkSession.createDataFrame(
            [(i, r.item_id) for i, r in enumerate(listed)], "query long, item_id long"
        )
        part = _ranked(_search(docs, q, k, width, step), k).join(F.broadcast(names), "query")
        part = part.select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found


def _ranked(lists: DataFrame, k: int) -> DataFrame:
    """The k best of all tasks' lists, first within groups of tasks."""
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = lists.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    near = Window.partitionBy("query", "part").orderBy(*by)
    merged = dealt.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    best = Window.partitionBy("query").orderBy(*by)
    return merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
