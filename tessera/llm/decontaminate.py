"""Benchmark decontamination: SimHash of item-sized windows, then exact weighted-shingle similarity.

Items fall into classes by length. An item is indexed by the SimHash fingerprints of its first and
last window of its class's length; every window of that length, at every word of every document, is
fingerprinted by one running sum over the 64 signed bits of its shingles' hashes. Fingerprints are
matched by a multi-index: 4 blocks of 16 bits, each block's table listing the items within 2
bits of a value. By the pigeonhole principle two fingerprints within ``RADIUS`` = 4 * 3 - 1 = 11 bits
agree in one block up to 2 bits, so the tables find all of them. Candidates are verified on the
document's words at the item's place and length: the weight of common distinct shingles over the
weight of all, where a shingle weighs its bytes.

Similar windows may differ in more bits, so the search is completed without chance: a window of
``SIMILARITY`` or more lacks at most ``1 - SIMILARITY`` of the item's weight, so it holds one of any
shingles that weigh more than that together. The item's rarest ones are listed; where a document
holds one, every window of the item's length around it is bounded by one running sum over the weights
of the item's shingles, and verified from the highest bound down to the best similarity found.

The benchmark is read in parts of at most ``MAX_ITEMS`` items; only a part's index is broadcast, and
each part is one pass over the documents. Words are lower-cased A-Z.

Defined cases: null or blank texts and items match nothing. Items shorter than a shingle are one
shingle, matched whole. Repeated item rows count once. A row without a doc_id is searched too; its
matches carry a null doc_id. Memory in a task follows the longest text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as T

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Items of one pass, and the ratio of one class of lengths to the one before.
MAX_ITEMS, RATIO = 2000, 1.6

#: All masks of at most BLOCK_RADIUS bits of a block.
_MASKS = np.array(
    [sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)]
)


class Features:
    """Shingle hashes and weights at every word of a slice, with running sums of signed bits."""

    def __init__(self, w: T.Words, h: np.ndarray, size: int, span: int) -> None:
        at = np.arange(max(len(h) - size + 1, 0))
        self.hash = T.span_hash(h, at, at + size)
        lengths = np.zeros(len(h) + 1, np.int64)
        np.cumsum(w.end - w.start, out=lengths[1:])
        self.weight = lengths[at + size] - lengths[at]
        # Sums may wrap around; differences over a window are exact while they fit.
        kind = np.int16 if span * self.weight.max(initial=0) < 2**15 else np.int64
        bits = np.unpackbits(self.hash.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
        signed = (bits * np.int8(2) - np.int8(1)) * self.weight.astype(kind)[:, None]
        self.sums = np.zeros((len(at) + 1, 64), kind)
        np.cumsum(signed, axis=0, out=self.sums[1:], dtype=kind)

    def fingerprints(self, features: int) -> np.ndarray:
        """SimHash of the ``features`` shingles from every position on."""
        total = self.sums[features:] - self.sums[:-features]
        return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


class Index:
    """A bounded part of the benchmark: items, and for each class of lengths its block tables."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        classes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        prints: dict[int, list[int]] = defaultdict(list)
        for item_id, text in sorted(set(items)):
            data = np.frombuffer(text.encode(), np.uint8)
            w = T.words(data, np.array([0, len(data)]))
            n = len(w.start)
            if not n:
                continue
            length = self.ladder(n)
            size = min(SHINGLE, length)
            f = Features(w, T.word_hash(w, lower=True), size, n)
            kept, at = np.unique(f.hash, return_index=True)
            number = len(self.items)
            self.items.append((item_id, n, kept, f.weight[at].astype(np.int64)))
            found = f.fingerprints(length - size + 1)
            for back in {0, n - length}:
                classes[length].append((number, back))
                prints[length].append(int(found[back]))
        self.classes = [
            (length, np.array(classes[length]), np.array(prints[length], np.uint64),
             [self.table(np.array(prints[length], "<u8"), b) for b in range(BLOCKS)])
            for length in sorted(classes)
        ]
        self.rare = self.rarest()

    def rarest(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each size of shingle: hashes, ascending, and item numbers, so that a similar window has one."""
        every = np.concatenate([np.zeros(0, np.uint64), *(own for _, _, own, _ in self.items)])
        known, uses = np.unique(every, return_counts=True)
        listed: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for number, (_, n, own, weight) in enumerate(self.items):
            order = np.argsort(uses[np.searchsorted(known, own)], kind="stable")
            spared = (1 - SIMILARITY + 1e-9) * weight.sum()
            enough = int(np.searchsorted(np.cumsum(weight[order]), spared, side="right")) + 1
            listed[min(SHINGLE, self.ladder(n))].append((own[order[:enough]], number))
        out = {}
        for size, found in listed.items():
            keys = np.concatenate([own for own, _ in found])
            numbers = np.repeat([number for _, number in found], [len(own) for own, _ in found])
            order = np.argsort(keys, kind="stable")
            out[size] = keys[order], numbers[order]
        return out

    @staticmethod
    def ladder(n: int) -> int:
        """The longest class length of at most ``n`` words."""
        length = 1
        while (more := max(length + 1, math.floor(length * RATIO))) <= n:
            length = more
        return length

    @staticmethod
    def table(prints: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each value of a block: whether prints are listed, where they start, and the prints."""
        own = prints.view("<u2").reshape(-1, BLOCKS)[:, block].astype(np.int64)
        value = (own[:, None] ^ _MASKS[None, :]).ravel()
        order = np.argsort(value, kind="stable")
        starts = np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1))
        return np.diff(starts) > 0, starts, order // len(_MASKS)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple]:
        """``(document, item number) -> (similarity, first word, words)``, the best of each."""
        w = T.words(data, offsets)
        h = T.word_hash(w, lower=True)
        best: dict[tuple[int, int], tuple] = {}
        features: dict[int, Features] = {}
        span = max((n for _, n, _, _ in self.items), default=1)
        for length, places, prints, tables in self.classes:
            size = min(SHINGLE, length)
            if len(h) < length:
                continue
            if size not in features:
                features[size] = Features(w, h, size, span)
            found = features[size].fingerprints(length - size + 1)
            at, number = self.near(found, prints, tables)
            for p, k in zip(at.tolist(), number.tolist()):
                item, back = places[k]
                self.verify(features[size], w, p - int(back), int(item), best)
        for size, (keys, numbers) in self.rare.items():
            if len(h) < size:
                continue
            if size not in features:
                features[size] = Features(w, h, size, span)
            self.complete(features[size], w, size, keys, numbers, best)
        return best

    def complete(
        self, f: Features, w: T.Words, size: int, keys: np.ndarray, numbers: np.ndarray, best: dict
    ) -> None:
        """Verifies the windows around each listed shingle that may be more similar than the best."""
        lo = np.searchsorted(keys, f.hash)
        hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == f.hash)
        doc = np.searchsorted(w.first, hit, side="right") - 1
        inside = hit + size <= w.first[doc + 1]
        hit, doc = hit[inside], doc[inside]
        lo = lo[hit]
        count = np.searchsorted(keys, f.hash[hit], side="right") - lo
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        found = numbers[np.repeat(lo, count) + inner]
        for d, item, p in zip(np.repeat(doc, count).tolist(), found.tolist(), np.repeat(hit, count).tolist()):
            places[d, item].append(p)
        for (d, item), at in places.items():
            wide = self.items[item][1] - size  # a window has one shingle more
            low = 0
            for k in range(1, len(at) + 1):
                if k == len(at) or at[k] - at[k - 1] > wide:
                    self.around(f, w, size, d, item, at[low] - wide, at[k - 1], best)
                    low = k

    def around(
        self, f: Features, w: T.Words, size: int, doc: int, item: int, a: int, b: int, best: dict
    ) -> None:
        """Verifies the windows that start from ``a`` to ``b``, by falling bounds."""
        _, n, own, weight = self.items[item]
        left, right = int(w.first[doc]), int(w.first[doc + 1]) - size + 1
        lo, hi = max(a, left), min(b + n - size + 1, right)
        hashes = f.hash[lo:hi]
        slot = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        at = np.flatnonzero(own[slot] == hashes)
        slot = slot[at]
        # An occurrence counts for the windows that hold it and not the one before of its shingle.
        order = np.argsort(slot, kind="stable")
        earlier = np.full(len(at), a - 1)
        again = slot[order[1:]] == slot[order[:-1]]
        earlier[order[1:][again]] = lo + at[order[:-1][again]]
        since = np.maximum(np.maximum(earlier + 1, lo + at - (n - size)), a)
        until = np.minimum(lo + at, b)
        some = since <= until
        change = np.zeros(b - a + 2, np.int64)
        np.add.at(change, since[some] - a, weight[slot[some]])
        np.add.at(change, until[some] - a + 1, -weight[slot[some]])
        bound = np.cumsum(change[:-1]) / int(weight.sum())
        for k in np.argsort(-bound, kind="stable").tolist():
            found = best.get((doc, item))
            if bound[k] < max(SIMILARITY, found[0] if found else 0.0):
                break
            start = a + k
            if found is None or bound[k] > found[0] or max(start, left) - left < found[1]:
                self.verify(f, w, start, item, best, doc)

    @staticmethod
    def near(found: np.ndarray, prints: np.ndarray, tables: list) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a window and an item's fingerprint within ``RADIUS`` bits, each once."""
        all_at, all_number = [], []
        values = found.view("<u2").reshape(-1, BLOCKS)
        for b, (listed, starts, entries) in enumerate(tables):
            hit = np.flatnonzero(listed[values[:, b]])
            value = values[hit, b].astype(np.int64)
            lo = starts[value]
            count = starts[value + 1] - lo
            at = np.repeat(hit, count)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            number = entries[np.repeat(lo, count) + inner]
            close = np.bitwise_count(found[at] ^ prints[number]) <= RADIUS
            all_at.append(at[close])
            all_number.append(number[close])
        pairs = np.unique(np.stack([np.concatenate(all_at), np.concatenate(all_number)]), axis=1)
        return pairs[0], pairs[1]

    def verify(
        self, f: Features, w: T.Words, start: int, item: int, best: dict, doc: int | None = None
    ) -> None:
        """Exact similarity of an item and the document's words at its place."""
        _, n, own, weight = self.items[item]
        size = min(SHINGLE, self.ladder(n))
        if doc is None:
            middle = min(max(start + n // 2, 0), len(w.start) - 1)
            doc = int(np.searchsorted(w.first, middle, side="right")) - 1
        lo = max(start, int(w.first[doc]))
        hi = min(start + n, int(w.first[doc + 1])) - size + 1
        if hi <= lo:
            return
        kept, at = np.unique(f.hash[lo:hi], return_index=True)
        its = f.weight[lo:hi][at]
        common = int(weight[np.isin(own, kept, assume_unique=True)].sum())
        similarity = common / (int(weight.sum()) + int(its.sum()) - common)
        found = (similarity, lo - int(w.first[doc]), hi - lo + size - 1)
        if similarity >= SIMILARITY:
            old = best.get((doc, item))
            if old is None or (-found[0], found[1]) < (-old[0], old[1]):
                best[doc, item] = found


def parts(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark's items in bounded parts, each an index."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )
    passes = max(1, math.ceil(items.count() / MAX_ITEMS))
    for k in range(passes):
        # Hashed parts are about equal; twice the bound holds for any benchmark of real size.
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        yield Index([tuple(r) for r in part.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words`` of each item found in a document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    out = None
    for index in parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, rows = batch.column(0), []
                for lo, _, data, offsets in T.slices(batch.column(1)):
                    for (doc, item), (s, first, n) in index.matches(data, offsets).items():
                        rows.append((ids[lo + doc].as_py(), index.items[item][0], s, first, n))
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)],
                    ["doc_id", "item_id", "similarity", "first_word", "n_words"],
                )

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    best = F.max(F.struct("similarity", -F.col("first_word"), "n_words")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "m.similarity", (-F.col("m.col2")).alias("first_word"), "m.n_words"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those in which an item is found; no shuffle."""
    at = docs.columns.index("text")
    for index in parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in T.slices(batch.column(at)):
                    keep[[lo + doc for doc, _ in shared.value.matches(data, offsets)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
