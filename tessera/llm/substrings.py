"""Substring dedup by level-wise doubling of repeated word windows.

Level one looks at every window of ``base`` words; only windows that occur again anywhere are
extended: a window of twice the length is a candidate where both its halves are repeated. So it
goes on until the length asked for is reached or no candidate survives. At the last level the
earliest start (smallest doc_id, then position) of each window is known, and the words of every
other one are removed.

Documents are dealt by a hash of doc_id into blocks of about ``BLOCK_BYTES``. A block sends each
distinct window once, as a few bytes within one array for each bucket of hashes; so a passage that a
third of all documents share is one entry of each block. The bucket answers with one bit for each
entry, in order. Texts are shuffled once for all passes (Spark reuses that exchange); nothing else
holds text.

Below the last level a window is 32 bits of its hash within a bucket: a clash only lets a candidate go
on. At the last level it is 96 bits of two independent hashes, besides its bucket; words that equal
in those are taken as equal. Level-one buckets grow in number with the input, so their clashes do not.

Defined cases: a null or blank text has no words; its kept text is empty. Rows without a doc_id are
not compared: nothing is removed from them. Of rows that repeat a doc_id the one with the smaller
text comes first. A block, so at least its longest text, is held in memory by one task.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as T

#: Bytes of text in a block; on a large cluster raise it so that blocks times buckets stay few.
BLOCK_BYTES = 4 << 20
#: Windows in a bucket, about.
BUCKET_WINDOWS = 1 << 19


class Block:
    """The documents of a block in order, their words, and the windows that survive each level."""

    def __init__(self, docs: pa.Table, base: int, buckets: int) -> None:
        docs = docs.combine_chunks()
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_ids = docs.column("doc_id")
        self.ids = np.asarray(self.doc_ids.fill_null(0))
        self.base, self.buckets = base, buckets
        parts: list[list[np.ndarray]] = [[], [], []]
        self.words: list[tuple[T.Words, int]] = []
        count = 0
        for lo, _, data, offsets in T.slices(docs.column("text")):
            w = T.words(data, offsets)
            for family in range(2):
                parts[family].append(T.word_hash(w, family))
            parts[2].append(w.first[:-1] + count)
            self.words.append((w, lo))
            count += len(w.start)
        self.hash = [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts[:2]]
        self.first = np.append(np.concatenate(parts[2]) if parts[2] else np.zeros(0, int), count)

    def level(self, size: int, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct windows at ``starts`` in hash order: hash, number of each start's window,
        and each one's first start."""
        h = T.span_hash(self.hash[0], starts, starts + size)
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        return ranked[new], number, order[new]

    def candidates(self, size: int, answers: dict[int, np.ndarray]) -> np.ndarray:
        """Starts of the windows of ``size`` words whose halves are all repeated."""
        starts, _ = T.windows(self.first, self.base)
        length = self.base
        while length < size:
            _, number, _ = self.level(length, starts)
            starts = starts[answers[length][number]]
            known = np.zeros(len(self.hash[0]) + 1, bool)
            known[starts] = True
            starts = starts[known[np.minimum(starts + length, len(known) - 1)]]
            length *= 2
            inside = np.searchsorted(self.first, starts, side="right") - 1
            starts = starts[starts + length <= self.first[inside + 1]]
        return starts

    def bounds(self, hashes: np.ndarray) -> np.ndarray:
        """Where each bucket, an equal range of hashes, starts in ascending hashes."""
        edges = [(k << 64) // self.buckets for k in range(self.buckets)]
        return np.append(np.searchsorted(hashes, np.array(edges, np.uint64)), len(hashes))


def _answers(table: pa.Table) -> dict[int, np.ndarray]:
    """For each level the bits of a block's distinct windows, in hash order."""
    out: dict[int, list[np.ndarray]] = {}
    for row in table.sort_by([("size", "ascending"), ("bucket", "ascending")]).to_pylist():
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=row["n"]).astype(bool)
        out.setdefault(row["size"], []).append(bits)
    return {size: np.concatenate(bits) for size, bits in out.items()}


def _complete(answers: dict[int, np.ndarray], size: int, base: int) -> dict[int, np.ndarray]:
    """A level that sent nothing has no windows."""
    while base < size:
        answers.setdefault(base, np.zeros(0, bool))
        base *= 2
    return answers


SENT = "bucket int, block int, size int, n int, keys binary, more binary, docs binary"
ANSWER = "bucket int, block int, size int, n int, bits binary"


def _send(block: Block, number: int, size: int, last: bool, starts: np.ndarray) -> pa.Table:
    """The block's distinct windows of a level, an array for each bucket."""
    hashes, which, first = block.level(size, starts)
    again = np.bincount(which, minlength=len(hashes)) > 1
    bounds = block.bounds(hashes)
    rows: list[tuple] = []
    if last:
        at = starts[first]
        other = (T.span_hash(block.hash[1], at, at + size, 1) >> T.U(32)).astype(np.uint32)
        owner = block.ids[np.searchsorted(block.first, at, side="right") - 1]
    for b in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[b], bounds[b + 1])
        if last:
            sent = (hashes[part].tobytes(), other[part].tobytes(), owner[part].tobytes())
        else:
            low = ((hashes[part] >> T.U(16)) & T.U(0xFFFFFFFF)).astype(np.uint32)
            sent = (low.tobytes(), np.packbits(again[part]).tobytes(), b"")
        rows.append((int(b), number, size, int(bounds[b + 1] - bounds[b]), *sent))
    columns = list(zip(*rows)) or [[]] * 7
    kinds = [pa.int32()] * 4 + [pa.binary()] * 3
    return pa.Table.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)],
        ["bucket", "block", "size", "n", "keys", "more", "docs"],
    )


def _judge(table: pa.Table, last: bool) -> pa.Table:
    """One bit for each window of a bucket: repeated anywhere, or at the last level: not the first."""
    table = table.select(["bucket", "block", "size", "n", "keys", "more", "docs"])
    n = np.asarray(table.column("n").combine_chunks()).astype(np.int64)
    keys = np.concatenate(
        [np.frombuffer(k.as_buffer(), np.uint64 if last else np.uint32) for k in table.column("keys")]
    )
    if last:
        other = np.concatenate([np.frombuffer(k.as_buffer(), np.uint32) for k in table.column("more")])
        owner = np.concatenate([np.frombuffer(k.as_buffer(), np.int64) for k in table.column("docs")])
        order = np.lexsort((owner, other, keys))
        a, b = keys[order], other[order]
        same = np.zeros(len(order), bool)
        same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        bits = np.empty(len(order), bool)
        bits[order] = same
    else:
        again = [
            np.unpackbits(np.frombuffer(k.as_buffer(), np.uint8), count=c)
            for k, c in zip(table.column("more"), n)
        ]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        bits = np.concatenate(again).astype(bool)
        bits[order[1:][same]] = True
        bits[order[:-1][same]] = True
    ends = np.cumsum(n)
    packed = [np.packbits(bits[e - c : e]).tobytes() for e, c in zip(ends, n)]
    return table.select(["bucket", "block", "size", "n"]).append_column(
        "bits", pa.array(packed, pa.binary())
    )


def substring_dedup(docs: DataFrame, size: int = 20, levels: int = 2, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept_text`` of each document.

    ``size`` words make a window; ``levels`` lengths lead to it, each twice the one before.
    """
    base = size >> (levels - 1)
    if base << (levels - 1) != size:
        raise ValueError("size must be a multiple of 2 ** (levels - 1)")
    numbered = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    total = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    buckets = max(1, math.ceil(total / 6 / BUCKET_WINDOWS))
    blocked = numbered.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    grouped = blocked.groupBy("block")

    def send_first(key: tuple, rows: pa.Table) -> pa.Table:
        block = Block(rows, base, buckets)
        return _send(block, key[0].as_py(), base, levels == 1, block.candidates(base, {}))

    def sender(length: int):
        def send(key: tuple, rows: pa.Table, bits: pa.Table) -> pa.Table:
            block = Block(rows, base, buckets)
            starts = block.candidates(length, _complete(_answers(bits), length, base))
            return _send(block, key[0].as_py(), length, length == size, starts)

        return send

    def judge(last: bool):
        return lambda rows: _judge(rows, last)

    answers = grouped.applyInArrow(send_first, SENT)
    answers = answers.groupBy("bucket").applyInArrow(judge(levels == 1), ANSWER)
    length = base
    while length < size:
        length *= 2
        sent = grouped.cogroup(answers.groupBy("block")).applyInArrow(sender(length), SENT)
        more = sent.groupBy("bucket").applyInArrow(judge(length == size), ANSWER)
        answers = answers.union(more)

    def finish(key: tuple, rows: pa.Table, bits: pa.Table) -> pa.Table:
        block = Block(rows, base, buckets)
        known = _complete(_answers(bits), size * 2, base)
        starts = block.candidates(size, known)
        _, number, first = block.level(size, starts)
        later = np.ones(len(starts), bool)
        later[first] = known[size]
        gone = np.zeros(len(block.hash[0]) + 1, np.int64)
        np.add.at(gone, starts[later], 1)
        np.add.at(gone, starts[later] + size, -1)
        return _kept(block, np.cumsum(gone)[:-1] > 0, texts)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    schema += ", kept_text string" if texts else ""
    done = grouped.cogroup(answers.groupBy("block")).applyInArrow(finish, schema)

    def alone(rows: pa.Table) -> pa.Table:
        block = Block(rows, base, buckets)
        return _kept(block, np.zeros(len(block.hash[0]), bool), texts)

    spare = docs.filter("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), "text")
    lone = spare.groupBy(F.pmod(F.xxhash64("text"), F.lit(blocks)).alias("_k")).applyInArrow(alone, schema)
    return done.union(lone)


def _kept(block: Block, gone: np.ndarray, texts: bool) -> pa.Table:
    n, removed, digest, kept_text = [], [], [], []
    at = 0
    for w, _ in block.words:
        raw = w.data.tobytes()
        for k in range(len(w.first) - 1):
            a, b = int(w.first[k]), int(w.first[k + 1])
            out = gone[at + a : at + b]
            keep = np.flatnonzero(~out) + a
            joined = b" ".join([raw[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist())])
            n.append(b - a)
            removed.append(int(out.sum()))
            digest.append(hashlib.sha256(joined).hexdigest())
            kept_text.append(joined.decode() if texts else None)
        at += len(w.start)
    columns = [
        block.doc_ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
    ]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if texts:
        columns.append(pa.array(kept_text, pa.string()))
        names.append("kept_text")
    return pa.Table.from_arrays(columns, names)
