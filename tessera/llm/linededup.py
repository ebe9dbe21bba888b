"""Line dedup by content-defined chunks of lines.

A chunk ends after a line where a rolling hash over the hashes of it and the line before is smaller than
at both neighbours. Blank lines take no part in that: neighbours are the nearest lines that are not blank.
So boundaries follow the content alone, chunks have two such lines at least and three in the mean, and a
passage that starts at another place in another document falls into the same chunks after its first
one, whatever blank lines stand around it. Chunks of two or more lines that are not blank
are looked up by hash over all documents, from their first to their last such line. The first occurrence
(smallest doc_id, then position) stays; any other is removed once its bytes equal those of the first, with
the blank lines before it (and those at the end of the document after its last chunk).

Defined cases: a null text stays null. Rows without a doc_id take no part and stay as they are.
Rows that repeat a doc_id count as one document. A chunk whose hash equals the first's but whose
bytes differ stays. A document that loses all its lines has the empty text; one of blank lines alone stays.
Other columns pass through under their own names; where they hold the names of the two new columns, these take
more underscores in front. Memory in a task follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.store import stored

#: Occurrences of a chunk that one task compares with the first.
SHARE = 512
NEWLINE = 0x0A


class Chunks(NamedTuple):
    """Chunks of consecutive documents: byte spans with the blank lines around, without the last newline;
    spans from the first to the last line that is not blank, their hash, and number of such lines."""

    start: np.ndarray
    end: np.ndarray
    body: np.ndarray
    body_end: np.ndarray
    hash: np.ndarray
    full: np.ndarray
    first: np.ndarray


def _with_blank(c: Chunks, offsets: np.ndarray) -> Chunks:
    """One chunk without a line that is not blank for each document that has blank lines alone."""
    blank = np.flatnonzero((np.diff(c.first) == 0) & (np.diff(offsets) > 0))
    at = c.first[blank]
    start, end = offsets[blank], offsets[blank + 1]
    columns = [np.insert(old, at, new) for old, new in zip(c[:-1], (start, end, start, start, 0, 0))]
    return Chunks(*columns, c.first + np.searchsorted(blank, np.arange(len(offsets))))


def chunks(data: np.ndarray, offsets: np.ndarray) -> Chunks:
    """The chunks of each document, in order and without gaps but for the newlines between them."""
    breaks = np.flatnonzero(data == NEWLINE)
    start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    # A newline at the end of a document closes its last line and opens an empty one.
    inner = np.searchsorted(offsets, start, side="right") - 1
    tail = offsets[1:][np.diff(offsets) > 0]
    ended = tail[data[tail - 1] == NEWLINE] if len(tail) else tail
    owner = np.concatenate([inner[start < len(data)], np.searchsorted(offsets, ended, side="left") - 1])
    start = np.concatenate([start[start < len(data)], ended])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    stop = np.searchsorted(breaks, start)
    end = np.append(breaks, len(data))[stop]
    end = np.maximum(np.minimum(end, offsets[owner + 1]), start) if len(owner) else start
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~T.SPACE[data], out=words[1:])
    solid = np.flatnonzero(words[end] > words[start])
    if not len(solid):
        none = np.zeros(0, np.int64)
        empty = Chunks(none, none, none, none, np.zeros(0, np.uint64), none, np.zeros(len(offsets), np.int64))
        return _with_blank(empty, offsets)
    doc = owner[solid]
    line = T.span_hash(T._BYTES[0][data], start[solid], end[solid])
    opens = np.append(True, doc[1:] != doc[:-1])
    before = np.where(opens, T.U(0), np.roll(line, 1))
    rolled = T.mix(line + before * T.U(31))
    # A line opens a chunk if the one before it is a minimum within its document, but for the last.
    if len(rolled) > 3:
        low = (rolled[1:-2] < rolled[:-3]) & (rolled[1:-2] <= rolled[2:-1])
        inside = (doc[:-3] == doc[1:-2]) & (doc[1:-2] == doc[3:])
        opens[2:-1] |= low & inside
    opens = np.flatnonzero(opens)
    last = np.append(opens[1:], len(solid)) - 1
    body, body_end = start[solid[opens]], end[solid[last]]
    of = doc[opens]
    first = np.searchsorted(of, np.arange(len(offsets)))
    # Spans with blank lines: from the end of the chunk before, and to the end of the document.
    leads, trails = np.append(True, of[1:] != of[:-1]), np.append(of[1:] != of[:-1], True)
    whole_start = np.where(leads, offsets[of], np.append(0, body_end[:-1] + 1))
    whole_end = np.where(trails, offsets[of + 1], body_end)
    whole = T.span_hash(T._BYTES[1][data], body, body_end, 1)
    return _with_blank(Chunks(whole_start, whole_end, body, body_end, whole, last - opens + 1, first), offsets)


def _chunk_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, chunk, h`` of each chunk of two or more lines that are not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                c = chunks(data, offsets)
                of = np.repeat(np.arange(hi - lo), np.diff(c.first))
                place = np.arange(len(of)) - c.first[of]
                keep = c.full >= 2
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo + of[keep]]),
                        pa.array(place[keep].astype(np.int32)),
                        pa.array(T.signed(c.hash[keep])),
                    ],
                    ["doc_id", "chunk", "h"],
                )

    return docs.mapInArrow(run, "doc_id long, chunk int, h long")


def _chunk_bytes(rows: DataFrame) -> DataFrame:
    """``h, share, first, doc_id, chunk, bytes`` of the chunks that ``wanted`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2)
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                c = chunks(data, offsets)
                out: list[list] = [[] for _ in range(6)]
                for k in range(lo, hi):
                    at = c.first[k - lo]
                    for want in wanted[k].as_py():
                        place = at + want["chunk"]
                        if place >= c.first[k - lo + 1] or int(T.signed(c.hash)[place]) != want["h"]:
                            continue
                        found = data[c.body[place] : c.body_end[place]].tobytes()
                        for share in want["shares"]:
                            row = (want["h"], share, want["first"], ids[k], want["chunk"], found)
                            for column, value in zip(out, row):
                                column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, kinds)],
                    ["h", "share", "first", "doc_id", "chunk", "bytes"],
                )

    return rows.mapInArrow(
        run, "h long, share int, first boolean, doc_id long, chunk int, bytes binary"
    )


def _equal_to_first(rows: DataFrame) -> DataFrame:
    """``doc_id, chunk, h`` of the rows whose bytes are those of the first row of their share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            keep = []
            h, share, first = (batch.column(c).to_pylist() for c in range(3))
            found = batch.column(5)
            for k in range(batch.num_rows):
                if first[k]:
                    at, own = (h[k], share[k]), found[k].as_py()
                elif at == (h[k], share[k]) and found[k].as_py() == own:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(keep, pa.int32())) for c in (3, 4, 0)],
                ["doc_id", "chunk", "h"],
            )

    return (
        rows.repartition("h", "share")
        .sortWithinPartitions("h", "share", F.col("first").desc())
        .mapInArrow(run, "doc_id long, chunk int, h long")
    )


def repeated_chunks(texts: DataFrame) -> DataFrame:
    """``doc_id, chunk, h`` of each chunk of ``doc_id, text`` that an earlier one equals."""
    found = stored(_chunk_rows(texts))
    groups = stored(
        found.groupBy("h")
        .agg(
            F.min(F.struct("doc_id", "chunk")).alias("low"),
            F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("n > 1")
        .drop("n")
    )
    first = (F.col("doc_id") == F.col("low.doc_id")) & (F.col("chunk") == F.col("low.chunk"))
    dealt = F.pmod(F.xxhash64("doc_id", "chunk"), F.col("shares")).cast("int")
    listed = (
        found.join(groups, "h")
        .withColumn("first", first)
        .withColumn(
            "shares",
            F.when(first, F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(dealt)),
        )
        .distinct()
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("chunk", "h", "first", "shares")).alias("wanted"))
    )
    return _equal_to_first(_chunk_bytes(texts.join(listed, "doc_id"))).distinct()


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and the columns ``_lines_removed`` and
    ``_chunks_removed``."""
    added = ["_lines_removed", "_chunks_removed"]
    while set(added) & set(docs.columns):
        added = [f"_{name}" for name in added]
    numbered = docs.filter("doc_id IS NOT NULL")
    texts = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = (
        repeated_chunks(texts)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("chunk", "h")).alias("_gone"))
        .withColumnRenamed("doc_id", "_id")
    )
    spare = F.lit(None).cast("bigint")
    names = docs.columns
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, texts_ = batch.column(len(names)), batch.column(at_text)
            new, lines, cuts = [], [], []
            for lo, hi, data, offsets in T.slices(texts_):
                c = chunks(data, offsets)
                for k in range(lo, hi):
                    if not lists[k].is_valid:
                        new.append(texts_[k].as_py())
                        lines.append(0)
                        cuts.append(0)
                        continue
                    a, b = c.first[k - lo], c.first[k - lo + 1]
                    out = {
                        g["chunk"] for g in lists[k].as_py()
                        if a + g["chunk"] < b and int(T.signed(c.hash)[a + g["chunk"]]) == g["h"]
                    }
                    kept = [data[c.start[p] : c.end[p]] for p in range(a, b) if p - a not in out]
                    new.append(b"\n".join(x.tobytes() for x in kept).decode())
                    lines.append(
                        sum(1 + int((data[c.start[a + p] : c.end[a + p]] == NEWLINE).sum()) for p in out)
                    )
                    cuts.append(len(out))
            columns = list(batch.columns[: len(names)])
            columns[at_text] = pa.array(new, batch.schema.field(at_text).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int64()), pa.array(cuts, pa.int64())],
                [*batch.schema.names[: len(names)], *added],
            )

    zero = docs.withColumns({name: spare for name in added})
    marked = numbered.join(gone, numbered["doc_id"].cast("long") == gone["_id"], "left").select(
        *[numbered[c] for c in names], gone["_gone"]
    )
    rewritten = marked.mapInArrow(run, zero.schema)
    untouched = docs.filter("doc_id IS NULL").withColumns(
        {name: F.lit(0).cast("long") for name in added}
    )
    return rewritten.unionByName(untouched)
