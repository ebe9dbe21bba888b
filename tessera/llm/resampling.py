"""Importance resampling towards a target distribution, ranked by parallel sorting by regular sampling.

Features are all runs of one and two words, hashed to ``BUCKETS`` buckets by the crc32 of their bytes. A bucket's
gain is the logarithm of its share among the target texts over its share in the corpus, both
smoothed; a document's weight is the mean gain of its features. A Gumbel draw, seeded by the document
number, is added, and the highest scores are drawn: a sample without replacement in proportion to the
weights.

Scores come from arrays: tasks hash the words of whole batches with numpy and look the gains up, and either
pass over the corpus returns one number for each bucket and task or one row for each document. Ranks:

1. each task sorts its rows (a run) and the runs are written, every row with its run and place;
2. rows at regular places of all runs, about ``segments ** 2`` of them, give the splitters;
3. rows go to the segment between two splitters, where the runs' parts are merged by a local sort;
4. counts of the segments, summed up, turn a place in a segment into an exact rank.

Run and place end the order, so no two rows are equal in it: however many rows tie, no segment
exceeds about two shares of all rows.

Defined cases: a null, empty or wordless text has no features and weight 0. Each row is a document, so repeated
rows are ranked each, one after the other. A row without a doc_id draws as one with an empty number and
stands after others of equal score. Without target texts every bucket has its smoothed share. A draw of
less than one document draws none. A task holds its longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.store import stored

BUCKETS = 10_000
#: Documents of fewer words are not drawn.
MIN_WORDS = 20
#: Segments at most; the driver sees about their square in sampled rows.
MAX_SEGMENTS = 64
#: Words of more bytes are hashed one by one.
LONG_WORD = 48
#: The order of scores: highest first, then the smaller number, then what makes rows distinct.
ORDER = ["back", "id", "n_features", "run", "place"]
NO_ID = (1 << 63) - 1

#: Byte classes: 1 letters, digits and bytes past ASCII, 0 separators. A-Z are lower-cased before.
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _extend(state: np.ndarray, w: T.Words, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """crc32 registers ``state`` after the bytes of the words ``at``."""
    state = state.copy()
    start, size = w.start[at], w.end[at] - w.start[at]
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    now = state[order]
    long = int(np.searchsorted(-size, -LONG_WORD))
    for k in range(long):
        piece = data[start[k] : start[k] + size[k]].tobytes()
        now[k] = zlib.crc32(piece, int(now[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(int(size[long]) if long < len(size) else 0):
        end = int(np.searchsorted(-size, -j))  # words of more than j bytes
        part = now[long:end]
        now[long:end] = _CRC[(part ^ data[start[long:end] + j]) & 255] ^ (part >> 8)
    state[order] = now
    return state


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
    """Buckets of all features, the document of each, and the words of each document."""
    w = T.words(data, offsets, KINDS)
    low = T.LOWER[w.data]
    n = w.count()
    every = np.arange(len(w.start))
    state = _extend(np.full(len(every), 0xFFFFFFFF, np.uint32), w, every, low)
    pair, first = T.windows(w.first, 2)
    space = _CRC[(state[pair] ^ np.uint32(0x20)) & 255] ^ (state[pair] >> 8)
    both = _extend(space, w, pair + 1, low)
    found = np.concatenate([state, both]) ^ np.uint32(0xFFFFFFFF)
    owner = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), np.diff(first))])
    return (found % np.uint32(buckets)).astype(np.int64), owner, n


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column(0)):
                total += np.bincount(features(data, offsets, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    partial = texts.select("text").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in partial.groupBy("bucket").agg(F.sum("n")).collect():  # at most one for each bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares."""
    s, t, n = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id, n_words, n_features, weight`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                found, owner, words = features(data, offsets, len(gain))
                n = np.bincount(owner, minlength=hi - lo)
                # Sums of integers below 2**53 are exact in doubles.
                total = np.bincount(owner, gain[found], minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _sorted_runs(rows: DataFrame) -> DataFrame:
    """Every row with its run and its place there; rows that can be drawn come first."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = np.arange(place, place + batch.num_rows)
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(at), run)), pa.array(at)],
                [*batch.schema.names, "run", "place"],
            )

    keyed = rows.select(
        "*", (-F.col("score")).alias("back"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id")
    ).sortWithinPartitions(F.col("drawable").desc(), *ORDER[:3])
    schema = ", ".join(f"{name} {kind}" for name, kind in keyed.dtypes)
    return keyed.mapInArrow(number, f"{schema}, run long, place long")


def ranked(rows: DataFrame, segments: int) -> tuple[DataFrame, int]:
    """``doc_id, score, n_features, drawable, ...`` with the exact ``rank`` of drawable rows; their number."""
    runs = stored(_sorted_runs(rows))
    drawable = runs.filter("drawable")
    n = drawable.count()
    stride = max(1, n // segments**2)
    regular = drawable.filter(F.col("place") % stride == stride - 1).select(*ORDER)
    sampled = sorted(tuple(r) for r in regular.collect())  # about segments ** 2 + runs
    splitters = sampled[:: max(1, len(sampled) // segments)][1:segments]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ORDER]
            segment = np.zeros(batch.num_rows, np.int32)
            for splitter in splitters:
                after = np.ones(batch.num_rows, bool)
                for key, value in zip(reversed(keys), reversed(splitter)):
                    after = (key > value) | ((key == value) & after)
                segment += after
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(segment)], [*batch.schema.names, "segment"]
            )

    schema = ", ".join(f"{name} {kind}" for name, kind in runs.dtypes)
    dealt = drawable.mapInArrow(place, f"{schema}, segment int")
    sizes = dict(dealt.groupBy("segment").count().collect())  # one row for each segment
    before = np.zeros(segments + 1, np.int64)
    for segment, size in sizes.items():
        before[segment + 1] = size
    before = np.cumsum(before)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(segments, np.int64)
        for batch in batches:
            segment = batch.column("segment").to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else []
            out = np.zeros(len(segment), np.int64)
            for lo, hi in zip(start, [*start[1:], len(segment)]):
                own = segment[lo]
                out[lo:hi] = before[own] + seen[own] + np.arange(1, hi - lo + 1)
                seen[own] += hi - lo
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "rank"])

    merged = dealt.repartitionById(segments, "segment").sortWithinPartitions("segment", *ORDER)
    done = merged.mapInArrow(rank, f"{schema}, segment int, rank long").select(*rows.columns, "rank")
    rest = runs.filter("NOT drawable").select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return done.union(rest), n


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, min_words: int = MIN_WORDS,
    segments: int | None = None,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` of drawn ones only."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs), bucket_counts(target))
    number = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(number.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = _weighed(docs, gain).select(
        "doc_id", "n_features", "weight", (F.col("weight") + gumbel).alias("score"),
        (F.col("n_words") >= min_words).alias("drawable"),
    )
    if segments is None:
        segments = max(1, min(MAX_SEGMENTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    done, n = ranked(rows, segments)
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    return done.select("doc_id", "n_features", "weight", "score", drawn.alias("rank"))
