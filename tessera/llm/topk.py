"""Exact top-k inner products by a three-phase uniform threshold.

A score is a sum of local scores, one for each group of components; every task holds a block of
queries and a shard of candidates and ranks local lists of each group.

1. Each task takes the k best of every local list, scores those fully, and reports its k best scores.
   The k-th best of all reports is a score that at least k candidates reach: a safe cutoff.
2. Each query carries its cutoff to all shards. Local scores are shifted by their minimum, so
   that a candidate at or above the cutoff has, in one group at least, the cutoff's even share.
   Those entries are sufficient; all others are out.
3. The scores of sufficient entries are resolved in full, those below the cutoff dropped, and at most
   k of each shard ranked together.

Components are ``floor(64 x)``, so scores are integers, and exact: in float64 while every possible sum
stays below 2**53, in int64 beyond that.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without a
vec_id, take no part. Shorter vectors count as filled up with zeros. Ties go to the smaller vec_id. A
query never finds rows of its own vec_id; other repeated rows are candidates each. Repeated rows that
select a query are one query. A query with fewer
than k candidates gets them all. Score and components must fit a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of components, rows of a shard, queries of a block, queries scored at once.
GROUPS, SHARD_ROWS, BLOCK_ROWS, AT_ONCE = 4, 4096, 1024, 128
SCALE = 64.0


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vector numbers and quantised components, shorter vectors filled up with zeros."""
    rows = rows.select([0, 1]).rename_columns(["id", "vector"]).combine_chunks().sort_by("id")
    vectors = rows.column("vector").combine_chunks()
    lengths = np.asarray(pc.list_value_length(vectors)).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(
        SCALE * np.asarray(vectors.flatten()).astype(np.float64)
    )
    return np.asarray(rows.column("id")), out


class Lists:
    """Local score lists of a block of queries over a shard of candidates."""

    def __init__(self, queries: pa.Table, candidates: pa.Table) -> None:
        self.query, q = _matrix(queries)
        self.vec, c = _matrix(candidates)
        width = max(q.shape[1], c.shape[1])
        q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
        if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(width, 1) >= 2.0**53:
            q, c = q.astype(np.int64), c.astype(np.int64)
        self.q, self.c = q, np.ascontiguousarray(c.T)
        self.groups = [g for g in np.array_split(np.arange(width), GROUPS) if len(g)] or [np.arange(0)]
        self.own = np.stack([np.searchsorted(self.vec, self.query, s) for s in ("left", "right")], 1)

    def parts(self, lo: int):
        """For queries from ``lo`` on: the local scores of each group, and the rows of each's own."""
        hi = min(lo + AT_ONCE, len(self.query))
        local = [self.q[lo:hi, g] @ self.c[g] for g in self.groups]
        own = [(k, slice(*self.own[lo + k])) for k in range(hi - lo) if np.diff(self.own[lo + k])[0]]
        return local, own

    def known(self, k: int) -> pa.Table:
        """Phase one: the k best full scores among the k best of each local list."""
        out = []
        for lo in range(0, len(self.query), AT_ONCE):
            local, own = self.parts(lo)
            listed = np.zeros(local[0].shape, bool)
            take = min(k + 1, listed.shape[1])
            for scores in local:
                best = np.argpartition(scores, -take, axis=1)[:, -take:]
                np.put_along_axis(listed, best, True, axis=1)
            for row, rows in own:
                listed[row, rows] = False
            for i in range(len(listed)):
                at = np.flatnonzero(listed[i])
                full = sum(scores[i, at] for scores in local)
                out.append(np.sort(full)[::-1][:k].astype(np.int64))
        return pa.table(
            {"query_id": pa.array(self.query), "scores": pa.array(out, pa.list_(pa.int64()))}
        )

    def sufficient(self, k: int, cutoff: dict[int, int]) -> pa.Table:
        """Phases two and three: the k best at or above the cutoff."""
        found: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(self.query), AT_ONCE):
            local, own = self.parts(lo)
            floor = [scores.min(axis=1) for scores in local]
            cuts = [cutoff.get(int(q)) for q in self.query[lo : lo + AT_ONCE]]
            none = np.array([c is None for c in cuts])
            share = np.array([0 if c is None else c for c in cuts]) - sum(floor)
            enough = np.zeros(local[0].shape, bool)
            for scores, low in zip(local, floor):
                enough |= (scores - low[:, None]) * len(local) >= share[:, None]
            enough[none] = True
            for row, rows in own:
                enough[row, rows] = False
            for i in range(len(enough)):
                at = np.flatnonzero(enough[i])
                full = sum(scores[i, at] for scores in local)
                if cuts[i] is not None:
                    at, full = at[full >= cuts[i]], full[full >= cuts[i]]
                order = np.lexsort((self.vec[at], -full))[:k]
                query = np.full(len(order), self.query[lo + i])
                found.append((query, self.vec[at[order]], full[order].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(["query_id", "vec_id", "score"], columns)))


def top_k(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row that ``queries`` selects."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(~bad)
    rows = usable.select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", queries.alias("asks")
    )
    n, asking = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asking / BLOCK_ROWS))

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    candidates = rows.select(
        "vec_id", "embedding",
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
        every(blocks).alias("block"),
    ).groupBy("block", "shard")
    asked = rows.filter("asks").select(
        F.col("vec_id").alias("asked_id"), F.col("embedding").alias("asked"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("to_block"),
    ).dropDuplicates(["asked_id"])

    def lists(left: pa.Table, right: pa.Table) -> Lists | None:
        return Lists(right, left) if left.num_rows and right.num_rows else None

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        found = lists(left, right)
        empty = pa.table({"query_id": pa.array([], pa.int64()), "scores": pa.array([], pa.list_(pa.int64()))})
        return found.known(k) if found else empty

    reports = candidates.cogroup(
        asked.withColumn("to_shard", every(shards)).groupBy("to_block", "to_shard")
    ).applyInArrow(first, "query_id long, scores array<long>")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    cutoffs = (
        reports.select("query_id", F.explode("scores").alias("score"))
        .withColumn("place", F.row_number().over(by_score))
        .filter(F.col("place") <= k)
        .filter(F.col("place") == k)
        .select("query_id", F.col("score").alias("cutoff"))
    )

    def rest(left: pa.Table, right: pa.Table) -> pa.Table:
        found = lists(left, right)
        if not found:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        ids, cuts = (right.column(c).to_pylist() for c in ("asked_id", "cutoff"))
        return found.sufficient(k, {i: c for i, c in zip(ids, cuts) if c is not None})

    cut = asked.join(cutoffs, F.col("asked_id") == F.col("query_id"), "left").drop("query_id")
    found = candidates.cogroup(
        cut.withColumn("to_shard", every(shards)).groupBy("to_block", "to_shard")
    ).applyInArrow(rest, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
