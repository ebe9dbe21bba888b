"""Mixing sources to target weights with integer quotas by Sainte-Lague.

A source's target share follows its weight, up to a number of passes over its text. The mix is cut
into blocks of equal length in words; the blocks go to sources by the highest quotients
``target / (2 j - 1)``, and each source's blocks to its shards (of about ``SHARD_DOCS`` documents,
by a seeded hash) in the same way, by the shards' words. A shard lays its documents end to end in a
seeded order and takes its quota of blocks from the front, a whole pass at a time.

The highest quotients are found without one row for each block: a lower bound of the threshold
gives each party most of its seats at once, and only the at most 2n quotients between both bounds
of the threshold are ranked for n parties.

Defined cases: a null text has 0 words, and takes part with a size of 0. A null source is a source of
its own, ranked last. A null doc_id is an ordinary row. Repeated rows each count. An empty table gives
an empty mix. All draws are hashes of the row, so a rerun or a retried task gives the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import stored
from tessera.operators.ordering import running_positions

#: Words of a block, documents of a shard.
BLOCK_WORDS, SHARD_DOCS = 16, 1000
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(
    parties: DataFrame, group: Sequence[str], votes: str, seats: str, tie: Sequence[Column]
) -> DataFrame:
    """``parties`` with ``quota``: the ``seats`` of the group by highest quotients of the votes.

    Equal quotients go to the first by ``tie``. Parties without votes get nothing.
    """
    whole = Window.partitionBy(*group)
    v, n, s = F.col("_v"), F.col("_n"), F.col(seats)

    def seats_above(threshold: Column) -> Column:
        return F.floor((v / threshold + 1) / 2).cast("long")

    # With threshold x a group fills between V/2x - n/2 and V/2x + n/2 seats.
    high = F.when(s * 2 > n, F.col("_total") / (s * 2 - n))
    low = F.col("_total") / (s * 2 + n)
    bounded = (
        parties.withColumn("_v", F.coalesce(F.col(votes).cast("double"), F.lit(0.0)))
        .withColumn("_total", F.sum("_v").over(whole))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_sure", F.when(v > 0, F.coalesce(seats_above(high), F.lit(0))).otherwise(0))
        .withColumn("_most", F.when((v > 0) & (s > 0), seats_above(low)).otherwise(0))
        .withColumn("_open", F.greatest(s - F.sum("_sure").over(whole), F.lit(0)))
    )
    next_ = F.explode_outer(
        F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_most")))
    )
    ranked = bounded.withColumn("_seat", next_).withColumn(
        "_rank",
        F.row_number().over(whole.orderBy((v / (F.col("_seat") * 2 - 1)).desc_nulls_last(), *tie)),
    )
    won = (F.col("_seat").isNotNull() & (F.col("_rank") <= F.col("_open"))).cast("long")
    return ranked.groupBy(*parties.columns).agg((F.max("_sure") + F.sum(won)).alias("quota"))


def targets(sources: DataFrame, weights: Sequence[int], percent: int, passes: int) -> DataFrame:
    """``source, size, rank, target`` of each source: shares by weight, at most ``passes`` sizes.

    A source is full once its size per weight is below the level that all others share. Ordered by
    that ratio the full sources come first, so the level follows from running sums.
    """
    ranked = running_positions(
        sources.withColumn("_all", F.lit(1)).withColumn("_last", F.col("source").isNull()),
        ["_all"], ["_last", "source"],
    )
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("before") % len(weights) + 1).cast("int")
    )
    ranked = (
        ranked.select("source", "size", "_all", F.col("before").alias("rank"), weight.alias("w"))
        .withColumn("cap", F.col("size") * passes)
        .withColumn("_ratio", F.col("cap") / F.col("w"))
    )
    by_cap = running_positions(ranked, ["_all"], ["_ratio", "rank"], "cap").select(
        "*", F.col("before").alias("cap_before"), F.col("group_total").alias("cap_total")
    ).drop("before", "group_total")
    both = running_positions(by_cap, ["_all"], ["_ratio", "rank"], "w")
    pool = F.col("cap_total") / passes * (percent / 100)
    level = (pool - F.col("cap_before")) / (F.col("group_total") - F.col("before"))
    both = stored(both.withColumn("_level", level))
    # The first source that its share does not fill sets the level.
    found = both.agg(F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "rank", "_level"))).alias("m"))
    joined = both.join(F.broadcast(found))  # one row
    at = F.col("m._level") * F.col("w")
    return joined.select(
        "source", "size", "rank",
        F.coalesce(F.least(F.col("cap").cast("double"), at), F.col("cap").cast("double")).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    percent: int = 150,
    passes: int = 2,
    seed: int = 20,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``source`` for every document.

    ``weights`` repeat over the sources in code point order; together the sources give ``percent``
    of all words, none more than ``passes`` times its own.
    """
    rows = stored(
        docs.select(
            "doc_id", "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id").alias("_deal"),
            F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("_order"),
        )
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    aimed = targets(sources.select("source", "size"), weights, percent, passes)
    blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block_words).cast("long")
    quotas = sainte_lague(
        aimed.withColumn("seats", blocks).withColumn("_all", F.lit(1)),
        ["_all"], "target", "seats", [F.col("rank")],
    ).withColumnRenamed("size", "source_size").drop("seats", "_all")
    plan = stored(
        quotas.alias("q")
        .join(sources.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s")))
        .select(
            "source", "source_size", "target", "quota",
            F.greatest(F.ceil(F.col("n") / SHARD_DOCS), F.lit(1)).cast("long").alias("shards"),
        )
    )
    dealt = stored(
        rows.alias("r")
        .join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("shard", F.pmod("_deal", "shards"))
        .drop("_s", "_deal", "shards")
    )
    shards = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("words"), F.max("quota").alias("seats")
    )
    shares = sainte_lague(shards, ["source"], "words", "seats", [F.col("shard")])
    order = Window.partitionBy("source", "shard").orderBy("_order", "doc_id")
    before = F.coalesce(
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = dealt.withColumn("_before", before)
    own = shares.select(
        F.col("source").alias("_s"), F.col("shard").alias("_k"), "words",
        F.least(F.col("quota") * block_words, F.col("words") * passes).alias("_take"),
    )
    full = F.when(F.col("words") > 0, F.floor(F.col("_take") / F.col("words"))).otherwise(0)
    part = F.least(
        F.greatest(F.col("_take") - full * F.col("words") - F.col("_before"), F.lit(0)), F.col("size")
    )
    return placed.join(
        own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_k"))
    ).select(
        "doc_id", "size", "source_size", "target",
        (full * F.col("size") + part).cast("long").alias("taken"), "source",
    )
