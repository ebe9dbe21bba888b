"""MinHash near-duplicates with tensored banding and exact verification.

A document's set holds the distinct hashes of its shingles of consecutive words. ``HALVES`` half keys
of ``ROWS`` minhashes each are computed for either of two collections; the key of a table is one half
key of the first collection with one of the second. So ``HALVES**2`` tables of ``2 * ROWS`` minhashes
cost ``2 * HALVES * ROWS`` minhashes instead of ``2 * ROWS * HALVES**2``. Two sets of similarity s
meet in no table with probability ``1 - (1 - (1 - s**ROWS)**HALVES)**2``: 6e-6 at 0.85, 8e-5 at 0.8.

Documents of equal sets become one row first, so copies are never paired. The rows of a table's bucket
are compared with one leader, the row that shares most table keys with others. What remains are links
past a leader, between rows of which one failed. Seen from any common set c, rows x and y differ by
``X = x xor c`` and ``Y = y xor c``, and ``|x xor y| = |X xor Y|``. With the leader's differences at hand, c is moved
to the set that most of its rows agree on, so that X holds only what x has, or lacks, beside most others:

* rows so near to c that they must be similar to the row nearest to c are compared with that one;
* any other similar pair shares elements of X and Y, and a prefix-filter join finds it: elements stand
  by their count within the leader's rows, rarest first, so those of one row alone come first and never
  meet; filters for size, position and component follow.

Where such lists are crowded, all rows of a list are first compared with one of them, for up to ``ROUNDS``
rounds, and only what these links leave unconnected is paired. So a bucket is not expanded
into its pairs, and no link between rows that share a bucket is lost: similarity is computed on the full
sets, from the texts, and a pair that is passed over is either connected or too far apart. What is left
are pairs of rows that have a rare element in common and enough others to be similar, but are not
connected; a group of copies edited at few places, all just short of the threshold, still has many.

Defined cases: a null or blank text has no set, and is its own component. A text of fewer words than
a shingle is one shingle, its whole sequence. Rows without a doc_id link with nothing and have no
component; they are kept. Repeated rows with one doc_id share a component and each is returned; of different
texts under one doc_id the smallest is compared with other documents.
Memory in a task follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.linking import components
from tessera.llm.store import stored

#: Half keys in each of the two collections, minhashes in each half key.
HALVES, ROWS = 10, 2
#: Rows that one task compares with their leader.
SHARE = 256
#: If lists of rows with a rare element in common hold more than ``CROWDED`` pairs for each row, all rows of
#: those longer than ``LIST`` are compared with one of them first, up to so many times.
CROWDED, LIST, ROUNDS = 256, 8, 2

_seeds = np.random.Generator(np.random.PCG64(85)).integers(
    1, 1 << 63, (2, 2 * HALVES * ROWS), np.uint64
) | T.U(1)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, size: int, lower: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each document, and each document's first."""
    w = T.words(data, offsets)
    h = T.word_hash(w, lower=lower)
    at, first = T.windows(w.first, size)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found = T.span_hash(h, at, at + size)
    short = np.flatnonzero((w.count() > 0) & (w.count() < size))
    if len(short):
        whole = T.span_hash(h, w.first[short], w.first[short + 1])
        found, owner = np.concatenate([found, whole]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(offsets)))


def half_keys(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``2 * HALVES`` half keys of each (non-empty) set: the first collection, then the second."""
    keys = np.zeros((len(first) - 1, 2 * HALVES), np.uint64)
    for k in range(2 * HALVES * ROWS):
        low = np.minimum.reduceat((found ^ _seeds[0, k]) * _seeds[1, k], first[:-1])
        keys[:, k // ROWS] = T.mix(keys[:, k // ROWS] + low + T.U(k))
    return keys


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, f1, f2, half``: set size, 128-bit set fingerprint and half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                found, first = shingle_sets(data, offsets, size)
                n = np.diff(first)
                some = n > 0
                half = np.zeros((hi - lo, 2 * HALVES), np.uint64)
                sums = []
                for seed in (0x1234567, 0x89ABCDE):
                    total = np.zeros(len(found) + 1, np.uint64)
                    np.cumsum(T.mix(found + T.U(seed)), out=total[1:])
                    sums.append(T.signed(T.mix(total[first[1:]] - total[first[:-1]])))
                if some.any():
                    starts = np.append(first[:-1][some], len(found))
                    half[some] = half_keys(found, starts)
                at = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * (2 * HALVES))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(n),
                        *(pa.array(s, mask=~some) for s in sums),
                        pa.ListArray.from_arrays(at, pa.array(T.signed(half.ravel()))),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "half"],
                )

    schema = "doc_id long, n_shingles long, f1 long, f2 long, half array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _against_leaders(pairs: DataFrame, texts: DataFrame, size: int, judge, schema: str) -> DataFrame:
    """``judge(a, b, own, its)`` of each pair ``a, b``: full sets of ``_id, text``, rows after rows.

    A row ``a`` with many partners is sent, text and all, once for each share of them.
    """
    many = (
        pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)).alias("_shares"))
        .filter(F.col("_shares") > 1)
    )
    share = F.pmod(F.xxhash64("b"), F.coalesce("_shares", F.lit(1))).cast("int")
    dealt = stored(pairs.join(many, "a", "left").select("a", "b", share.alias("share")))
    # Texts are joined by a shuffle at any size, never by sending one side to all.
    texts = texts.hint("merge")
    partners = dealt.join(texts, F.col("b") == F.col("_id")).select("a", "share", "b", "text")
    leaders = (
        dealt.select("a", "share").distinct().join(texts, F.col("a") == F.col("_id"))
        .select("a", "share", F.lit(None).cast("long").alias("b"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, share, b = (batch.column(c).to_pylist() for c in range(3))
            rows = []
            for lo, hi, data, offsets in T.slices(batch.column(3)):
                found, first = shingle_sets(data, offsets, size)
                for k in range(lo, hi):
                    its = found[first[k - lo] : first[k - lo + 1]]
                    if b[k] is None:
                        at, own = (a[k], share[k]), its
                    elif at == (a[k], share[k]) and len(own):
                        rows.append(judge(a[k], b[k], own, its))
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], arrow)

    names = [field.split()[0] for field in schema.split(", ")]
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return (
        partners.union(leaders)
        .repartition("a", "share")
        .sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
        .mapInArrow(run, schema)
    )


def compare(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``a, b, na, nb, common, total`` of each pair, from the full sets."""

    def judge(a: int, b: int, own: np.ndarray, its: np.ndarray) -> tuple:
        place = np.minimum(np.searchsorted(own, its), len(own) - 1)
        common = int((own[place] == its).sum())
        return a, b, len(own), len(its), common, len(own) + len(its) - common

    return _against_leaders(
        pairs, texts, size, judge, "a long, b long, na long, nb long, common long, total long"
    )


def differences(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``a, b, differs``: all elements of one set alone, of each pair."""

    def judge(a: int, b: int, own: np.ndarray, its: np.ndarray) -> tuple:
        return a, b, T.signed(np.setxor1d(own, its, assume_unique=True))

    return _against_leaders(pairs, texts, size, judge, "a long, b long, differs array<long>")


def candidates(reps: DataFrame) -> DataFrame:
    """``a, b``: every row of a table's bucket with the bucket's leader."""
    keys = reps.select(
        "rep", "half", F.posexplode(F.slice("half", 1, HALVES)).alias("i", "u")
    ).select("rep", "i", "u", F.posexplode(F.slice("half", HALVES + 1, HALVES)).alias("j", "v"))
    rows = keys.select(F.xxhash64("i", "u", "j", "v").alias("key"), F.col("rep").alias("b"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(rows.join(counted.hint("merge"), "key"))
    meets = shared.groupBy("b").agg(F.sum("n").alias("meets"))
    leaders = (
        shared.join(meets, "b").groupBy("key")
        .agg(F.max_by("b", F.struct("meets", -F.col("b"))).alias("a"))
    )
    return stored(shared.join(leaders, "key").filter("a <> b").select("a", "b").distinct())


def links(reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: links between distinct sets that connect all that share a bucket and are similar."""
    pairs = candidates(reps)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").hint("merge")
    texts = stored(ids.join(texts, "_id").groupBy("_id").agg(F.min("text").alias("text")))
    linked = F.col("common") * 100 >= F.col("total") * percent

    def more_links(known: DataFrame, asked: DataFrame) -> DataFrame:
        asked = stored(asked.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if asked.isEmpty():
            return known
        return known.union(stored(compare(asked, texts, size).filter(linked).select("a", "b")))

    judged = stored(compare(pairs, texts, size).withColumn("linked", linked))
    known = judged.filter("linked").select("a", "b")
    rows = stored(_open_groups(judged, components(known)))
    if rows.isEmpty():
        return known
    differs = differences(rows.filter("a <> b").select("a", "b"), texts, size)
    placed, entries = _rare_elements(rows, differs, percent)
    lists = stored(_lists(entries))
    turn, most = 0, CROWDED * rows.count()
    while turn < ROUNDS and _volume(lists) > most:
        long = lists.filter(F.col("size") > LIST)
        heads = long.groupBy("a", "e").agg(F.min_by("b", F.xxhash64("b", F.lit(turn))).alias("head"))
        known = more_links(known, long.join(heads, ["a", "e"]).select(F.col("head").alias("a"), "b"))
        lists = stored(_lists(_rooted(entries, components(known))))
        turn += 1
    # Near rows are linked through their centre in any case, so these pairs need not wait for that.
    return more_links(known, _near_centre(placed).union(_pairs(lists, percent)))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of ``b`` as ``root``."""
    rows, roots = rows.drop("root"), roots.withColumnRenamed("node", "b")
    return rows.join(roots, "b", "left").withColumn("root", F.coalesce("root", "b"))


def _open_groups(judged: DataFrame, roots: DataFrame) -> DataFrame:
    """``a, b, n, d, root``: rows of the leaders whose rows are not all connected, the leader included."""
    own = judged.groupBy("a").agg(F.max("na").alias("n"))
    rows = judged.select("a", "b", F.col("nb").alias("n"), (F.col("total") - F.col("common")).alias("d"))
    rows = rows.union(own.select("a", F.col("a").alias("b"), "n", F.lit(0).cast("long")))
    # The leader's own row always has its root, so groups of linked rows alone are not open.
    ends = _rooted(rows, roots).groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return _rooted(rows, roots).join(ends.filter("lo <> hi").select("a"), "a", "left_semi")


def _rare_elements(rows: DataFrame, differs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their distance from their group's centre, and the prefix of each row's elements.

    The centre is what most rows of the group agree on: an element that more than half of them have
    counts for those without it. Let ``t = (100 + percent) d - (100 - percent) n`` for a row of n elements
    at distance d from the centre, and ``low`` the least t of the group. Two rows with a sum of t up to 0
    are similar whatever they share. A row is near if its t and ``low`` sum up to at most 0, else far. A
    similar pair that is not of two near rows has a far row x, the farther if both are, with at
    most ``most`` elements outside Y, all that any similar set allows; from d of x > its share of n less ``low``
    it follows that Y has at most ``((100 + percent) d + (100 - percent) n + low) / 2 (100 + percent)`` outside
    X, and at most half of ``most`` if it is the nearer one of two far rows. In the order common to all, a
    prefix of each longer by one has an element of both.
    """
    plus, minus = 100 + percent, 100 - percent
    each = stored(rows.join(differs, ["a", "b"]).select("a", "b", F.explode("differs").alias("e")))
    sizes = rows.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    most_have = F.col("rows") * 2 > F.col("size")
    counted = stored(
        each.groupBy("a", "e").agg(F.count(F.lit(1)).alias("rows")).join(sizes, "a")
        .select("a", "e", most_have.alias("major"), F.when(most_have, F.col("size") - F.col("rows")).otherwise(F.col("rows")).alias("rare"))
    )
    has = each.join(counted, ["a", "e"]).select("a", "b", "e", "rare", "major", F.lit(True).alias("has"))
    lacks = (
        rows.select("a", "b").join(counted.filter("major AND rare > 0"), "a")
        .join(each, ["a", "b", "e"], "left_anti")
        .select("a", "b", "e", "rare", "major", F.lit(False))
    )
    counts = F.col("rare") > 1
    moved = has.union(lacks).groupBy("a", "b").agg(
        F.sum(F.when(F.col("major") & F.col("has"), -1).when(F.col("major"), 1).otherwise(0)).alias("change"),
        F.sort_array(
            F.collect_list(F.when(counts & (F.col("major") != F.col("has")), F.struct("rare", "e")))
        ).alias("met"),
    )
    none = F.array().cast("array<struct<rare:bigint,e:bigint>>")
    placed = rows.join(moved, ["a", "b"], "left").select(
        "a", "b", "n", "root", (F.col("d") + F.coalesce("change", F.lit(0))).alias("d"),
        F.coalesce("met", none).alias("met"),
    )
    t = F.col("d") * plus - F.col("n") * minus
    placed = stored(placed.withColumn("t", t))
    first = F.min_by(F.struct("b", "root"), F.struct("t", "b")).alias("first")
    nearest = placed.groupBy("a").agg(F.min("t").alias("low"), first)
    near = F.col("t") + F.col("low") <= 0
    placed = stored(
        placed.join(nearest, "a").withColumns(
            {"near": near, "centre": F.col("first.b"), "root": F.when(near, F.col("first.root")).otherwise(F.col("root"))}
        )
    )
    most = F.expr(f"({minus} * (n + n * 100 div {percent})) div {plus}")
    outside = F.floor((F.col("d") * plus + F.col("n") * minus + F.col("low")) / (2 * plus))
    outside = F.when(F.col("near"), outside).otherwise(F.least(outside, F.floor(most / 2)))
    alone = F.col("d") - F.size("met")
    columns = ["a", "b", "root", "near", "n", "d", "most", "outside", "alone"]
    entries = (
        placed.withColumns({"most": most, "outside": outside, "alone": alone})
        .withColumn("take", F.when(F.col("near"), F.col("outside")).otherwise(F.greatest("outside", "most")) + 1 - F.col("alone"))
        .withColumn("met", F.slice("met", F.lit(1), F.greatest("take", F.lit(0)).cast("int")))
        .select(*columns, F.posexplode("met").alias("place", "m"))
        .select(*columns, (F.col("place") + F.col("alone")).alias("at"), "m.e")
    )
    return placed, stored(entries)


def _near_centre(placed: DataFrame) -> DataFrame:
    """``a, b``: the row nearest to each centre with all that are near."""
    return placed.filter("near").select(F.col("centre").alias("a"), "b")


def _lists(entries: DataFrame) -> DataFrame:
    """Entries of the lists, with their ``size``, whose rows are not all connected."""
    left = (
        entries.groupBy("a", "e")
        .agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        .filter("size > 1 AND lo <> hi")
    )
    return entries.join(left.select("a", "e", "size"), ["a", "e"])


PROBES, LISTED = "NOT near AND at <= most", "at <= outside"


def _volume(entries: DataFrame) -> int:
    """Pairs that a join of the lists looks at."""
    each = entries.groupBy("a", "e").agg(F.count_if(F.expr(PROBES)).alias("x"), F.count_if(F.expr(LISTED)).alias("y"))
    return each.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0


def _pairs(entries: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of a list that may be similar and are not connected so far."""
    probes, listed = entries.filter(PROBES).alias("x"), entries.filter(LISTED).alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    allowed = F.floor((x("n") + y("n")) * (100 - percent) / (100 + percent))
    needed = F.ceil((x("d") + y("d") - allowed) / 2)
    smaller = y("near") | (y("d") < x("d")) | ((y("d") == x("d")) & (y("b") < x("b")))
    possible = (
        (x("a") == y("a")) & (x("e") == y("e")) & (x("root") != y("root")) & smaller
        & (F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent)
        & (needed <= F.least(x("d") - x("at"), y("d") - y("at")))
    )
    return probes.join(listed, possible).select(x("b").alias("a"), y("b").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    signed = stored(signatures(docs, size))
    reps = stored(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("f1", "f2")
        .agg(
            F.min("doc_id").alias("rep"),
            F.min_by("half", "doc_id").alias("half"),
        )
    )
    roots = components(links(reps, docs, size, percent))
    classes = reps.join(roots, reps.rep == roots.node, "left").select(
        "f1", "f2", F.coalesce("root", "rep").alias("component_id")
    )
    own = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return (
        signed.drop("half")
        .join(classes, ["f1", "f2"], "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
