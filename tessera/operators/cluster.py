"""Density clustering of building centroids without neighbour lists in crowded places.

Points with equal coordinates are one weighted site. The plane is cut into cells whose diagonal is
below ``eps``: all sites of one cell are neighbours, so a cell with enough weight is all core and
needs no distance at all, and clusters are components of a graph of cells rather than of points.
Two cells are linked when some pair of their core sites is within ``eps``; blocks a quarter of a
cell wide settle almost every pair by their bounding boxes alone, and only undecided block pairs
compare sites.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import gap
from tessera.lineage import cut
from tessera.operators.components import component_labels
from tessera.operators.ordering import exact_quantiles, running_positions
from tessera.operators.proximity import footprints
from tessera.operators.range_join import range_join

KEY = "location_id"
BLOCKS_PER_CELL = 4
CENTRES_PER_SHARE = 5_000
XY = ["x", "y"]


def centroids(buildings: DataFrame) -> DataFrame:
    return footprints(buildings).select(
        KEY, "building_id", F.col("cx").alias("x"), F.col("cy").alias("y")
    )


def _packed(ix: Column, iy: Column) -> Column:
    return ix * F.lit(4294967296) + (iy + F.lit(2147483648))


def _cell_links(cores: DataFrame, eps: float) -> DataFrame:
    """``location_id, src, dst``: pairs of cells with core sites within ``eps``."""
    blocks = cores.groupBy(KEY, "cell", "block").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )
    near = cut(
        range_join(
            blocks.select(KEY, *[F.col(c).alias("a_" + c) for c in blocks.columns[1:]]),
            blocks.select(KEY, *[F.col(c).alias("b_" + c) for c in blocks.columns[1:]]),
            eps,
            ("a_x0", "a_y0", "a_x1", "a_y1"),
            ("b_x0", "b_y0", "b_x1", "b_y1"),
            condition=F.col("a_cell") < F.col("b_cell"),
        ).withColumn(
            "sure",
            gap(
                F.greatest(F.col("a_x1") - F.col("b_x0"), F.col("b_x1") - F.col("a_x0")),
                F.greatest(F.col("a_y1") - F.col("b_y0"), F.col("b_y1") - F.col("a_y0")),
            )
            <= eps,
        )
    )
    pair = [KEY, "a_cell", "b_cell"]
    settled = near.groupBy(*pair).agg(F.bool_or("sure").alias("linked"))
    open_pairs = near.join(settled.filter(~F.col("linked")), pair, "left_semi").select(
        *pair, "a_block", "b_block"
    )

    def sites(side: str) -> DataFrame:
        return cores.select(
            KEY,
            F.col("cell").alias(f"{side}_cell"),
            F.col("block").alias(f"{side}_block"),
            F.col("x").alias(f"{side}x"),
            F.col("y").alias(f"{side}y"),
        )

    compared = (
        open_pairs.join(sites("a"), [KEY, "a_cell", "a_block"])
        .join(sites("b"), [KEY, "b_cell", "b_block"])
        .filter(gap(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= eps)
        .select(*pair)
        .distinct()
    )
    return (
        settled.filter("linked")
        .select(*pair)
        .unionByName(compared)
        .select(KEY, F.col("a_cell").alias("src"), F.col("b_cell").alias("dst"))
    )


def dbscan(points: DataFrame, eps: float = 50.0, min_samples: int = 5) -> DataFrame:
    """``cluster_id`` per point; −1 is noise.

    Clusters are numbered by their smallest core ``building_id``, and a border point joins the
    smallest-numbered cluster it touches: what a scan in row order yields.
    """
    side = eps / math.sqrt(2.0) * (1 - 1e-9)
    cell_x, cell_y = F.floor(F.col("x") / side), F.floor(F.col("y") / side)
    fine = side / BLOCKS_PER_CELL
    block = _packed(F.floor(F.col("x") / fine), F.floor(F.col("y") / fine))
    sites = cut(
        points.groupBy(KEY, *XY)
        .agg(F.count("*").alias("n"), F.min("building_id").alias("first"))
        .withColumn("cell", _packed(cell_x, cell_y))
        .withColumn("block", block)
    )
    weights = sites.groupBy(KEY, "cell").agg(F.sum("n").alias("weight"))
    weighed = sites.join(weights, [KEY, "cell"])
    dense = weighed.filter(F.col("weight") >= min_samples).drop("weight")
    sparse = weighed.filter(F.col("weight") < min_samples).drop("weight")
    # A sparse cell holds fewer than min_samples points, so this stays linear in the sites.
    near = cut(
        range_join(
            sparse.select(KEY, F.col("x").alias("sx"), F.col("y").alias("sy")),
            sites.select(KEY, F.col("x").alias("tx"), F.col("y").alias("ty"), "n", "cell"),
            eps,
            ("sx", "sy", "sx", "sy"),
            ("tx", "ty", "tx", "ty"),
        ).select(KEY, "sx", "sy", "tx", "ty", "n", "cell")
    )
    crowded = (
        near.groupBy(KEY, F.col("sx").alias("x"), F.col("sy").alias("y"))
        .agg(F.sum("n").alias("around"))
        .filter(F.col("around") >= min_samples)
        .select(KEY, *XY)
    )
    cores = cut(dense.unionByName(sparse.join(crowded, [KEY, *XY], "left_semi").select(dense.columns)))
    labels = component_labels(_cell_links(cores, eps)).withColumnRenamed("u", "cell")
    cells = (
        cores.groupBy(KEY, "cell")
        .agg(F.min("first").alias("first"))
        .join(labels, [KEY, "cell"], "left")
        .withColumn("component", F.coalesce("component", "cell"))
    )
    ranked = running_positions(
        cells.groupBy(KEY, "component").agg(F.min("first").alias("first")), [KEY], ["first"]
    ).select(KEY, "component", F.col("before").cast("int").alias("cluster_id"))
    numbered = cells.join(ranked, [KEY, "component"]).select(KEY, "cell", "cluster_id")
    core_label = cores.select(KEY, *XY, "cell").join(numbered, [KEY, "cell"])
    border = (
        near.join(crowded, (near[KEY] == crowded[KEY]) & (near["sx"] == crowded["x"]) & (near["sy"] == crowded["y"]), "left_anti")
        .join(
            core_label.select(KEY, F.col("x").alias("tx"), F.col("y").alias("ty"), "cluster_id"),
            [KEY, "tx", "ty"],
        )
        .groupBy(KEY, F.col("sx").alias("x"), F.col("sy").alias("y"))
        .agg(F.min("cluster_id").alias("cluster_id"))
    )
    found = core_label.select(KEY, *XY, "cluster_id").unionByName(border)
    return points.join(found, [KEY, *XY], "left").withColumn(
        "cluster_id", F.coalesce("cluster_id", F.lit(-1))
    )


def cluster_info(buildings: DataFrame, eps: float = 50.0, min_samples: int = 5) -> DataFrame:
    """Buildings with cluster number and centroid."""
    labelled = dbscan(centroids(buildings), eps, min_samples).select(
        KEY,
        "building_id",
        "cluster_id",
        F.col("x").alias("centroid_x"),
        F.col("y").alias("centroid_y"),
    )
    return buildings.join(labelled, [KEY, "building_id"])


def num_cores(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(KEY).agg(
        F.count("*").alias("num_points"),
        F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("num_cores"),
    )


def core_dispersion(labelled: DataFrame, method: str = "variance") -> DataFrame:
    """Spread of the distances between cluster centres; 0 below two clusters.

    The statistic is defined over all pairs of centres. Pairs are combined into per-location sums
    before they move; only the inter-quartile range has to order them.
    """
    places = labelled.select(KEY).distinct()
    centres = cut(
        labelled.filter("cluster_id >= 0")
        .groupBy(KEY, "cluster_id")
        .agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    )
    # A location with very many clusters is dealt into shares, one task per share.
    most = centres.groupBy(KEY).count().agg(F.max("count")).first()[0] or 0
    shares = most // CENTRES_PER_SHARE + 1
    dealt = centres.withColumn("share", F.pmod(F.xxhash64("cluster_id"), F.lit(shares)))
    other = centres.select(
        KEY,
        F.col("cluster_id").alias("other"),
        F.col("x").alias("ox"),
        F.col("y").alias("oy"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"),
    )
    pairs = (
        dealt.join(other, [KEY, "share"])
        .filter(F.col("cluster_id") < F.col("other"))
        .select(KEY, gap(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")).alias("d"))
    )
    if method in ("variance", "std"):
        spread = F.var_pop("d") if method == "variance" else F.stddev_pop("d")
        found = pairs.groupBy(KEY).agg(spread.alias("core_dispersion"))
    elif method == "iqr":
        # Both orders of a pair count, hence times=2.
        quartiles = exact_quantiles(pairs, [KEY], "d", {"q25": 0.25, "q75": 0.75}, times=2)
        found = quartiles.select(KEY, (F.col("q75") - F.col("q25")).alias("core_dispersion"))
    else:
        found = places.select(KEY, F.lit(0.0).alias("core_dispersion"))
    return places.join(found, KEY, "left").withColumn(
        "core_dispersion", F.coalesce("core_dispersion", F.lit(0.0))
    )


def core_diversity(labelled: DataFrame, method: str = "constant") -> DataFrame:
    """1 for every location, or the documented Shannon index over cluster sizes."""
    places = labelled.select(KEY).distinct()
    if method != "shannon":
        return places.select(KEY, F.lit(1.0).alias("core_diversity"))
    # Σ −p ln p = ln N − Σ n ln n / N, so one pass over cluster sizes is enough.
    sizes = labelled.filter("cluster_id >= 0").groupBy(KEY, "cluster_id").agg(F.count("*").alias("n"))
    whole = F.sum("n").cast("double")
    found = sizes.groupBy(KEY).agg(
        (F.ln(whole) - F.sum(F.col("n") * F.ln("n")) / whole).alias("core_diversity")
    )
    return places.join(found, KEY, "left").withColumn(
        "core_diversity", F.coalesce("core_diversity", F.lit(0.0))
    )
