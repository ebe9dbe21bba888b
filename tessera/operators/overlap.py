"""Functional mix: type counts, borrowed attributes, overlap and diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.proximity import BOX, KEY, SHAPE, footprints, neighbour_types

ATTRIBUTES = ["residential", "commercial", "industrial", "public"]


def attribute_distribution(buildings: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Building counts of each attribute and of every other (non-null) type."""
    known = F.col("type").isin(attributes)
    return buildings.groupBy(KEY).agg(
        *[F.count_if(F.col("type") == a).alias(a) for a in attributes],
        F.count_if(F.col("type").isNotNull() & ~known).alias("other"),
    )


def assign_attributes(
    buildings: DataFrame,
    attributes: list[str] = ATTRIBUTES,
    threshold: float = 0.1,
    distance: float = 100.0,
) -> DataFrame:
    """Own type plus every type holding at least ``threshold`` of the buildings near by."""
    around = Window.partitionBy(KEY, *SHAPE)  # one row per type, a handful
    share = F.col("n") / F.sum("n").over(around)
    borrowed = (
        neighbour_types(buildings, distance)
        .withColumn("share", share)
        .groupBy(KEY, *SHAPE)
        .agg(
            F.collect_set(
                F.when((F.col("share") >= threshold) & F.col("type").isin(attributes), F.col("type"))
            ).alias("near")
        )
    )
    own = footprints(buildings).withColumn(
        "own",
        F.when(F.col("type").isin(attributes), F.array("type")).otherwise(
            F.array().cast("array<string>")
        ),
    )
    # Boxes have a null shape, so join on the box and compare shapes null-safely.
    same = [own[c] == borrowed[c] for c in (KEY, *BOX)] + [own["shape"].eqNullSafe(borrowed["shape"])]
    joined = own.join(borrowed, same, "left").select(
        own[KEY],
        "building_id",
        own["type"],
        F.array_sort(F.array_union("own", F.coalesce("near", F.array().cast("array<string>")))).alias(
            "attributes"
        ),
    )
    return joined.withColumn("num_attributes", F.size("attributes"))


def overlapping_buildings(assigned: DataFrame) -> DataFrame:
    return assigned.filter(F.col("num_attributes") > 1)


def overlap_matrix(assigned: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Symmetric pair counts per location, diagonal 0, one row per attribute."""
    pairs = (
        assigned.filter(F.col("num_attributes") > 1)
        .select(KEY, F.col("attributes").alias("a"), F.explode("attributes").alias("attribute"))
        .select(KEY, "attribute", F.explode("a").alias("other"))
        .filter(F.col("attribute") != F.col("other"))
        .groupBy(KEY, "attribute")
        .agg(*[F.count_if(F.col("other") == a).alias(a) for a in attributes])
    )
    frame = (
        assigned.select(KEY)
        .distinct()
        .withColumn("attribute", F.explode(F.array(*[F.lit(a) for a in attributes])))
    )
    return frame.join(pairs, [KEY, "attribute"], "left").fillna(0, attributes)


def functional_diversity(buildings: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Shannon index over the attribute distribution."""
    counts = attribute_distribution(buildings, attributes)
    names = [*attributes, "other"]
    whole = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    terms = []
    for n in names:
        p = F.try_divide(F.col(n), whole)
        terms.append(F.when(F.col(n) > 0, -p * F.ln(p + F.lit(1e-10))).otherwise(F.lit(0.0)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return counts.select(KEY, total.alias("diversity"))


def overlap(
    buildings: DataFrame, mode: str = "documented", assigned: DataFrame | None = None
) -> DataFrame:
    """Share of buildings with more than one attribute; ``mode='stub'`` reports 0."""
    if mode == "stub":
        return buildings.groupBy(KEY).agg(
            F.lit(0.0).alias("overlap"),
            F.count("*").alias("total_buildings"),
            F.lit(0).cast("long").alias("overlapping_buildings"),
        )
    rows = assigned if assigned is not None else assign_attributes(buildings)
    mixed = F.count_if(F.col("num_attributes") > 1)
    return rows.groupBy(KEY).agg(
        (mixed / F.count("*")).alias("overlap"),
        F.count("*").alias("total_buildings"),
        mixed.alias("overlapping_buildings"),
    )
