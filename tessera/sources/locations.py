"""Study locations: the fixed lists, samplers round cities, single-record lookup."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_RADIUS_M = 2000

# The curated study sites (name, latitude, longitude, radius in metres).
CURATED_SITES = [
    ("Tokyo Station", 35.681236, 139.767125, 800),
    ("Shinjuku", 35.690921, 139.700258, 800),
    ("Shibuya", 35.659516, 139.700450, 800),
    ("Ueno", 35.712056, 139.776431, 800),
    ("Osaka Umeda", 34.702485, 135.495951, 800),
    ("Nagoya Sakae", 35.169918, 136.908155, 800),
    ("Hakata", 33.590204, 130.420997, 800),
    ("Sapporo", 43.062096, 141.354376, 800),
    ("Sendai", 38.260686, 140.882549, 800),
    ("Hiroshima", 34.391606, 132.451597, 800),
    ("Yokohama", 35.4438, 139.6380, 1000),
    ("Yamanashi City", 35.6635, 138.5684, 1000),
    ("Greenwich CT", 41.049179869296566, -73.63494225610658, 1000),
    ("Bell Labs Holmdel", 40.391006, -74.184581, 1000),
    ("Kamiyama A", 33.959822829540045, 134.30761543643712, 1000),
    ("Kamiyama Week", 33.9687294040191, 134.3383325623779, 1000),
    ("Kamiyama Miyamoto Residence", 33.963637118765526, 134.35049344583854, 1000),
    ("Kamiyama Marugoto Technical College", 33.972864196733795, 134.36278905827217, 1000),
    ("Observation Deck", 33.953743569235925, 134.4063620051131, 1000),
    ("Kawaba Village", 36.699016518887866, 139.10910525819972, 1000),
    ("Tonami Plain", 36.602711035167594, 136.9867048847905, 1000),
    ("Taketomi Island", 24.330804124388035, 124.08550639616077, 1000),
]

# The seven-city list (name, latitude, longitude).
SEVEN_CITIES = [
    ("東京", 35.6762, 139.6503),
    ("大阪", 34.6937, 135.5023),
    ("神奈川", 35.4437, 139.6380),
    ("群馬", 36.3911, 139.0608),
    ("山梨", 35.6639, 138.5683),
    ("出雲", 35.3667, 132.7667),
    ("福岡", 33.5904, 130.4017),
]

# Sampling bounds in degrees.
NATIONAL_BOUNDS = {"west": 129.0, "south": 30.0, "east": 146.0, "north": 46.0}

SCHEMA = "location_id long, latitude double, longitude double, name string, radius int"


def curated_locations(spark: SparkSession, default_radius: int = DEFAULT_RADIUS_M) -> DataFrame:
    rows = [(i, lat, lon, name, r) for i, (name, lat, lon, r) in enumerate(CURATED_SITES)]
    return spark.createDataFrame(rows, SCHEMA).withColumn(
        "radius", F.coalesce("radius", F.lit(default_radius))
    )


def seven_cities(spark: SparkSession, default_radius: int = DEFAULT_RADIUS_M) -> DataFrame:
    rows = [(i, lat, lon, name, None) for i, (name, lat, lon) in enumerate(SEVEN_CITIES)]
    return spark.createDataFrame(rows, SCHEMA).withColumn(
        "radius", F.coalesce("radius", F.lit(default_radius))
    )


def drawn(seed: int, row: Column) -> Column:
    """A uniform number of [0, 1) from the seed and the row's key, the same at every retry."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), row), 11) / F.lit(2.0**53)


def drawn_normal(seed: int, row: Column) -> Column:
    """A standard normal number from two uniform ones."""
    size = F.sqrt(-2 * F.log1p(-drawn(seed, row)))
    return size * F.cos(2 * math.pi * drawn(~seed, row))


def _uniform_rows(spark: SparkSession, n: int, seed: int) -> DataFrame:
    b = NATIONAL_BOUNDS
    return spark.range(n).select(
        (F.lit(b["south"]) + drawn(seed, F.col("id")) * (b["north"] - b["south"])).alias("latitude"),
        (F.lit(b["west"]) + drawn(seed + 1, F.col("id")) * (b["east"] - b["west"])).alias("longitude"),
        F.col("id"),
    )


def sample_locations_weighted(cities: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``weight`` jittered copies of each city in list order, then uniform rows up to ``n``.

    ``cities``: ``city_order, latitude, longitude, weight, type`` (major_city or regional_center).
    """
    from tessera.operators.ordering import running_positions

    sigma = F.when(F.col("type") == "major_city", F.lit(0.02)).otherwise(F.lit(0.015))
    copies = cities.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight"))))
    placed = running_positions(
        copies.withColumn("_all", F.lit(0)), ["_all"], ["type", "city_order", "copy"]
    ).filter(F.col("before") < n)
    near = placed.select(
        F.col("before").cast("long").alias("location_id"),
        (F.col("latitude") + drawn_normal(seed, F.col("before")) * sigma).alias("latitude"),
        (F.col("longitude") + drawn_normal(seed + 1, F.col("before")) * sigma).alias("longitude"),
        "type",
    )
    taken = placed.count()
    rest = _uniform_rows(cities.sparkSession, n - taken, seed + 2).select(
        (F.col("id") + taken).alias("location_id"),
        "latitude",
        "longitude",
        F.lit("random").alias("type"),
    )
    return near.unionByName(rest)


def sample_locations_choice(
    wanted: DataFrame, cities: DataFrame, picks: int | None = None, seed: int = 42
) -> DataFrame:
    """A place for each wanted ``location_id``: near a city drawn by weight for the first ones, else uniform.

    The first ``picks`` rows by ``location_id`` (a third of all, 50 at most, if not given) draw a city by its
    integer ``weight``: every city holds as many places in one running order as it weighs, and a draw joins
    on the place. A city that no row draws has no copies in the result; rows are never put in one task.
    """
    from tessera.operators.ordering import running_positions

    whole = F.lit(0).alias("_all")
    rows = running_positions(wanted.select("location_id", whole), ["_all"], ["location_id"])
    limit = F.lit(picks) if picks is not None else F.least(F.lit(50), F.floor(F.col("group_total") / 3))
    rows = rows.select("location_id", (F.col("before") < limit).alias("near"))
    slots = running_positions(
        cities.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("weight")))).withColumn("_all", F.lit(0)),
        ["_all"], ["city_order", "_copy"],
    )
    n_slots = slots.agg(F.max("group_total")).first()[0] or 0
    key = F.col("location_id")
    drawn_slot = F.floor(drawn(seed, key) * F.lit(n_slots)).alias("slot")
    near = (
        rows.filter("near").select("location_id", drawn_slot)
        .join(slots.select(F.col("before").alias("slot"), "city_order", "latitude", "longitude"), "slot")
        .select(
            "location_id", F.col("city_order").cast("long").alias("city_order"),
            (F.col("latitude") + drawn_normal(seed + 1, key) * 0.1).alias("latitude"),
            (F.col("longitude") + drawn_normal(seed + 2, key) * 0.1).alias("longitude"),
        )
    )
    b = NATIONAL_BOUNDS
    rest = rows.filter("NOT near").select(
        "location_id", F.lit(None).cast("long").alias("city_order"),
        (F.lit(b["south"]) + drawn(seed + 3, key) * (b["north"] - b["south"])).alias("latitude"),
        (F.lit(b["west"]) + drawn(seed + 4, key) * (b["east"] - b["west"])).alias("longitude"),
    )
    return near.unionByName(rest)


def sample_locations_cycle(
    wanted: DataFrame, cities: DataFrame, n_cities: int, seed: int = 42
) -> DataFrame:
    """City ``i mod k`` for each wanted ``location_id`` i: exact for i < k, jittered after."""
    jitter = F.col("location_id") >= n_cities
    return (
        wanted.select("location_id", F.pmod("location_id", F.lit(n_cities)).alias("city_order"))
        .join(cities.select("city_order", "latitude", "longitude"), "city_order")
        .select(
            "location_id",
            "city_order",
            *[
                (
                    F.col(c) + F.when(jitter, drawn(seed + i, F.col("location_id")) - F.lit(0.5)).otherwise(F.lit(0.0))
                ).alias(c)
                for i, c in enumerate(("latitude", "longitude"))
            ],
        )
    )


RECORD_FIELDS = [
    "location_id", "latitude", "longitude", "sparsity", "resilience", "multi_nodality",
    "permeability", "emergence", "overlap",
]


def location_record(results: DataFrame, location_id: int) -> DataFrame:
    """One JSON record, or an error record when the id is unknown."""
    spark = results.sparkSession
    found = results.filter(F.col("location_id") == location_id).select(
        F.to_json(F.struct(*RECORD_FIELDS)).alias("record"), F.lit(0).alias("rank")
    )
    missing = spark.range(1).select(
        F.to_json(F.struct(F.lit("地点が見つかりません").alias("error"))).alias("record"),
        F.lit(1).alias("rank"),
    )
    return found.unionByName(missing).orderBy("rank").limit(1).select("record")
