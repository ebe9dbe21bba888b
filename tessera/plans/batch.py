"""The batch as one plan: features of all study locations in, the result table out.

Windows of all locations prune the ingested feature tables; a location takes the national features if it has
any, else the open-map ones; they are projected and cleaned, and the six batch indicators of all locations are
one set of jobs. Locations without any feature get the default row or are dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.plans.indicators import all_indicators
from tessera.sources import features as ft
from tessera.sources.results import write_results

KEY = "location_id"
#: Columns of an ingested feature table beside its box and tile.
FEATURE_COLUMNS = ["feature_id", "type", "width", "shape"]


def features_of(
    spark: SparkSession, paths: Mapping[str, str], locations: DataFrame, zoom: int
) -> DataFrame:
    """``location_id, kind, feature_id, type, width, shape`` of the tables by kind (building, road)."""
    found = None
    for kind, path in paths.items():
        part = ft.stored_features_in_windows(spark, path, locations, zoom).select(
            KEY, F.lit(kind).alias("kind"), *FEATURE_COLUMNS
        )
        found = part if found is None else found.unionByName(part)
    return found


def prepared(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projected and cleaned buildings and roads; null shapes are dropped."""
    solid = features.filter("shape IS NOT NULL AND size(shape) > 1")
    buildings = solid.filter("kind = 'building'").select(
        KEY, F.col("feature_id").alias("building_id"), F.coalesce("type", F.lit("unknown")).alias("type"),
        F.lit(None).cast("double").alias("area_m2"), F.col("shape").alias("ring"),
    )
    roads = solid.filter("kind = 'road'").select(
        KEY, F.col("feature_id").alias("road_id"), F.coalesce("type", F.lit("road")).alias("type"), "width",
        F.col("shape").alias("path"),
    )
    return ft.preprocess_buildings(buildings), ft.preprocess_roads(roads)


def run_batch(
    spark: SparkSession,
    national: Mapping[str, str],
    open_map: Mapping[str, str],
    locations: DataFrame,
    out_path: str,
    missing: str = "default",
    zoom: int = 10,
    file_format: str = "parquet",
) -> None:
    """Write the result table of ``locations`` (``location_id, latitude, longitude, name, radius``).

    ``national`` and ``open_map`` name ingested tables by kind. ``missing`` is the policy for locations without
    features: ``default`` row or ``drop``.
    """
    features = cut(
        ft.source_priority(
            features_of(spark, national, locations, zoom), features_of(spark, open_map, locations, zoom), locations
        )
    )
    buildings, roads = prepared(features)
    table = all_indicators(cut(buildings), cut(roads), locations, missing)
    write_results(table, out_path, file_format)
