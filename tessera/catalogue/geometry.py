"""Geometry, tiles, labels, ingest and location queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.catalogue import query
from tessera.fixtures import with_views
from tessera.functions import geometry as g
from tessera.functions import labels
from tessera.lineage import new_folder
from tessera.operators import statistics as st
from tessera.sources import features as ft
from tessera.sources import locations as loc
from tessera.sources import results as rs

KEY = "location_id"


def r(column, digits=6):
    return F.round(column, digits)


def lonlat_buildings(spark, sf_dir):
    """The building view placed near 139°E 35°N, in degrees."""
    ring = F.transform(
        "ring", lambda p: g.point(F.lit(139.0) + p.x / 100000.0, F.lit(35.0) + p.y / 100000.0)
    )
    return fx.buildings(spark, sf_dir).withColumn("ring", ring)


def lonlat_roads(spark, sf_dir):
    path = F.transform(
        "path", lambda p: g.point(F.lit(139.0) + p.x / 100000.0, F.lit(35.0) + p.y / 100000.0)
    )
    return fx.roads(spark, sf_dir).withColumn("path", path)


def lonlat_squares(spark, sf_dir):
    """One small square per row of the result table, at its coordinates."""
    lon, lat, side = F.col("longitude"), F.col("latitude"), 0.001
    corners = [(lon, lat), (lon + side, lat), (lon + side, lat + side), (lon, lat + side), (lon, lat)]
    return fx.location_metrics(spark, sf_dir).select(
        F.col(KEY).alias("building_id"), F.array(*[g.point(x, y) for x, y in corners]).alias("ring")
    )


BOUNDS = """
  latitude - CAST(2000 AS DOUBLE) / CAST(111000 AS DOUBLE) AS s,
  latitude + CAST(2000 AS DOUBLE) / CAST(111000 AS DOUBLE) AS n,
  longitude - CAST(2000 AS DOUBLE) / (CAST(111000 AS DOUBLE) * cos(radians(latitude))) AS w,
  longitude + CAST(2000 AS DOUBLE) / (CAST(111000 AS DOUBLE) * cos(radians(latitude))) AS e
"""


@query(
    "bounds_window",
    with_views(
        f"""SELECT location_id, round(greatest(-180, w), 6) AS west, round(greatest(-90, s), 6) AS south,
          round(least(180, e), 6) AS east, round(least(90, n), 6) AS north
        FROM (SELECT location_id, {BOUNDS} FROM location_metrics)""",
        "location_metrics",
    ),
)
def bounds_window(spark, sf_dir):
    df = fx.location_metrics(spark, sf_dir)
    b = g.location_bounds(F.col("latitude"), F.col("longitude"), F.lit(2000.0))
    return df.select(KEY, *[r(c).alias(n) for n, c in b.items()])


@query(
    "analysis_area",
    with_views(
        f"""SELECT location_id, round(w, 6) AS first_x, round(s, 6) AS first_y, round(e, 6) AS third_x,
          round(n, 6) AS third_y, 5 AS vertices, latitude AS center_lat, longitude AS center_lon,
          CAST(2000 AS BIGINT) AS radius_m
        FROM (SELECT location_id, latitude, longitude, {BOUNDS} FROM location_metrics)""",
        "location_metrics",
    ),
)
def analysis_area(spark, sf_dir):
    df = fx.location_metrics(spark, sf_dir).withColumn("radius", F.lit(2000).cast("long"))
    return ft.analysis_area(df).select(
        KEY,
        r(F.col("ring")[0].x).alias("first_x"),
        r(F.col("ring")[0].y).alias("first_y"),
        r(F.col("ring")[2].x).alias("third_x"),
        r(F.col("ring")[2].y).alias("third_y"),
        F.size("ring").alias("vertices"),
        "center_lat",
        "center_lon",
        "radius_m",
    )


@query(
    "web_mercator",
    with_views(
        """SELECT location_id, round(6378137.0::DOUBLE * radians(longitude), 4) AS x,
          round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(latitude) / 2)), 4) AS y
        FROM location_metrics""",
        "location_metrics",
    ),
)
def web_mercator(spark, sf_dir):
    df = fx.location_metrics(spark, sf_dir)
    path = F.array(g.point(F.col("longitude"), F.col("latitude")))
    return df.select(KEY, g.to_web_mercator(path)[0].alias("p")).select(
        KEY, r(F.col("p.x"), 4).alias("x"), r(F.col("p.y"), 4).alias("y")
    )


@query(
    "lonlat",
    with_views(
        """SELECT location_id, building_id, round(degrees(x0 * 1000 / 6378137.0::DOUBLE), 9) AS lon,
          round(degrees(2 * atan(exp(y0 * 1000 / 6378137.0::DOUBLE)) - pi() / 2), 9) AS lat
        FROM buildings""",
        "buildings",
    ),
)
def lonlat(spark, sf_dir):
    df = fx.buildings(spark, sf_dir)
    scaled = F.transform("ring", lambda p: g.point(p.x * 1000, p.y * 1000))
    return df.select(KEY, "building_id", g.from_web_mercator(scaled)[0].alias("p")).select(
        KEY, "building_id", r(F.col("p.x"), 9).alias("lon"), r(F.col("p.y"), 9).alias("lat")
    )


@query(
    "building_geometry",
    with_views(
        """SELECT location_id, building_id, round((x1 - x0) * (y1 - y0), 6) AS area,
          (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x0 AS x_min, y0 AS y_min, x1 AS x_max, y1 AS y_max
        FROM buildings""",
        "buildings",
    ),
)
def building_geometry(spark, sf_dir):
    return g.measure_rings(fx.buildings(spark, sf_dir)).select(
        KEY, "building_id", r(F.col("ring_area")).alias("area"),
        "cx", "cy", "x_min", "y_min", "x_max", "y_max",
    )


@query(
    "road_length",
    with_views(
        """SELECT location_id, road_id, round(sum(d), 6) AS length_m FROM (
          SELECT location_id, road_id, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d
          FROM road_vertices WINDOW w AS (PARTITION BY road_id ORDER BY vertex_index))
        GROUP BY location_id, road_id""",
        "road_vertices",
    ),
)
def road_length(spark, sf_dir):
    return fx.roads(spark, sf_dir).select(
        KEY, "road_id", r(g.path_length(F.col("path"))).alias("length_m")
    )


@query(
    "extent",
    with_views(
        """SELECT location_id, min(x0) AS x_min, min(y0) AS y_min, max(x1) AS x_max, max(y1) AS y_max
        FROM buildings GROUP BY location_id""",
        "buildings",
    ),
)
def extent(spark, sf_dir):
    return ft.extent(fx.buildings(spark, sf_dir), "ring")


@query(
    "padded_extent",
    with_views(
        """SELECT n_nationkey::BIGINT AS location_id,
          round(coalesce(x_min - m, -1000), 6) AS x_min, round(coalesce(y_min - m, -1000), 6) AS y_min,
          round(coalesce(x_max + m, 1000), 6) AS x_max, round(coalesce(y_max + m, 1000), 6) AS y_max
        FROM nation LEFT JOIN (
          SELECT location_id, min(x0) AS x_min, min(y0) AS y_min, max(x1) AS x_max, max(y1) AS y_max,
            (max(x1) - min(x0)) * 0.1::DOUBLE AS m
          FROM buildings GROUP BY location_id) b ON b.location_id = n_nationkey""",
        "buildings",
    ),
)
def padded_extent(spark, sf_dir):
    places = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.col("n_nationkey").cast("long").alias(KEY)
    )
    bounds = ft.extent(fx.buildings(spark, sf_dir), "ring")
    out = ft.padded_extent(bounds, places)
    return out.select(KEY, *[r(F.col(c)).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])


PROJECTED = """
  p AS (SELECT location_id, building_id, type,
    6378137.0::DOUBLE * radians(139 + x0 / 100000.0::DOUBLE) AS px0,
    6378137.0::DOUBLE * radians(139 + x1 / 100000.0::DOUBLE) AS px1,
    6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(35 + y0 / 100000.0::DOUBLE) / 2)) AS py0,
    6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(35 + y1 / 100000.0::DOUBLE) / 2)) AS py1
  FROM buildings)
"""


@query(
    "preprocess_buildings",
    with_views(
        """SELECT location_id, building_id, type, round((px1 - px0) * (py1 - py0), 3) AS area_m2,
          round((px0 + px1) / 2, 3) AS cx, round((py0 + py1) / 2, 3) AS cy
        FROM p WHERE (px1 - px0) * (py1 - py0) >= 10""",
        "buildings",
        ctes=PROJECTED,
    ),
)
def preprocess_buildings(spark, sf_dir):
    return ft.preprocess_buildings(lonlat_buildings(spark, sf_dir)).select(
        KEY, "building_id", "type", r(F.col("area_m2"), 3).alias("area_m2"),
        r(F.col("cx"), 3).alias("cx"), r(F.col("cy"), 3).alias("cy"),
    )


@query(
    "preprocess_roads",
    with_views(
        """SELECT location_id, road_id, type, width, round(sum(d), 3) AS length_m FROM (
          SELECT *, sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)) AS d FROM (
            SELECT *, 6378137.0::DOUBLE * radians(139 + x / 100000.0::DOUBLE) AS px,
              6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(35 + y / 100000.0::DOUBLE) / 2)) AS py
            FROM road_vertices) WINDOW w AS (PARTITION BY road_id ORDER BY vertex_index))
        GROUP BY location_id, road_id, type, width HAVING sum(d) >= 10""",
        "road_vertices",
    ),
)
def preprocess_roads(spark, sf_dir):
    return ft.preprocess_roads(lonlat_roads(spark, sf_dir)).select(
        KEY, "road_id", "type", "width", r(F.col("length_m"), 3).alias("length_m")
    )


@query(
    "filter_bounds",
    with_views(
        """SELECT location_id, building_id FROM buildings
        WHERE x1 >= 100 AND x0 <= 420 AND y1 >= 60 AND y0 <= 410""",
        "buildings",
    ),
)
def filter_bounds(spark, sf_dir):
    df = fx.buildings(spark, sf_dir)
    return ft.filter_by_bounds(df, "ring", 100.0, 60.0, 420.0, 410.0).select(KEY, "building_id")


@query(
    "filter_bounds_roads",
    with_views(
        """SELECT DISTINCT location_id, road_id FROM (
          SELECT location_id, road_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py
          FROM road_vertices WINDOW w AS (PARTITION BY road_id ORDER BY vertex_index))
        WHERE px IS NOT NULL AND greatest(x, px) >= 100 AND least(x, px) <= 420
          AND greatest(y, py) >= 60 AND least(y, py) <= 410""",
        "road_vertices",
    ),
)
def filter_bounds_roads(spark, sf_dir):
    df = fx.roads(spark, sf_dir)
    return ft.filter_by_bounds(df, "path", 100.0, 60.0, 420.0, 410.0, closed=False).select(
        KEY, "road_id"
    )


@query(
    "features_in_windows",
    with_views(
        """SELECT w.location_id, f.location_id AS building_id
        FROM location_metrics f JOIN (SELECT location_id,
            longitude - 20000.0::DOUBLE / (111000.0::DOUBLE * cos(radians(latitude))) AS w,
            longitude + 20000.0::DOUBLE / (111000.0::DOUBLE * cos(radians(latitude))) AS e,
            latitude - 20000.0::DOUBLE / 111000.0::DOUBLE AS s,
            latitude + 20000.0::DOUBLE / 111000.0::DOUBLE AS n FROM location_metrics) w
          ON f.longitude + 0.001::DOUBLE >= w.w AND f.longitude <= w.e
          AND f.latitude + 0.001::DOUBLE >= w.s AND f.latitude <= w.n""",
        "location_metrics",
    ),
)
def features_in_windows(spark, sf_dir):
    places = fx.location_metrics(spark, sf_dir).withColumn("radius", F.lit(20000))
    return ft.features_in_windows(lonlat_squares(spark, sf_dir), places, "ring", zoom=9).select(
        KEY, "building_id"
    )


TILE = """
  CAST(floor((longitude + 180) / 360 * 1024) AS BIGINT) AS tile_x,
  CAST(floor((1 - asinh(tan(radians(latitude))) / pi()) / 2 * 1024) AS BIGINT) AS tile_y
"""


@query(
    "tile_features",
    with_views(
        f"""SELECT tile_x, tile_y, count(*) AS features,
          round(tile_x / 1024.0::DOUBLE * 360 - 180, 6) AS west,
          round(degrees(atan(sinh(pi() * (1 - 2 * tile_y / 1024.0::DOUBLE)))), 6) AS north
        FROM (SELECT {TILE} FROM location_metrics) GROUP BY tile_x, tile_y""",
        "location_metrics",
    ),
)
def tile_features(spark, sf_dir):
    df = fx.location_metrics(spark, sf_dir)
    x, y = g.tile_x(F.col("longitude"), 10), g.tile_y(F.col("latitude"), 10)
    counts = df.groupBy(x.alias("tile_x"), y.alias("tile_y")).agg(F.count("*").alias("features"))
    return counts.select(
        "*",
        r(g.tile_lon(F.col("tile_x"), 10)).alias("west"),
        r(g.tile_lat(F.col("tile_y"), 10)).alias("north"),
    )


@query(
    "zoom_levels",
    with_views(
        """SELECT location_id,
          CAST(trunc(greatest(0, least(18, log2(156543.03392::DOUBLE * cos(radians(latitude)) /
            greatest(radius * 2 / 256.0::DOUBLE, 1))))) AS INTEGER) AS radius_zoom,
          CAST(trunc(greatest(0, least(18, log2(156543.03392::DOUBLE * cos(radians(latitude)) /
            greatest(radius / 640.0::DOUBLE, radius * 3 / 480.0::DOUBLE, 1))))) AS INTEGER) AS extent_zoom
        FROM (SELECT location_id, latitude, CAST(100 + location_id % 50 * 313 AS DOUBLE) AS radius
          FROM location_metrics)""",
        "location_metrics",
    ),
)
def zoom_levels(spark, sf_dir):
    df = fx.location_metrics(spark, sf_dir).withColumn(
        "radius", (100 + F.col(KEY) % 50 * 313).cast("double")
    )
    lat, radius = F.col("latitude"), F.col("radius")
    return df.select(
        KEY,
        g.zoom_for_radius(lat, radius).alias("radius_zoom"),
        g.zoom_for_extent(lat, radius, radius * 3, 640.0, 480.0).alias("extent_zoom"),
    )


REGION_SQL = """
  CASE WHEN latitude BETWEEN 35 AND 36 AND longitude BETWEEN 139 AND 140 THEN 'tokyo_metropolitan'
    WHEN latitude BETWEEN 34 AND 35 AND longitude BETWEEN 135 AND 136 THEN 'osaka_metropolitan'
    WHEN latitude BETWEEN 35 AND 36 AND longitude BETWEEN 136 AND 137 THEN 'nagoya_metropolitan'
    WHEN latitude > 43 THEN 'hokkaido' WHEN latitude < 32 THEN 'kyushu'
    WHEN latitude BETWEEN 35 AND 40 AND longitude BETWEEN 140 AND 141 THEN 'tohoku'
    ELSE 'regional' END
"""


@query(
    "region_type",
    with_views(
        f"SELECT location_id, {REGION_SQL} AS region FROM location_metrics", "location_metrics"
    ),
)
def region_type(spark, sf_dir):
    df = fx.location_metrics(spark, sf_dir)
    return df.select(KEY, labels.region_type(F.col("latitude"), F.col("longitude")).alias("region"))


@query(
    "address_label",
    with_views(
        """SELECT location_id,
          CASE WHEN k <= 5 THEN ['東京都', '大阪府', '愛知県', '北海道', '福岡県'][k] || '周辺'
            ELSE printf('緯度: %.4f, 経度: %.4f', latitude, longitude) END AS address,
          CASE WHEN k <= 4 THEN ['東京都', '大阪府', '愛知県', '北海道'][k]
            ELSE printf('緯度: %.3f, 経度: %.3f', latitude, longitude) END AS short_address
        FROM (SELECT *, CASE
          WHEN latitude BETWEEN 35 AND 36 AND longitude BETWEEN 139 AND 140 THEN 1
          WHEN latitude BETWEEN 34 AND 35 AND longitude BETWEEN 135 AND 136 THEN 2
          WHEN latitude BETWEEN 35 AND 36 AND longitude BETWEEN 136 AND 137 THEN 3
          WHEN latitude BETWEEN 43 AND 44 AND longitude BETWEEN 141 AND 142 THEN 4
          WHEN latitude BETWEEN 33 AND 34 AND longitude BETWEEN 130 AND 131 THEN 5 ELSE 6 END AS k
        FROM location_metrics)""",
        "location_metrics",
    ),
)
def address_label(spark, sf_dir):
    lat, lon = F.col("latitude"), F.col("longitude")
    return fx.location_metrics(spark, sf_dir).select(
        KEY,
        labels.address_label(lat, lon).alias("address"),
        labels.address_label(lat, lon, short=True).alias("short_address"),
    )


@query(
    "density_band",
    with_views(
        """SELECT location_id,
          CASE WHEN sparsity < 0.3 THEN 'high_density' WHEN sparsity < 0.7 THEN 'medium_density' ELSE 'low_density' END AS band,
          CASE WHEN sparsity < 0.5 THEN 'high_density' WHEN sparsity < 1 THEN 'medium_density' ELSE 'low_density' END AS wide_band
        FROM location_metrics""",
        "location_metrics",
    ),
)
def density_band(spark, sf_dir):
    return fx.location_metrics(spark, sf_dir).select(
        KEY,
        labels.density_band(F.col("sparsity")).alias("band"),
        labels.density_band(F.col("sparsity"), 0.5, 1.0).alias("wide_band"),
    )


@query(
    "metric_bands",
    with_views(
        """SELECT location_id,
          CASE WHEN resilience < 0.3::DOUBLE THEN 'low' WHEN resilience < 0.7::DOUBLE THEN 'medium' ELSE 'high' END AS resilience_band,
          CASE WHEN multi_nodality < 1 THEN 'monocentric' WHEN multi_nodality < 2.5 THEN 'moderate' ELSE 'polycentric' END AS polycentricity_band
        FROM location_metrics""",
        "location_metrics",
    ),
)
def metric_bands(spark, sf_dir):
    return fx.location_metrics(spark, sf_dir).select(
        KEY,
        labels.resilience_band(F.col("resilience")).alias("resilience_band"),
        labels.polycentricity_band(F.col("multi_nodality")).alias("polycentricity_band"),
    )


@query(
    "location_label",
    with_views(
        """SELECT location_id, label, label || printf(' | S: %.3f, R: %.3f', sparsity, resilience) AS metric_label
        FROM (SELECT *, CASE WHEN length(trim(name)) > 0 THEN printf('%s (ID %d)', name, location_id)
          ELSE printf('Location %d', location_id) END AS label FROM location_metrics)""",
        "location_metrics",
    ),
)
def location_label(spark, sf_dir):
    ident, name = F.col(KEY), F.col("name")
    return fx.location_metrics(spark, sf_dir).select(
        KEY,
        labels.location_label(ident, name).alias("label"),
        labels.location_metric_label(ident, name, F.col("sparsity"), F.col("resilience")).alias(
            "metric_label"
        ),
    )


@query(
    "marker_size",
    with_views(
        """SELECT location_id, round(least(greatest(coalesce(permeability, 0), 0), 1) * 0.8::DOUBLE + 0.2::DOUBLE, 6) AS marker,
          round(40 + (permeability - lo) / (hi - lo) * 180, 6) AS bubble, 100.0::DOUBLE AS constant_bubble
        FROM location_metrics, (SELECT min(permeability) AS lo, max(permeability) AS hi FROM location_metrics)""",
        "location_metrics",
    ),
)
def marker_size(spark, sf_dir):
    df = fx.location_metrics(spark, sf_dir)
    return df.select(
        KEY,
        r(labels.marker_size(F.col("permeability"))).alias("marker"),
        r(st.bubble_size(df, "permeability")).alias("bubble"),
        st.bubble_size(df, "overlap").alias("constant_bubble"),
    )


@query(
    "clean_metrics",
    with_views(
        """SELECT location_id, sparsity, resilience, multi_nodality, permeability, emergence, overlap
        FROM (SELECT * REPLACE (CASE WHEN location_id % 17 = 0 THEN NULL ELSE emergence END AS emergence)
          FROM location_metrics) WHERE permeability IS NOT NULL AND emergence IS NOT NULL""",
        "location_metrics",
    ),
)
def clean_metrics(spark, sf_dir):
    infinite = F.when(F.col(KEY) % 17 == 0, F.lit(float("inf"))).otherwise(F.col("emergence"))
    df = fx.location_metrics(spark, sf_dir).withColumn("emergence", infinite)
    return st.clean_metrics(df, fx.METRICS).select(KEY, *fx.METRICS)


@query(
    "formatted_table",
    with_views(
        """SELECT location_id, name, printf('%.4f', latitude) AS latitude, printf('%.4f', longitude) AS longitude,
          printf('%.4f', sparsity) AS sparsity, printf('%.4f', resilience) AS resilience,
          printf('%.4f', multi_nodality) AS multi_nodality,
          CASE WHEN permeability IS NULL THEN 'nan' ELSE printf('%.4f', permeability) END AS permeability,
          printf('%.4f', emergence) AS emergence, printf('%.4f', overlap) AS overlap
        FROM location_metrics ORDER BY location_id LIMIT 15""",
        "location_metrics",
    ),
)
def formatted_table(spark, sf_dir):
    return st.formatted_table(fx.location_metrics(spark, sf_dir), n=15)


# --- ingest -------------------------------------------------------------------------------


@query(
    "source_priority",
    with_views(
        """SELECT l.location_id, 'building' AS kind, b.building_id AS feature_id,
          CASE WHEN b.location_id % 3 = 0 THEN 'open' ELSE 'national' END AS source
        FROM (SELECT DISTINCT location_id FROM buildings) l JOIN buildings b USING (location_id)
        WHERE b.location_id % 3 = 0 OR b.building_id % 2 = 0
          OR (NOT EXISTS (SELECT 1 FROM buildings c WHERE c.location_id = b.location_id AND c.building_id % 2 = 0))""",
        "buildings",
    ),
)
def source_priority(spark, sf_dir):
    """National source holds even ids; every third location lies outside its window."""
    all_features = fx.buildings(spark, sf_dir).select(
        KEY, F.lit("building").alias("kind"), F.col("building_id").alias("feature_id")
    )
    places = (
        all_features.select(KEY)
        .distinct()
        .select(
            KEY,
            F.when(F.col(KEY) % 3 == 0, F.lit(50.0)).otherwise(F.lit(35.0)).alias("latitude"),
            F.lit(139.0).alias("longitude"),
        )
    )
    national = all_features.filter(F.col("feature_id") % 2 == 0)
    return ft.source_priority(national, all_features, places)


@query(
    "explode_parts",
    with_views(
        """SELECT location_id, road_id, part_index, CAST(2 AS INTEGER) AS vertices FROM (
          SELECT location_id, road_id, CAST(vertex_index - 1 AS INTEGER) AS part_index
          FROM road_vertices WHERE vertex_index > 0 AND road_id % 7 <> 0)""",
        "road_vertices",
    ),
)
def explode_parts(spark, sf_dir):
    """Roads as multi-lines, one part per segment; every seventh geometry is null."""
    parts = F.transform(g.segments(F.col("path")), lambda s: F.array(s.a, s.b))
    df = fx.roads(spark, sf_dir).select(
        KEY, "road_id", F.when(F.col("road_id") % 7 != 0, parts).alias("parts")
    )
    return ft.explode_parts(df, "parts", "path").select(
        KEY, "road_id", "part_index", F.size("path").alias("vertices")
    )


@query(
    "normalise_open_buildings",
    with_views(
        """SELECT location_id,
          CAST(row_number() OVER (PARTITION BY location_id ORDER BY building_id) - 1 AS VARCHAR) AS building_id,
          CAST(NULL AS VARCHAR) AS type, round((px1 - px0) * (py1 - py0), 3) AS area_m2 FROM p""",
        "buildings",
        ctes=PROJECTED,
    ),
)
def normalise_open_buildings(spark, sf_dir):
    df = lonlat_buildings(spark, sf_dir).withColumnRenamed("building_id", "osm_id")
    return ft.normalise_open_buildings(df, ["osm_id"]).select(
        KEY, "building_id", "type", r(F.col("area_m2"), 3).alias("area_m2")
    )


@query(
    "normalise_open_roads",
    with_views(
        """SELECT location_id, type, width, vertices,
          CAST(row_number() OVER (PARTITION BY location_id ORDER BY id) - 1 AS VARCHAR) AS road_id
        FROM (SELECT location_id, road_id AS id, CASE WHEN type = 'primary' THEN 'road' ELSE type END AS type,
          CAST(NULL AS DOUBLE) AS width, CAST(count(*) AS INTEGER) AS vertices
          FROM road_vertices GROUP BY location_id, road_id, type)""",
        "road_vertices",
    ),
)
def normalise_open_roads(spark, sf_dir):
    df = fx.roads(spark, sf_dir).select(
        KEY,
        F.col("road_id").alias("osm_id"),
        F.when(F.col("type") != "primary", F.col("type")).alias("highway"),
        "path",
    )
    return ft.normalise_open_roads(df, ["osm_id"]).select(
        KEY, "road_id", "type", "width", F.size("path").alias("vertices")
    )


def _sites_sql():
    rows = ", ".join(
        f"({i}, '{name}', {lat}::DOUBLE, {lon}::DOUBLE, {radius})"
        for i, (name, lat, lon, radius) in enumerate(loc.CURATED_SITES)
    )
    return f"sites(site_id, site, lat, lon, radius) AS (VALUES {rows})"


@query(
    "curated_locations",
    with_views(
        """SELECT location_id, site_id, site, radius FROM (
          SELECT location_id, CAST(site_id AS BIGINT) AS site_id, site, CAST(radius AS INTEGER) AS radius,
            row_number() OVER (PARTITION BY location_id ORDER BY
              sqrt((latitude - lat) * (latitude - lat) + (longitude - lon) * (longitude - lon)), site_id) AS k
          FROM location_metrics, sites) WHERE k = 1""",
        "location_metrics",
        ctes=_sites_sql(),
    ),
)
def curated_locations(spark, sf_dir):
    """The curated site nearest to every location of the table."""
    return st.nearest_site(
        fx.location_metrics(spark, sf_dir), loc.curated_locations(spark)
    ).select(KEY, "site_id", "site", "radius")


@query(
    "nearest_location",
    with_views(
        """SELECT location_id, latitude, longitude FROM location_metrics
        ORDER BY sqrt((latitude - 35.68::DOUBLE) * (latitude - 35.68::DOUBLE)
          + (longitude - 139.76::DOUBLE) * (longitude - 139.76::DOUBLE)), location_id LIMIT 1""",
        "location_metrics",
    ),
)
def nearest_location(spark, sf_dir):
    return st.nearest_location(fx.location_metrics(spark, sf_dir), 35.68, 139.76).select(
        KEY, "latitude", "longitude"
    )


@query(
    "location_record",
    with_views(
        """SELECT '{"location_id":' || location_id || ',"latitude":' || latitude || ',"longitude":' || longitude
          || ',"sparsity":' || sparsity || ',"resilience":' || resilience || ',"multi_nodality":' || multi_nodality
          || ',"permeability":' || permeability || ',"emergence":' || emergence || ',"overlap":' || overlap || '}' AS record
        FROM location_metrics WHERE location_id = 7""",
        "location_metrics",
    ),
)
def location_record(spark, sf_dir):
    return loc.location_record(fx.location_metrics(spark, sf_dir), 7)


@query(
    "location_record_unknown",
    """SELECT '{"error":"地点が見つかりません"}' AS record""",
)
def location_record_unknown(spark, sf_dir):
    return loc.location_record(fx.location_metrics(spark, sf_dir), -1)


def _supplier_cities(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").cast("int").alias("city_order"),
        (F.lit(30.0) + F.col("s_suppkey") % 160 / 10.0).alias("latitude"),
        (F.lit(129.0) + F.col("s_suppkey") % 170 / 10.0).alias("longitude"),
        (F.col("s_suppkey") % 3 + 1).cast("int").alias("weight"),
        F.when(F.col("s_suppkey") % 4 == 0, F.lit("major_city"))
        .otherwise(F.lit("regional_center"))
        .alias("type"),
    )


@query(
    "sample_weighted",
    """SELECT location_id, CASE WHEN location_id < n THEN type ELSE 'random' END AS type
    FROM (SELECT CAST(range AS BIGINT) AS location_id FROM range(300))
    LEFT JOIN (SELECT row_number() OVER (ORDER BY CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END, s_suppkey, c) - 1 AS k,
        count(*) OVER () AS n, CASE WHEN s_suppkey % 4 = 0 THEN 'major_city' ELSE 'regional_center' END AS type
      FROM supplier, range(1, 4) t(c) WHERE c <= s_suppkey % 3 + 1) ON k = location_id""",
)
def sample_weighted(spark, sf_dir):
    return loc.sample_locations_weighted(_supplier_cities(spark, sf_dir), 300).select(KEY, "type")


@query(
    "sample_choice",
    with_views(
        """SELECT location_id, row_number() OVER (ORDER BY location_id) <= least(50, count(*) OVER () // 3) AS near,
          true AS placed FROM location_metrics""",
        "location_metrics",
    ),
)
def sample_choice(spark, sf_dir):
    """Which rows draw a city, and whether each lies where its draw puts it."""
    cities = _supplier_cities(spark, sf_dir)
    drawn = loc.sample_locations_choice(fx.location_metrics(spark, sf_dir), cities)
    centre = cities.select(F.col("city_order").cast("long"), F.col("latitude").alias("clat"), F.col("longitude").alias("clon"))
    at_city = (F.abs(F.col("latitude") - F.col("clat")) < 1) & (F.abs(F.col("longitude") - F.col("clon")) < 1)
    inside = F.col("latitude").between(20, 46) & F.col("longitude").between(122, 154)
    return drawn.join(centre, "city_order", "left").select(
        KEY, F.col("city_order").isNotNull().alias("near"),
        F.when(F.col("city_order").isNotNull(), at_city).otherwise(inside).alias("placed"),
    )


@query(
    "stored_features_in_windows",
    with_views(
        """SELECT w.location_id, f.location_id AS building_id
        FROM (SELECT *, 0.001::DOUBLE + 0.9::DOUBLE * (location_id % 7) AS side FROM location_metrics) f
        JOIN (SELECT location_id,
            longitude - 60000.0::DOUBLE / (111000.0::DOUBLE * cos(radians(latitude))) AS w,
            longitude + 60000.0::DOUBLE / (111000.0::DOUBLE * cos(radians(latitude))) AS e,
            latitude - 60000.0::DOUBLE / 111000.0::DOUBLE AS s,
            latitude + 60000.0::DOUBLE / 111000.0::DOUBLE AS n FROM location_metrics WHERE location_id % 10 = 3) w
          ON f.longitude + side >= w.w AND f.longitude <= w.e AND f.latitude + side >= w.s AND f.latitude <= w.n""",
        "location_metrics",
    ),
)
def stored_features_in_windows(spark, sf_dir):
    """Overlapping windows over a table ingested by tile, with features that span tiles."""
    path = _ingested(spark, sf_dir)
    places = fx.location_metrics(spark, sf_dir).filter("location_id % 10 = 3").withColumn("radius", F.lit(60000))
    return ft.stored_features_in_windows(spark, path, places, zoom=7).select(KEY, "building_id")


@query(
    "stored_filter_bounds",
    with_views(
        """SELECT location_id AS building_id
        FROM (SELECT *, 0.001::DOUBLE + 0.9::DOUBLE * (location_id % 7) AS side FROM location_metrics)
        WHERE longitude + side >= 135 AND longitude <= 137.5 AND latitude + side >= 34 AND latitude <= 35.5""",
        "location_metrics",
    ),
)
def stored_filter_bounds(spark, sf_dir):
    path = _ingested(spark, sf_dir)
    return ft.stored_filter_by_bounds(spark, path, "ring", 135.0, 34.0, 137.5, 35.5, zoom=7).select("building_id")


def _ingested(spark, sf_dir):
    """Squares of 0.001 to 5.4 degrees, written by tile."""
    side = F.lit(0.001) + F.lit(0.9) * (F.col(KEY) % 7)
    x, y = F.col("longitude"), F.col("latitude")
    corners = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners])
    squares = fx.location_metrics(spark, sf_dir).select(F.col(KEY).alias("building_id"), ring.alias("ring"))
    path = new_folder(spark, "features")
    ft.write_features(squares, path, "ring", zoom=7)
    return path


@query(
    "results_table",
    with_views(
        """SELECT location_id, latitude, longitude, name, CAST(1000 AS INTEGER) AS radius, sparsity, resilience,
          multi_nodality, permeability, emergence, overlap FROM location_metrics""",
        "location_metrics",
    ),
)
def results_table(spark, sf_dir):
    """The result table written as CSV and read back, the first of two paths missing."""
    path = new_folder(spark, "results")
    columns = [c.split()[0] for c in rs.RESULT_SCHEMA.split(", ")]
    rows = fx.location_metrics(spark, sf_dir).withColumn("radius", F.lit(1000)).select(columns)
    rs.write_results(rows, f"{path}/table", "csv")
    return rs.read_results(spark, f"{path}/missing", f"{path}/table")


@query(
    "sample_cycle",
    with_views(
        """SELECT location_id, CAST(location_id % 7 AS BIGINT) AS city_order, location_id < 7 AS at_centre,
          true AS near FROM location_metrics""",
        "location_metrics",
    ),
)
def sample_cycle(spark, sf_dir):
    cities = loc.seven_cities(spark).withColumnRenamed(KEY, "city_order")
    wanted = fx.location_metrics(spark, sf_dir)
    drawn = loc.sample_locations_cycle(wanted, cities, 7)
    centre = cities.select("city_order", F.col("latitude").alias("clat"), F.col("longitude").alias("clon"))
    dlat, dlon = F.abs(F.col("latitude") - F.col("clat")), F.abs(F.col("longitude") - F.col("clon"))
    return drawn.join(centre, "city_order").select(
        KEY,
        "city_order",
        ((dlat == 0) & (dlon == 0)).alias("at_centre"),
        ((dlat <= 0.5) & (dlon <= 0.5)).alias("near"),
    )
