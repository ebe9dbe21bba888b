"""Geometry-shaped views over the test tables, in SQL both engines read alike.

Buildings are axis-aligned rectangles in projected metres, roads are two- or three-vertex lines
on a lattice, and the result table has one row per customer. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUILDINGS_SQL = """
SELECT location_id, building_id, btype AS type, w * h AS area_m2, x0, y0, x0 + w AS x1, y0 + h AS y1
FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS location_id, CAST(c_custkey AS BIGINT) AS building_id,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'residential' WHEN 'FURNITURE' THEN 'commercial'
      WHEN 'MACHINERY' THEN 'industrial' WHEN 'BUILDING' THEN 'public' ELSE 'unknown' END AS btype,
    CASE WHEN c_custkey % 11 = 0 THEN CAST(c_custkey * 7919 % 10007 AS DOUBLE) / CAST(10 AS DOUBLE)
      ELSE CAST(c_custkey % 2 * 400 AS DOUBLE) + CAST(c_custkey * 7919 % 1201 AS DOUBLE) / CAST(10 AS DOUBLE) END AS x0,
    CASE WHEN c_custkey % 11 = 0 THEN CAST(c_custkey * 104729 % 10007 AS DOUBLE) / CAST(10 AS DOUBLE)
      ELSE CASE WHEN c_custkey % 4 >= 2 THEN CAST(400 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
        + CAST(c_custkey * 104729 % 1201 AS DOUBLE) / CAST(10 AS DOUBLE) END AS y0,
    CAST(2 + c_custkey % 7 AS DOUBLE) AS w, CAST(3 + c_custkey % 5 AS DOUBLE) AS h
  FROM {customer}) t
"""

ROAD_VERTICES_SQL = """
SELECT location_id, road_id, type, width, v.vertex_index,
  CASE v.vertex_index WHEN 0 THEN gx WHEN 1 THEN gx + dx ELSE gx + dx + dy END AS x,
  CASE v.vertex_index WHEN 0 THEN gy WHEN 1 THEN gy + dy ELSE gy + dy + dx END AS y
FROM (
  SELECT CAST(p_partkey % 25 AS BIGINT) AS location_id, CAST(p_partkey AS BIGINT) AS road_id,
    CASE p_type WHEN 'PROMO' THEN 'highway' WHEN 'LARGE' THEN 'primary' WHEN 'MEDIUM' THEN 'secondary' ELSE 'residential' END AS type,
    CAST(3 + p_size % 18 AS DOUBLE) AS width,
    CAST(CAST((p_partkey - p_partkey % 25) / 25 AS BIGINT) * 5 % 17 * 60 AS DOUBLE) AS gx,
    CAST(CAST((p_partkey - p_partkey % 25) / 25 AS BIGINT) * 7 % 17 * 60 AS DOUBLE) AS gy,
    CASE WHEN CAST((p_partkey - p_partkey % 25) / 25 AS BIGINT) % 2 = 0 THEN CAST(60 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS dx,
    CASE WHEN CAST((p_partkey - p_partkey % 25) / 25 AS BIGINT) % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(60 AS DOUBLE) END AS dy,
    CASE WHEN CAST((p_partkey - p_partkey % 25) / 25 AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS last_v
  FROM {part}) r
JOIN (SELECT 0 AS vertex_index UNION ALL SELECT 1 UNION ALL SELECT 2) v ON v.vertex_index <= r.last_v
"""

LOCATION_METRICS_SQL = """
SELECT CAST(c_custkey AS BIGINT) AS location_id,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name,
  CAST(30 AS DOUBLE) + CAST(c_custkey * 7919 % 16000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
  CAST(129 AS DOUBLE) + CAST(c_custkey * 104729 % 17000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude,
  (c_acctbal + CAST(1000 AS DOUBLE)) / CAST(5500 AS DOUBLE) AS sparsity,
  CAST(c_custkey * 37 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS resilience,
  CAST(c_nationkey % 6 AS DOUBLE) AS multi_nodality,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey * 73 % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE) END AS permeability,
  CAST(c_custkey * c_custkey % 211 AS DOUBLE) / CAST(106 AS DOUBLE) AS emergence,
  CAST(0 AS DOUBLE) AS overlap
FROM {customer}
"""

METRICS = ["sparsity", "resilience", "multi_nodality", "permeability", "emergence", "overlap"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def building_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BUILDINGS_SQL, customer=_table(spark, sf_dir, "customer"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``location_id, building_id, type, area_m2, ring``."""
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners])
    return building_boxes(spark, sf_dir).select(
        "location_id", "building_id", "type", "area_m2", ring.alias("ring")
    )


def road_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ROAD_VERTICES_SQL, part=_table(spark, sf_dir, "part"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``location_id, road_id, type, width, path``."""
    vertex = F.struct("vertex_index", F.struct("x", "y").alias("p"))
    return (
        road_vertices(spark, sf_dir)
        .groupBy("location_id", "road_id", "type", "width")
        .agg(F.array_sort(F.collect_list(vertex)).alias("v"))
        .select("location_id", "road_id", "type", "width", F.col("v.p").alias("path"))
    )


def location_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOCATION_METRICS_SQL, customer=_table(spark, sf_dir, "customer"))


_VIEWS = {
    "buildings": BUILDINGS_SQL.format(customer="customer"),
    "road_vertices": ROAD_VERTICES_SQL.format(part="part"),
    "location_metrics": LOCATION_METRICS_SQL.format(customer="customer"),
}


def with_views(body: str, *names: str, ctes: str = "") -> str:
    """Oracle SQL: the named views, further CTEs, then the body."""
    parts = [f"{n} AS ({_VIEWS[n]})" for n in names]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    head = "WITH RECURSIVE " + ",\n".join(parts) if parts else ""
    return f"{head}\n{body.strip()}"
