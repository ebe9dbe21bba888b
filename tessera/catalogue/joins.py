"""Distance joins and the indicators that rest on them alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.catalogue import query
from tessera.fixtures import with_views
from tessera.functions import geometry as g
from tessera.operators import networks as nw
from tessera.operators import overlap as ov
from tessera.operators import proximity as px

KEY = "location_id"

# Rectangle-to-rectangle distance in check SQL.
GAP = """sqrt(power(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 2) + power(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 2))"""


def r(name, digits=6):
    return F.round(F.col(name), digits).alias(name)


def proximity_sql(distance, weight="d"):
    return with_views(
        f"""SELECT location_id, building_a, building_b, round(d, 6) AS distance, round({weight}, 6) AS weight FROM (
          SELECT a.location_id, a.building_id AS building_a, b.building_id AS building_b, {GAP} AS d
          FROM buildings a JOIN buildings b ON a.location_id = b.location_id AND a.building_id < b.building_id)
        WHERE d <= {distance}""",
        "buildings",
    )


@query("building_proximity_200", proximity_sql(200))
def building_proximity_200(spark, sf_dir):
    pairs = px.building_proximity(fx.buildings(spark, sf_dir), 200.0)
    return pairs.select(KEY, "building_a", "building_b", *[g.rounded(F.col(c), 6).alias(c) for c in ("distance", "weight")])


@query("building_proximity_uniform_100", proximity_sql(100, "1.0::DOUBLE"))
def building_proximity_uniform_100(spark, sf_dir):
    pairs = px.building_proximity(fx.buildings(spark, sf_dir), 100.0, "uniform")
    return pairs.select(KEY, "building_a", "building_b", *[g.rounded(F.col(c), 6).alias(c) for c in ("distance", "weight")])


# Road nodes: one per distinct rounded vertex, in order of first appearance.
ROAD_NODES = """
  rn AS (SELECT location_id, x, y, min(road_id * 1000 + vertex_index) AS node_order,
    'r:' || CAST(x AS BIGINT) || ':' || CAST(y AS BIGINT) AS node FROM road_vertices GROUP BY location_id, x, y)
"""
DIST = "sqrt(((x0 + x1) / 2 - x) * ((x0 + x1) / 2 - x) + ((y0 + y1) / 2 - y) * ((y0 + y1) / 2 - y))"
NEAREST = f"""
  nr AS (SELECT * FROM (SELECT location_id, building_id, x, y, {DIST} AS d,
      row_number() OVER (PARTITION BY building_id ORDER BY {DIST}, node_order) AS k
    FROM buildings JOIN rn USING (location_id) WHERE {DIST} <= 100) WHERE k = 1)
"""


@query(
    "nearest_road_node",
    with_views(
        "SELECT location_id, building_id, x, y, round(d, 6) AS distance FROM nr",
        "buildings",
        "road_vertices",
        ctes=ROAD_NODES + "," + NEAREST,
    ),
)
def nearest_road_node(spark, sf_dir):
    nodes = nw.road_nodes(fx.roads(spark, sf_dir), digits=2)
    found = px.connect_nearest(fx.buildings(spark, sf_dir), nodes, 100.0)
    return found.join(nodes.select(KEY, "node", "x", "y"), [KEY, "node"]).select(
        KEY, "building_id", "x", "y", r("distance")
    )


@query(
    "all_road_nodes_50",
    with_views(
        f"""SELECT location_id, building_id, x, y, round({DIST}, 6) AS distance
        FROM buildings JOIN rn USING (location_id) WHERE {DIST} <= 50""",
        "buildings",
        "road_vertices",
        ctes=ROAD_NODES,
    ),
)
def all_road_nodes_50(spark, sf_dir):
    nodes = nw.road_nodes(fx.roads(spark, sf_dir), digits=6)
    found = px.connect_all(fx.buildings(spark, sf_dir), nodes, 50.0)
    return found.join(nodes.select(KEY, "node", "x", "y"), [KEY, "node"]).select(
        KEY, "building_id", "x", "y", r("distance")
    )


POINT_GAP = "sqrt(power(greatest(0, b.x0 - px, px - b.x1), 2) + power(greatest(0, b.y0 - py, py - b.y1), 2))"
OPEN_POINTS = f"""
  ext AS (SELECT location_id, min(x0) AS ex0, min(y0) AS ey0, max(x1) AS ex1, max(y1) AS ey1
    FROM buildings GROUP BY location_id),
  lattice AS (SELECT location_id, ix, iy, ex0 + ix * 100.0::DOUBLE AS px, ey0 + iy * 100.0::DOUBLE AS py
    FROM ext, range(0, 200) i(ix), range(0, 200) j(iy)
    WHERE ix < ceil((ex1 - ex0) / 100) AND iy < ceil((ey1 - ey0) / 100)),
  op AS (SELECT l.location_id, ix, iy, any_value(px) AS px, any_value(py) AS py, min({POINT_GAP}) AS min_distance
    FROM lattice l JOIN buildings b USING (location_id) GROUP BY l.location_id, ix, iy HAVING min({POINT_GAP}) >= 50)
"""


@query(
    "open_points",
    with_views(
        """SELECT location_id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, round(px, 6) AS px,
          round(py, 6) AS py, round(min_distance, 6) AS min_distance FROM op""",
        "buildings",
        ctes=OPEN_POINTS,
    ),
)
def open_points(spark, sf_dir):
    return px.open_points(fx.buildings(spark, sf_dir)).select(
        KEY, F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"),
        r("px"), r("py"), r("min_distance"),
    )


@query(
    "nearest_network_node",
    with_views(
        """SELECT location_id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, building_id, round(d, 6) AS distance
        FROM (SELECT *, row_number() OVER (PARTITION BY location_id, ix, iy ORDER BY d, building_id) AS k FROM (
          SELECT op.location_id, ix, iy, building_id,
            sqrt((px - (x0 + x1) / 2) * (px - (x0 + x1) / 2) + (py - (y0 + y1) / 2) * (py - (y0 + y1) / 2)) AS d
          FROM op JOIN buildings b USING (location_id)) WHERE d <= 200) WHERE k = 1""",
        "buildings",
        ctes=OPEN_POINTS,
    ),
)
def nearest_network_node(spark, sf_dir):
    """Open points to the nearest node of the building graph."""
    shapes = fx.buildings(spark, sf_dir)
    nodes = px.footprints(shapes).select(
        KEY,
        F.col("building_id").alias("node"),
        F.col("building_id").alias("node_order"),
        F.col("cx").alias("x"),
        F.col("cy").alias("y"),
    )
    points = px.open_points(shapes)
    found = px.nearest_node(points, nodes, 200.0, ("px", "py"))
    return points.join(found, [KEY, "px", "py"]).select(
        KEY,
        F.col("ix").cast("long").alias("ix"),
        F.col("iy").cast("long").alias("iy"),
        F.col("node").alias("building_id"),
        r("distance"),
    )


def density_sql(weight):
    return with_views(
        f"""SELECT op.location_id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy,
          round(coalesce(sum(area_m2 * {weight}) FILTER ({POINT_GAP} <= 200), 0) / (pi() * 40000), 9) AS density
        FROM op JOIN buildings b USING (location_id) GROUP BY op.location_id, ix, iy""",
        "buildings",
        ctes=OPEN_POINTS,
    )


GAUSS = """exp(-(power(px - (x0 + x1) / 2, 2) + power(py - (y0 + y1) / 2, 2)) / (2 * power(200 / 3.0::DOUBLE, 2)))"""

for _method, _weight in (("gaussian", GAUSS), ("uniform", "1")):

    @query(f"building_density_{_method}", density_sql(_weight))
    def building_density(spark, sf_dir, method=_method):
        shapes = fx.buildings(spark, sf_dir)
        out = px.building_density(px.open_points(shapes), shapes, 200.0, method)
        return out.select(
            KEY, F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"),
            r("density", 9),
        )


# --- functional mix -----------------------------------------------------------------------

KNOWN = "('residential', 'commercial', 'industrial', 'public')"


@query(
    "attribute_distribution",
    with_views(
        f"""SELECT location_id, count(*) FILTER (type = 'residential') AS residential,
          count(*) FILTER (type = 'commercial') AS commercial, count(*) FILTER (type = 'industrial') AS industrial,
          count(*) FILTER (type = 'public') AS public, count(*) FILTER (type NOT IN {KNOWN}) AS other
        FROM buildings GROUP BY location_id""",
        "buildings",
    ),
)
def attribute_distribution(spark, sf_dir):
    return ov.attribute_distribution(fx.buildings(spark, sf_dir))


ASSIGNED = f"""
  near AS (SELECT a.location_id, a.building_id, b.type, count(*) AS n
    FROM buildings a JOIN buildings b ON a.location_id = b.location_id AND {GAP} <= 100 GROUP BY ALL),
  shared AS (SELECT location_id, building_id, type FROM (
      SELECT *, n / sum(n) OVER (PARTITION BY building_id) AS share FROM near) WHERE share >= 0.1::DOUBLE AND type IN {KNOWN}
    UNION SELECT location_id, building_id, type FROM buildings WHERE type IN {KNOWN}),
  assigned AS (SELECT b.location_id, b.building_id, count(s.type) AS num_attributes,
      coalesce(string_agg(s.type, ',' ORDER BY s.type), '') AS attributes
    FROM buildings b LEFT JOIN shared s ON s.building_id = b.building_id GROUP BY ALL)
"""


@query(
    "assign_attributes",
    with_views("SELECT * FROM assigned", "buildings", ctes=ASSIGNED),
)
def assign_attributes(spark, sf_dir):
    return ov.assign_attributes(fx.buildings(spark, sf_dir)).select(
        KEY,
        "building_id",
        F.col("num_attributes").cast("long").alias("num_attributes"),
        F.array_join("attributes", ",").alias("attributes"),
    )


@query(
    "neighbour_types",
    with_views(
        "SELECT location_id, building_id, type, n FROM near", "buildings", ctes=ASSIGNED
    ),
)
def neighbour_types(spark, sf_dir):
    shapes = fx.buildings(spark, sf_dir)
    near = px.neighbour_types(shapes).withColumnRenamed("type", "near_type")
    own = px.footprints(shapes)
    same = [own[c] == near[c] for c in (KEY, *px.BOX)] + [own["shape"].eqNullSafe(near["shape"])]
    return own.join(near, same).select(own[KEY], "building_id", F.col("near_type").alias("type"), "n")


@query(
    "overlapping_buildings",
    with_views(
        "SELECT location_id, building_id, attributes FROM assigned WHERE num_attributes > 1",
        "buildings",
        ctes=ASSIGNED,
    ),
)
def overlapping_buildings(spark, sf_dir):
    rows = ov.overlapping_buildings(ov.assign_attributes(fx.buildings(spark, sf_dir)))
    return rows.select(KEY, "building_id", F.array_join("attributes", ",").alias("attributes"))


@query(
    "overlap_matrix",
    with_views(
        f"""SELECT l.location_id, k.attribute, count(*) FILTER (b.type = 'residential') AS residential,
          count(*) FILTER (b.type = 'commercial') AS commercial, count(*) FILTER (b.type = 'industrial') AS industrial,
          count(*) FILTER (b.type = 'public') AS public
        FROM (SELECT DISTINCT location_id FROM buildings) l
        CROSS JOIN (SELECT unnest(['residential', 'commercial', 'industrial', 'public']) AS attribute) k
        LEFT JOIN shared a ON a.location_id = l.location_id AND a.type = k.attribute
        LEFT JOIN shared b ON b.building_id = a.building_id AND b.type <> a.type
        GROUP BY l.location_id, k.attribute""",
        "buildings",
        ctes=ASSIGNED,
    ),
)
def overlap_matrix(spark, sf_dir):
    return ov.overlap_matrix(ov.assign_attributes(fx.buildings(spark, sf_dir)))


@query(
    "functional_diversity",
    with_views(
        f"""SELECT location_id, round(sum(-p * ln(p + 1e-10::DOUBLE)), 6) AS diversity FROM (
          SELECT location_id, count(*) / sum(count(*)) OVER (PARTITION BY location_id) AS p
          FROM buildings GROUP BY location_id, CASE WHEN type IN {KNOWN} THEN type ELSE 'other' END)
        GROUP BY location_id""",
        "buildings",
    ),
)
def functional_diversity(spark, sf_dir):
    return ov.functional_diversity(fx.buildings(spark, sf_dir)).select(KEY, r("diversity"))


@query(
    "overlap",
    with_views(
        """SELECT location_id, round(count(*) FILTER (num_attributes > 1) / count(*), 6) AS overlap,
          count(*) AS total_buildings, count(*) FILTER (num_attributes > 1) AS overlapping_buildings
        FROM assigned GROUP BY location_id""",
        "buildings",
        ctes=ASSIGNED,
    ),
)
def overlap(spark, sf_dir):
    out = ov.overlap(fx.buildings(spark, sf_dir))
    return out.select(KEY, r("overlap"), "total_buildings", "overlapping_buildings")


@query(
    "overlap_stub",
    with_views(
        """SELECT location_id, 0.0::DOUBLE AS overlap, count(*) AS total_buildings, 0::BIGINT AS overlapping_buildings
        FROM buildings GROUP BY location_id""",
        "buildings",
    ),
)
def overlap_stub(spark, sf_dir):
    return ov.overlap(fx.buildings(spark, sf_dir), mode="stub")
