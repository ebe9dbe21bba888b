"""Box counts, clustering, grids and the six indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.catalogue import query
from tessera.catalogue.joins import GAUSS, OPEN_POINTS, POINT_GAP
from tessera.catalogue.networks import BUILDING, URBAN, distances, graph_sql, symmetric, urban
from tessera.fixtures import with_views
from tessera.lineage import new_folder
from tessera.operators import cluster as cl
from tessera.operators import grid as gr
from tessera.plans import indicators as ind
from tessera.plans.batch import run_batch
from tessera.sources import features as ft

KEY = "location_id"


def r(name, digits=6):
    return F.round(F.col(name), digits).alias(name)


# --- sparsity -----------------------------------------------------------------------------

BOXES = """
  f AS (SELECT location_id, min(x0) AS fx0, min(y0) AS fy0, max(x1) AS fx1, max(y1) AS fy1 FROM buildings GROUP BY location_id),
  bc AS (SELECT location_id, size, count(DISTINCT (ix, iy)) AS boxes FROM (
      SELECT location_id, size, fx0, fy0, fx1, fy1, floor(((x0 + x1) / 2 - fx0) / size) AS ix, floor(((y0 + y1) / 2 - fy0) / size) AS iy
      FROM buildings JOIN f USING (location_id), (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS size))
    WHERE ix < ceil((fx1 - fx0) / size) AND iy < ceil((fy1 - fy0) / size) GROUP BY location_id, size),
  fd AS (SELECT location_id, -regr_slope(ln(boxes), ln(size)) AS fractal_dimension FROM bc GROUP BY location_id HAVING count(*) = 7)
"""
WIDE = """
  f AS (SELECT location_id, min((x0 + x1) / 2) AS fx0, min((y0 + y1) / 2) AS fy0, count(*) AS n FROM buildings GROUP BY location_id),
  bc AS (SELECT location_id, size, count(DISTINCT (floor(((x0 + x1) / 2 - fx0) / size), floor(((y0 + y1) / 2 - fy0) / size))) AS boxes
    FROM buildings JOIN f USING (location_id), (SELECT unnest([10, 20, 40, 80, 160, 320]) AS size) GROUP BY location_id, size),
  fd AS (SELECT location_id, -regr_slope(ln(boxes), ln(size)) AS fractal_dimension FROM bc GROUP BY location_id)
"""


def b_sql(body, ctes=""):
    return with_views(body, "buildings", ctes=ctes)


@query("box_counts", b_sql("SELECT location_id, CAST(size AS INTEGER) AS size, boxes FROM bc", BOXES))
def box_counts(spark, sf_dir):
    return gr.box_counts(fx.buildings(spark, sf_dir))


@query("box_counts_wide", b_sql("SELECT location_id, CAST(size AS INTEGER) AS size, boxes FROM bc", WIDE))
def box_counts_wide(spark, sf_dir):
    return gr.box_counts_wide(fx.buildings(spark, sf_dir))


@query(
    "fractal_dimension",
    b_sql("SELECT location_id, round(fractal_dimension, 6) AS fractal_dimension FROM fd", BOXES),
)
def fractal_dimension(spark, sf_dir):
    counts = gr.box_counts(fx.buildings(spark, sf_dir))
    return gr.fractal_dimension(counts, len(gr.BOX_SIZES)).select(KEY, r("fractal_dimension"))


@query(
    "building_count",
    b_sql("SELECT location_id, count(*) FILTER (area_m2 >= 10) AS building_count FROM buildings GROUP BY location_id"),
)
def building_count(spark, sf_dir):
    return ind.building_count(fx.buildings(spark, sf_dir))


@query(
    "spatial_filling_ratio",
    b_sql(
        """SELECT location_id, round(sum((x1 - x0) * (y1 - y0)) / ((max(x1) - min(x0)) * (max(y1) - min(y0))), 9) AS filling_ratio
        FROM buildings GROUP BY location_id"""
    ),
)
def spatial_filling_ratio(spark, sf_dir):
    return ind.spatial_filling_ratio(fx.buildings(spark, sf_dir)).select(KEY, r("filling_ratio", 9))


SPARSITY_A = (
    BOXES
    + """, ia AS (SELECT location_id, coalesce(fractal_dimension / nullif(building_count, 0), 0) AS sparsity,
      coalesce(fractal_dimension, 0) AS fractal_dimension, building_count
    FROM (SELECT location_id, count(*) FILTER (area_m2 >= 10) AS building_count FROM buildings GROUP BY location_id)
    LEFT JOIN fd USING (location_id))"""
)


@query(
    "sparsity_a",
    b_sql(
        """SELECT location_id, round(sparsity, 6) AS sparsity, round(fractal_dimension, 6) AS fractal_dimension, building_count
        FROM ia""",
        SPARSITY_A,
    ),
)
def sparsity_a(spark, sf_dir):
    out = ind.sparsity_a(fx.buildings(spark, sf_dir))
    return out.select(KEY, r("sparsity"), r("fractal_dimension"), "building_count")


SPARSITY_B = (
    WIDE
    + """, ib AS (SELECT location_id, CASE WHEN n < 4 THEN 0 ELSE 2 - least(greatest(fractal_dimension, 0), 2) END AS sparsity
    FROM f JOIN fd USING (location_id))"""
)


@query("sparsity_b", b_sql("SELECT location_id, round(sparsity, 6) AS sparsity FROM ib", SPARSITY_B))
def sparsity_b(spark, sf_dir):
    return ind.sparsity_b(fx.buildings(spark, sf_dir)).select(KEY, r("sparsity"))


# --- clustering ---------------------------------------------------------------------------

DBSCAN = """
  p AS (SELECT location_id, building_id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM buildings),
  nb AS (SELECT a.location_id, a.building_id AS i, b.building_id AS j FROM p a JOIN p b ON a.location_id = b.location_id
    AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 50),
  core AS (SELECT location_id, i FROM nb GROUP BY location_id, i HAVING count(*) >= 5),
  ce AS (SELECT nb.* FROM nb JOIN core a ON nb.i = a.i JOIN core b ON nb.j = b.i),
  reach(i, j) AS (SELECT i, i FROM core UNION SELECT reach.i, ce.j FROM reach JOIN ce ON ce.i = reach.j),
  cc AS (SELECT i, min(j) AS comp FROM reach GROUP BY i),
  rk AS (SELECT core.location_id, core.i, dense_rank() OVER (PARTITION BY core.location_id ORDER BY comp) - 1 AS k FROM core JOIN cc USING (i)),
  lab AS (SELECT p.location_id, p.building_id, x, y, CAST(coalesce(rk.k, (SELECT min(r2.k) FROM nb JOIN rk r2 ON r2.i = nb.j WHERE nb.i = p.building_id), -1) AS INTEGER) AS cluster_id
    FROM p LEFT JOIN rk ON rk.i = p.building_id),
  cen AS (SELECT location_id, cluster_id, avg(x) AS cx, avg(y) AS cy FROM lab WHERE cluster_id >= 0 GROUP BY ALL),
  cd AS (SELECT a.location_id, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d
    FROM cen a JOIN cen b ON a.location_id = b.location_id AND a.cluster_id <> b.cluster_id),
  disp AS (SELECT location_id, var_pop(d) AS variance, stddev_pop(d) AS std, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS iqr FROM cd GROUP BY location_id),
  nc AS (SELECT location_id, count(*) AS num_points, count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS num_cores FROM lab GROUP BY location_id)
"""


def labelled(spark, sf_dir):
    return cl.dbscan(cl.centroids(fx.buildings(spark, sf_dir)))


@query("dbscan", b_sql("SELECT location_id, building_id, cluster_id FROM lab", DBSCAN))
def dbscan(spark, sf_dir):
    return labelled(spark, sf_dir).select(KEY, "building_id", "cluster_id")


@query(
    "num_cores", b_sql("SELECT location_id, num_points, num_cores FROM nc", DBSCAN)
)
def num_cores(spark, sf_dir):
    return cl.num_cores(labelled(spark, sf_dir))


for _method in ("variance", "std", "iqr"):

    @query(
        f"core_dispersion_{_method}",
        b_sql(
            f"""SELECT location_id, round(coalesce({_method}, 0), 5) AS core_dispersion
            FROM (SELECT DISTINCT location_id FROM buildings) LEFT JOIN disp USING (location_id)""",
            DBSCAN,
        ),
    )
    def core_dispersion(spark, sf_dir, method=_method):
        return cl.core_dispersion(labelled(spark, sf_dir), method).select(KEY, r("core_dispersion", 5))


@query(
    "core_diversity_shannon",
    b_sql(
        """SELECT location_id, round(coalesce(h, 0), 6) AS core_diversity
        FROM (SELECT DISTINCT location_id FROM buildings) LEFT JOIN (
          SELECT location_id, -sum(p * ln(p)) AS h FROM (
            SELECT location_id, count(*) / sum(count(*)) OVER (PARTITION BY location_id) AS p
            FROM lab WHERE cluster_id >= 0 GROUP BY location_id, cluster_id) GROUP BY location_id) USING (location_id)""",
        DBSCAN,
    ),
)
def core_diversity_shannon(spark, sf_dir):
    out = cl.core_diversity(labelled(spark, sf_dir), "shannon")
    return out.select(KEY, (F.round("core_diversity", 6) + F.lit(0.0)).alias("core_diversity"))


@query(
    "cluster_info",
    b_sql(
        """SELECT lab.location_id, lab.building_id, type, area_m2, cluster_id, x AS centroid_x, y AS centroid_y
        FROM lab JOIN buildings USING (building_id)""",
        DBSCAN,
    ),
)
def cluster_info(spark, sf_dir):
    return cl.cluster_info(fx.buildings(spark, sf_dir)).drop("ring")


@query(
    "multi_nodality_a",
    b_sql(
        """SELECT location_id, round(num_cores * coalesce(variance, 0), 4) AS multi_nodality, num_cores,
          round(coalesce(variance, 0), 4) AS core_dispersion, 1.0::DOUBLE AS core_diversity
        FROM nc LEFT JOIN disp USING (location_id)""",
        DBSCAN,
    ),
)
def multi_nodality_a(spark, sf_dir):
    out = ind.multi_nodality_a(fx.buildings(spark, sf_dir))
    return out.select(KEY, r("multi_nodality", 4), "num_cores", r("core_dispersion", 4), "core_diversity")


NODALITY_B = (
    DBSCAN
    + """, ib2 AS (SELECT location_id, CASE WHEN num_points < 10 THEN 0 ELSE
      least(1, num_cores / CAST(least(10, num_points // 10) AS DOUBLE)) END AS multi_nodality FROM nc)"""
)


@query(
    "multi_nodality_b",
    b_sql("SELECT location_id, round(multi_nodality, 6) AS multi_nodality FROM ib2", NODALITY_B),
)
def multi_nodality_b(spark, sf_dir):
    return ind.multi_nodality_b(fx.buildings(spark, sf_dir)).select(KEY, r("multi_nodality"))


# --- grids --------------------------------------------------------------------------------

GRID = """
  f AS (SELECT location_id, min(x0) AS fx0, min(y0) AS fy0, max(x1) AS fx1, max(y1) AS fy1 FROM buildings GROUP BY location_id),
  g AS (SELECT location_id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, fx0 + ix * 10.0::DOUBLE AS gx, fy0 + iy * 10.0::DOUBLE AS gy
    FROM f, range(0, 400) a(ix), range(0, 400) b(iy)
    WHERE ix < ceil((fx1 - fx0) / 10) - 1 AND iy < ceil((fy1 - fy0) / 10) - 1),
  ga AS (SELECT g.location_id, ix, iy, sum(area_m2) AS area FROM g JOIN buildings b ON b.location_id = g.location_id
    AND x1 >= gx AND x0 <= gx + 10 AND y1 >= gy AND y0 <= gy + 10 GROUP BY ALL),
  sg AS (SELECT location_id, x AS bx, y AS by_, lag(x) OVER w AS ax, lag(y) OVER w AS ay FROM road_vertices
    WINDOW w AS (PARTITION BY road_id ORDER BY vertex_index)),
  gr AS (SELECT DISTINCT g.location_id, ix, iy FROM g JOIN sg ON sg.location_id = g.location_id AND ax IS NOT NULL
    AND greatest(ax, bx) >= gx AND least(ax, bx) <= gx + 10 AND greatest(ay, by_) >= gy AND least(ay, by_) <= gy + 10)
"""


def grid_sql(body, ctes=""):
    return with_views(body, "buildings", "road_vertices", ctes=GRID + ctes)


@query("analysis_grid", grid_sql("SELECT location_id, ix, iy FROM g"))
def analysis_grid(spark, sf_dir):
    return gr.analysis_grid(gr.grid_frame(fx.buildings(spark, sf_dir)))


@query("grid_building_area", grid_sql("SELECT location_id, ix, iy, round(area, 6) AS building_area FROM ga"))
def grid_building_area(spark, sf_dir):
    shapes = fx.buildings(spark, sf_dir)
    out = gr.building_area_per_cell(shapes, gr.grid_frame(shapes))
    return out.select(KEY, "ix", "iy", r("building_area"))


@query("grid_roads", grid_sql("SELECT location_id, ix, iy FROM gr"))
def grid_roads(spark, sf_dir):
    return gr.road_cells(fx.roads(spark, sf_dir), gr.grid_frame(fx.buildings(spark, sf_dir)))


def open_cte(grid_size, roads):
    road = "gr.ix IS NOT NULL" if roads == "crossed" else "true" if roads == "all" else "false"
    return f""",
  os AS MATERIALIZED (SELECT g.location_id, g.ix, g.iy, coalesce(area, 0) / {grid_size * grid_size} AS building_density,
    coalesce(area, 0) / {grid_size * grid_size} <= 0.3::DOUBLE OR {road} AS is_open_space
    FROM g LEFT JOIN ga USING (location_id, ix, iy) LEFT JOIN gr USING (location_id, ix, iy))"""


OPEN_SQL = "SELECT location_id, ix, iy, round(building_density, 6) AS building_density, is_open_space FROM os"


@query("open_space", grid_sql(OPEN_SQL, open_cte(10, "crossed")))
def open_space(spark, sf_dir):
    out = gr.open_space(fx.buildings(spark, sf_dir), fx.roads(spark, sf_dir), grid_size=10.0)
    return out.select(KEY, "ix", "iy", r("building_density"), "is_open_space")


@query("open_space_all_roads", grid_sql(OPEN_SQL, open_cte(50, "all")))
def open_space_all_roads(spark, sf_dir):
    out = gr.open_space(fx.buildings(spark, sf_dir), fx.roads(spark, sf_dir), road_mode="all")
    return out.select(KEY, "ix", "iy", r("building_density"), "is_open_space")


# Rows of the grid without a closed cell form bands; elsewhere the open runs between closed cells.
OPEN_RUNS = """,
  n AS (SELECT location_id, max(ix) + 1 AS nx FROM g GROUP BY location_id),
  runs AS (SELECT location_id, iy, min(ix) AS x0, max(ix) AS x1 FROM (
      SELECT *, ix - row_number() OVER (PARTITION BY location_id, iy ORDER BY ix) AS k FROM os WHERE is_open_space)
    GROUP BY location_id, iy, k),
  whole AS (SELECT location_id, iy, x0, x1, iy - row_number() OVER (PARTITION BY location_id ORDER BY iy) AS band
    FROM runs JOIN n USING (location_id) WHERE x1 - x0 + 1 = nx)"""


@query(
    "open_runs",
    grid_sql(
        """SELECT location_id, min(iy) AS iy0, max(iy) AS iy1, x0, x1 FROM whole GROUP BY location_id, x0, x1, band
        UNION ALL SELECT location_id, iy, iy, x0, x1 FROM runs JOIN n USING (location_id) WHERE x1 - x0 + 1 < nx""",
        open_cte(10, "crossed") + OPEN_RUNS,
    ),
)
def open_runs(spark, sf_dir):
    shapes = fx.buildings(spark, sf_dir)
    bounds = gr.grid_frame(shapes)
    blocked = gr.blocked_cells(shapes, bounds, fx.roads(spark, sf_dir), grid_size=10.0)
    return gr.open_runs(blocked, bounds)


# Clusters of (location_id, ix, iy) cells `oc`: row runs, flooded from every run.
PERCOLATION = """,
  runs AS MATERIALIZED (SELECT location_id, iy, min(ix) AS a, max(ix) AS b, count(*) AS n, iy * 4294967296 + min(ix) AS run
    FROM (SELECT *, ix - row_number() OVER (PARTITION BY location_id, iy ORDER BY ix) AS k FROM oc) GROUP BY location_id, iy, k),
  up AS (SELECT l.location_id, l.run AS u, h.run AS v FROM runs l JOIN runs h ON l.location_id = h.location_id
    AND h.iy = l.iy + 1 AND h.a <= l.b AND h.b >= l.a),
  adj AS MATERIALIZED (SELECT location_id, u, v FROM up UNION ALL SELECT location_id, v, u FROM up),
  flood(location_id, run, other) AS (SELECT location_id, run, run FROM runs
    UNION SELECT flood.location_id, flood.run, v FROM flood JOIN adj ON adj.location_id = flood.location_id AND u = other),
  pc AS (SELECT location_id, cluster, sum(n) AS cells FROM (
      SELECT location_id, run, min(other) AS cluster FROM flood GROUP BY ALL) JOIN runs USING (location_id, run) GROUP BY ALL)
"""


@query(
    "percolation_clusters",
    grid_sql(
        "SELECT location_id, cluster, cells, cells * 100.0::DOUBLE AS area FROM pc",
        open_cte(10, "none")
        + ", oc AS (SELECT location_id, ix, iy FROM os WHERE NOT is_open_space)"
        + PERCOLATION,
    ),
)
def percolation_clusters(spark, sf_dir):
    """Clusters of built-up (not open) cells."""
    cells = gr.open_space(fx.buildings(spark, sf_dir), grid_size=10.0).filter("NOT is_open_space")
    return gr.percolation_clusters(cells, 10.0)


def permeability_sql(grid_size, roads):
    return grid_sql(
        f"""SELECT location_id, round(coalesce(max(cells) / sum(cells), 0), 6) AS permeability,
          coalesce(max(cells), 0) * {float(grid_size**2)}::DOUBLE AS largest_cluster_area,
          coalesce(sum(cells), 0)::DOUBLE * {grid_size**2} AS total_open_area,
          count(cells) AS num_clusters, 0.5927::DOUBLE AS percolation_threshold
        FROM f LEFT JOIN pc USING (location_id) GROUP BY location_id""",
        open_cte(grid_size, roads)
        + ", oc AS (SELECT location_id, ix, iy FROM os WHERE is_open_space)"
        + PERCOLATION,
    )


@query("permeability_a", permeability_sql(50, "crossed"))
def permeability_a(spark, sf_dir):
    out = ind.permeability_a(fx.buildings(spark, sf_dir), fx.roads(spark, sf_dir))
    return out.withColumn("permeability", F.round("permeability", 6))


@query("permeability_a_fine", permeability_sql(10, "none"))
def permeability_a_fine(spark, sf_dir):
    out = ind.permeability_a(fx.buildings(spark, sf_dir), grid_size=10.0)
    return out.withColumn("permeability", F.round("permeability", 6))


PERMEABILITY_B = (
    """,
  oc AS (SELECT DISTINCT location_id, CAST(floor(((x0 + x1) / 2 - fx0) / 50) AS BIGINT) AS ix, CAST(floor(((y0 + y1) / 2 - fy0) / 50) AS BIGINT) AS iy
    FROM buildings JOIN f USING (location_id))"""
    + PERCOLATION
    + """, ib3 AS (SELECT location_id, CASE WHEN location_id IN (SELECT location_id FROM road_vertices) THEN
      least(1, most / ((floor((fx1 - fx0) / 50) + 1) * (floor((fy1 - fy0) / 50) + 1))) ELSE 0 END AS permeability
    FROM f JOIN (SELECT location_id, max(cells) AS most FROM pc GROUP BY location_id) USING (location_id))"""
)


@query(
    "permeability_b",
    grid_sql("SELECT location_id, round(permeability, 6) AS permeability FROM ib3", PERMEABILITY_B),
)
def permeability_b(spark, sf_dir):
    out = ind.permeability_b(fx.buildings(spark, sf_dir), fx.roads(spark, sf_dir))
    return out.select(KEY, r("permeability"))


# --- network-based indicators -------------------------------------------------------------

EMERGENCE_B = """
  ib4 AS (SELECT b.location_id, least(1, mean * n_b / area * 1000) AS emergence
    FROM (SELECT location_id, count(*) AS n_b, (max(x1) - min(x0)) * (max(y1) - min(y0)) AS area FROM buildings GROUP BY location_id) b
    JOIN (SELECT n.location_id, 2 * m / (n * (n - 1)) AS mean FROM (SELECT location_id, count(*) AS n FROM un GROUP BY location_id) n
      JOIN (SELECT location_id, count(*) AS m FROM ue GROUP BY location_id) e ON e.location_id = n.location_id) c ON c.location_id = b.location_id)
"""


@query(
    "emergence_b",
    graph_sql("SELECT location_id, round(emergence, 6) AS emergence FROM ib4", URBAN + "," + EMERGENCE_B),
)
def emergence_b(spark, sf_dir):
    return ind.emergence_b(fx.buildings(spark, sf_dir), urban(spark, sf_dir)).select(KEY, r("emergence"))


WITHIN_200 = BUILDING.replace("<= 100", "<= 200")
EMERGENCE_CLOSENESS = (
    symmetric(WITHIN_200)
    + ","
    + distances("dist", "sym.w")
    + ","
    + OPEN_POINTS
    + f""",
  cl AS (SELECT location_id, s AS node, CASE WHEN total > 0 THEN (r - 1) / total * (r - 1) / (n - 1) ELSE 0 END AS c
    FROM (SELECT location_id, s, count(*) AS r, sum(d) AS total FROM dist GROUP BY ALL)
    JOIN (SELECT location_id, count(*) AS n FROM un GROUP BY location_id) USING (location_id)),
  nn AS (SELECT * FROM (SELECT location_id, ix, iy, node, row_number() OVER (PARTITION BY location_id, ix, iy ORDER BY d, length(node), node) AS k
    FROM (SELECT op.location_id, ix, iy, node, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d FROM op JOIN un USING (location_id)) WHERE d <= 200) WHERE k = 1),
  dn AS (SELECT op.location_id, ix, iy, coalesce(sum(area_m2 * {GAUSS}) FILTER ({POINT_GAP} <= 200), 0) / (pi() * 40000) AS density
    FROM op JOIN buildings b USING (location_id) GROUP BY ALL),
  sc AS (SELECT dn.location_id, coalesce(c, 0) AS c, coalesce(c, 0) / (1 + density) AS e FROM dn
    LEFT JOIN nn USING (location_id, ix, iy) LEFT JOIN cl USING (location_id, node))"""
)


@query(
    "emergence_a_closeness",
    graph_sql(
        """SELECT location_id, round(sum(e) / (3 * count(*)), 9) AS emergence, count(*) AS num_open_spaces,
          3 * count(*) AS num_emergence_scores, 0.0::DOUBLE AS mean_betweenness, round(avg(c), 9) AS mean_closeness,
          0.0::DOUBLE AS mean_eigenvector FROM sc GROUP BY location_id""",
        EMERGENCE_CLOSENESS,
    ),
)
def emergence_a_closeness(spark, sf_dir):
    out = ind.emergence_a(fx.buildings(spark, sf_dir), method="closeness")
    return out.withColumn("emergence", F.round("emergence", 9)).withColumn(
        "mean_closeness", F.round("mean_closeness", 9)
    )


@query("emergence_a")
def emergence_a(spark, sf_dir):
    return ind.emergence_a(fx.buildings(spark, sf_dir))


@query("emergence_a_eigenvector")
def emergence_a_eigenvector(spark, sf_dir):
    return ind.emergence_a(fx.buildings(spark, sf_dir), method="eigenvector")


@query("resilience_a")
def resilience_a(spark, sf_dir):
    return ind.resilience_a(fx.buildings(spark, sf_dir), fx.roads(spark, sf_dir))


@query("resilience_single")
def resilience_single(spark, sf_dir):
    return ind.resilience_single(fx.buildings(spark, sf_dir), fx.roads(spark, sf_dir))


@query("resilience_b")
def resilience_b(spark, sf_dir):
    return ind.resilience_b(urban(spark, sf_dir))


@query("all_indicators")
def all_indicators(spark, sf_dir):
    return ind.all_indicators(fx.buildings(spark, sf_dir), fx.roads(spark, sf_dir))


def _lonlat_features(spark, sf_dir):
    """Buildings and roads of each location around a place of its own, in degrees, as feature tables by kind."""

    def moved(shape):
        return F.transform(
            shape, lambda p: F.struct((138.5 + F.col(KEY) * 0.1 + p.x / 1e5).alias("x"), (35.0 + p.y / 1e5).alias("y"))
        )

    buildings = fx.buildings(spark, sf_dir).select(
        KEY, F.col("building_id").alias("feature_id"), "type", F.lit(None).cast("double").alias("width"), moved("ring").alias("shape")
    )
    roads = fx.roads(spark, sf_dir).select(KEY, F.col("road_id").alias("feature_id"), "type", "width", moved("path").alias("shape"))
    return {"building": buildings, "road": roads}


@query("batch_results")
def batch_results(spark, sf_dir):
    """The whole batch over ingested tables: even locations have national features, the others open-map ones,
    every seventh none at all."""
    paths = {"national": {}, "open": {}}
    for kind, rows in _lonlat_features(spark, sf_dir).items():
        for source, mine in (("national", f"{KEY} % 2 = 0"), ("open", "true")):
            paths[source][kind] = new_folder(spark, f"{source}-{kind}")
            some = rows.filter(f"{KEY} % 7 <> 3").filter(mine).drop(KEY)
            ft.write_features(some, paths[source][kind], "shape", zoom=10)
    places = fx.buildings(spark, sf_dir).select(KEY).distinct().select(
        KEY, F.lit(35.005).alias("latitude"), (138.505 + F.col(KEY) * 0.1).alias("longitude"),
        F.concat(F.lit("place "), KEY).alias("name"), F.lit(2000).alias("radius"),
    )
    out = new_folder(spark, "batch")
    run_batch(spark, paths["national"], paths["open"], places, out)
    return spark.read.parquet(out)


@query("detailed_indicators")
def detailed_indicators(spark, sf_dir):
    return ind.detailed_indicators(fx.buildings(spark, sf_dir), fx.roads(spark, sf_dir))
