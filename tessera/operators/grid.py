"""Box counting, analysis grids and percolation on sparse ``(location_id, ix, iy)`` cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.lineage import cut
from tessera.operators.components import connected_components
from tessera.operators.proximity import footprints

KEY = "location_id"
BOX_SIZES = [1, 2, 4, 8, 16, 32, 64]
WIDE_BOX_SIZES = [10, 20, 40, 80, 160, 320]


def frame(shapes: DataFrame) -> DataFrame:
    """Bounds of each location's footprints."""
    return shapes.groupBy(KEY).agg(
        F.min("x_min").alias("fx0"),
        F.min("y_min").alias("fy0"),
        F.max("x_max").alias("fx1"),
        F.max("y_max").alias("fy1"),
    )


def _occupied(spots: DataFrame, origin: DataFrame, sizes: list[int], bounded: bool) -> DataFrame:
    size = F.col("size").cast("double")
    ix = F.floor((F.col("cx") - F.col("fx0")) / size)
    iy = F.floor((F.col("cy") - F.col("fy0")) / size)
    placed = (
        spots.join(origin, KEY)
        .withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
        .withColumn("ix", ix)
        .withColumn("iy", iy)
    )
    if bounded:
        placed = placed.filter(
            (F.col("ix") < F.ceil((F.col("fx1") - F.col("fx0")) / size))
            & (F.col("iy") < F.ceil((F.col("fy1") - F.col("fy0")) / size))
        )
    return placed.groupBy(KEY, "size").agg(F.count_distinct("ix", "iy").alias("boxes"))


def box_counts(buildings: DataFrame, sizes: list[int] = BOX_SIZES) -> DataFrame:
    """Boxes holding a centroid, per box size; boxes start at the footprint bounds."""
    shapes = footprints(buildings)
    return _occupied(shapes.select(KEY, "cx", "cy"), frame(shapes), sizes, bounded=True)


def box_counts_wide(buildings: DataFrame, sizes: list[int] = WIDE_BOX_SIZES) -> DataFrame:
    """The same from the smallest centroid, with no upper bound."""
    spots = footprints(buildings).select(KEY, "cx", "cy")
    origin = spots.groupBy(KEY).agg(F.min("cx").alias("fx0"), F.min("cy").alias("fy0"))
    return _occupied(spots, origin, sizes, bounded=False)


def fractal_dimension(counts: DataFrame, n_sizes: int) -> DataFrame:
    """Minus the slope of ln(boxes) on ln(size); 0 unless every one of ≥ 2 sizes has boxes."""
    slope = F.regr_slope(F.ln(F.col("boxes")), F.ln(F.col("size").cast("double")))
    return counts.groupBy(KEY).agg(
        F.when((F.count("*") == n_sizes) & (F.lit(n_sizes) > 1), -slope)
        .otherwise(F.lit(0.0))
        .alias("fractal_dimension")
    )


# --- analysis grid ------------------------------------------------------------------------


def _cells_along(low: str, high: str, size: float) -> Column:
    """Number of cells: the stepped coordinates without the last one."""
    return F.greatest(F.ceil((F.col(high) - F.col(low)) / F.lit(size)) - 1, F.lit(0))


def grid_frame(
    buildings: DataFrame, resolution: float = 10.0, locations: DataFrame | None = None
) -> DataFrame:
    """Origin and cell counts per location; a 2 km square round 0 where nothing is built."""
    bounds = frame(footprints(buildings))
    if locations is not None:
        bounds = locations.select(KEY).join(bounds, KEY, "left")
        for name, default in (("fx0", -1000.0), ("fy0", -1000.0), ("fx1", 1000.0), ("fy1", 1000.0)):
            bounds = bounds.withColumn(name, F.coalesce(name, F.lit(default)))
    return bounds.select(
        KEY,
        "fx0",
        "fy0",
        _cells_along("fx0", "fx1", resolution).alias("nx"),
        _cells_along("fy0", "fy1", resolution).alias("ny"),
    )


def analysis_grid(bounds: DataFrame) -> DataFrame:
    """All cells. Columns of the grid are spread over tasks before the rows are generated."""
    empty = F.array().cast("array<bigint>")

    def indices(n: str) -> Column:
        return F.explode(
            F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(empty)
        )

    return (
        bounds.select(KEY, "ny", indices("nx").alias("ix"))
        .repartition(KEY, "ix")
        .select(KEY, "ix", indices("ny").alias("iy"))
    )


def _covered(low: str, high: str, origin: str, n: str, size: float) -> Column:
    """Indices of cells that can touch [low, high]; the exact test follows."""
    first = F.floor((F.col(low) - F.col(origin)) / F.lit(size)) - 1
    last = F.floor((F.col(high) - F.col(origin)) / F.lit(size)) + 1
    lo, hi = F.greatest(first, F.lit(0).cast("long")), F.least(last, F.col(n) - 1)
    return F.explode(
        F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    )


def _cell_corners(df: DataFrame, size: float) -> DataFrame:
    return (
        df.withColumn("gx0", F.col("fx0") + F.col("ix") * F.lit(size))
        .withColumn("gy0", F.col("fy0") + F.col("iy") * F.lit(size))
        .withColumn("gx1", F.col("gx0") + F.lit(size))
        .withColumn("gy1", F.col("gy0") + F.lit(size))
    )


def building_area_per_cell(
    buildings: DataFrame, bounds: DataFrame, resolution: float = 10.0
) -> DataFrame:
    """Whole area of every building a cell touches, summed; untouched cells are absent."""
    shapes = footprints(buildings).groupBy(KEY, "x_min", "y_min", "x_max", "y_max", "shape").agg(
        F.sum("area_m2").alias("area")
    )
    spread = (
        shapes.join(bounds, KEY)
        .withColumn("ix", _covered("x_min", "x_max", "fx0", "nx", resolution))
        .withColumn("iy", _covered("y_min", "y_max", "fy0", "ny", resolution))
    )
    exact = F.expr(
        "shape IS NULL OR " + g.ring_meets_box("shape", "gx0", "gy0", "gx1", "gy1")
    )
    touching = _cell_corners(spread, resolution).filter(
        (F.col("x_max") >= F.col("gx0"))
        & (F.col("x_min") <= F.col("gx1"))
        & (F.col("y_max") >= F.col("gy0"))
        & (F.col("y_min") <= F.col("gy1"))
        & exact
    )
    return touching.groupBy(KEY, "ix", "iy").agg(F.sum("area").alias("building_area"))


def road_cells(roads: DataFrame, bounds: DataFrame, resolution: float = 10.0) -> DataFrame:
    """Cells a road meets: per segment, column by column, so a long diagonal stays linear."""
    parts = roads.select(KEY, F.explode(g.segments(F.col("path"))).alias("s")).distinct()
    ends = parts.join(bounds, KEY).select(
        KEY, "fx0", "fy0", "nx", "ny", "s",
        F.least("s.a.x", "s.b.x").alias("x_min"), F.greatest("s.a.x", "s.b.x").alias("x_max"),
        F.least("s.a.y", "s.b.y").alias("y_min"), F.greatest("s.a.y", "s.b.y").alias("y_max"),
    )
    by_column = ends.withColumn("ix", _covered("x_min", "x_max", "fx0", "nx", resolution))
    left = F.col("fx0") + F.col("ix") * F.lit(resolution)
    run = F.col("s.b.x") - F.col("s.a.x")

    def height(x: Column) -> Column:
        t = F.least(F.greatest(F.try_divide(x - F.col("s.a.x"), run), F.lit(0.0)), F.lit(1.0))
        return F.col("s.a.y") + t * (F.col("s.b.y") - F.col("s.a.y"))

    near, far = height(left), height(left + F.lit(resolution))
    steep = run == 0
    narrowed = by_column.withColumn(
        "lo", F.when(steep, F.col("y_min")).otherwise(F.least(near, far))
    ).withColumn("hi", F.when(steep, F.col("y_max")).otherwise(F.greatest(near, far)))
    spread = narrowed.withColumn("iy", _covered("lo", "hi", "fy0", "ny", resolution))
    meets = F.expr(g.path_meets_box("array(s.a, s.b)", "gx0", "gy0", "gx1", "gy1"))
    return _cell_corners(spread, resolution).filter(meets).select(KEY, "ix", "iy").distinct()


def open_space(
    buildings: DataFrame,
    roads: DataFrame | None = None,
    resolution: float = 10.0,
    grid_size: float = 50.0,
    threshold: float = 0.3,
    road_mode: str = "crossed",
    locations: DataFrame | None = None,
) -> DataFrame:
    """Every grid cell with its built density and whether it is open.

    ``road_mode='crossed'`` opens the cells a road meets. ``'all'`` opens every cell as soon as
    roads are given, which is what the reference results show.
    """
    bounds = grid_frame(buildings, resolution, locations)
    cells = analysis_grid(bounds)
    built = building_area_per_cell(buildings, bounds, resolution)
    density = F.coalesce("building_area", F.lit(0.0)) / F.lit(grid_size**2)
    out = (
        cells.join(built, [KEY, "ix", "iy"], "left")
        .withColumn("building_density", density)
        .withColumn("is_open_space", F.col("building_density") <= threshold)
        .drop("building_area")
    )
    if roads is None:
        return out
    if road_mode == "all":
        return out.withColumn("is_open_space", F.lit(True))
    crossed = road_cells(roads, bounds, resolution).withColumn("crossed", F.lit(True))
    return (
        out.join(crossed, [KEY, "ix", "iy"], "left")
        .withColumn("is_open_space", F.col("is_open_space") | F.col("crossed").isNotNull())
        .drop("crossed")
    )


# --- runs of cells ------------------------------------------------------------------------


def blocked_cells(
    buildings: DataFrame,
    bounds: DataFrame,
    roads: DataFrame | None = None,
    resolution: float = 10.0,
    grid_size: float = 50.0,
    threshold: float = 0.3,
    road_mode: str = "crossed",
) -> DataFrame:
    """The cells that ``open_space`` leaves closed; all others of the grid are open."""
    built = building_area_per_cell(buildings, bounds, resolution)
    density = F.col("building_area") / F.lit(grid_size**2)
    blocked = built.filter(density > threshold).select(KEY, "ix", "iy")
    if roads is None:
        return blocked
    if road_mode == "all":
        return blocked.limit(0)
    return blocked.join(road_cells(roads, bounds, resolution), [KEY, "ix", "iy"], "left_anti")


def open_runs(blocked: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rectangles ``iy0, iy1, x0, x1`` of open cells, both ends included.

    In a row with blocked cells these are the gaps between them; rows without any form one band from
    side to side. So the number of rows follows the blocked cells, not the size of the grid.
    """
    blocked = cut(blocked)
    row = Window.partitionBy(KEY, "iy").orderBy("ix")
    column = Window.partitionBy(KEY).orderBy("iy")

    def gaps(at: str, order, end: str) -> Column:
        """Ranges before each value, and the one after the last."""
        before = F.struct(
            (F.coalesce(F.lag(at).over(order), F.lit(-1)) + 1).alias("lo"), (F.col(at) - 1).alias("hi")
        )
        after = F.struct((F.col(at) + 1).alias("lo"), (F.col(end) - 1).alias("hi"))
        last = F.lead(at).over(order).isNull()
        return F.when(last, F.array(before, after)).otherwise(F.array(before))

    frames = bounds.select(KEY, "nx", "ny").filter("nx > 0 AND ny > 0")
    pieces = (
        blocked.join(frames, KEY).select(KEY, "iy", gaps("ix", row, "nx").alias("gaps"))
        .select(KEY, F.col("iy").alias("iy0"), F.col("iy").alias("iy1"), F.inline("gaps"))
        .select(KEY, "iy0", "iy1", F.col("lo").alias("x0"), F.col("hi").alias("x1"))
    )
    rows = frames.join(blocked.select(KEY, "iy").distinct(), KEY, "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("ny") - 1).alias("hi")))
    bands = (
        rows.withColumn("gaps", gaps("iy", column, "ny"))
        .withColumn("gaps", F.when(F.col("iy").isNull(), whole).otherwise(F.col("gaps")))
        .select(KEY, "nx", F.inline("gaps"))
        .select(
            KEY, F.col("lo").alias("iy0"), F.col("hi").alias("iy1"),
            F.lit(0).cast("long").alias("x0"), (F.col("nx") - 1).alias("x1"),
        )
    )
    return pieces.union(bands).filter("x0 <= x1 AND iy0 <= iy1")


def runs_of(cells: DataFrame) -> DataFrame:
    """Cells side by side in a row as runs ``iy0, iy1, x0, x1``."""
    row = Window.partitionBy(KEY, "iy").orderBy("ix")
    island = F.col("ix") - F.row_number().over(row)
    return (
        cells.select(KEY, "ix", "iy", island.alias("island"))
        .groupBy(KEY, "iy", "island")
        .agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"))
        .select(KEY, F.col("iy").alias("iy0"), F.col("iy").alias("iy1"), "x0", "x1")
    )


# --- percolation --------------------------------------------------------------------------


def run_clusters(runs: DataFrame, grid_size: float = 50.0) -> DataFrame:
    """4-connected clusters of rectangles: ``location_id, cluster, cells, area``.

    Rectangles that touch along a boundary between rows are linked by one ordered pass over the
    boundary: of two that overlap, the one that starts later starts inside the other, which is the
    last of its side to have started. So the links are as many as the overlaps.
    """
    node = F.col("iy0") * F.lit(4294967296) + F.col("x0")
    runs = cut(runs.withColumn("node", node))
    ends = runs.select(KEY, (F.col("iy1") + 1).alias("at"), "x0", "x1", "node", F.lit(0).alias("side")).union(
        runs.select(KEY, "iy0", "x0", "x1", "node", F.lit(1))
    )
    along = Window.partitionBy(KEY, "at").orderBy("x0", "side").rowsBetween(Window.unboundedPreceding, 0)

    def latest(side: int) -> Column:
        return F.last(F.when(F.col("side") == side, F.struct("x1", "node")), ignorenulls=True).over(along)

    met = ends.withColumns({"below": latest(0), "above": latest(1)})
    other = F.when(F.col("side") == 1, F.col("below")).otherwise(F.col("above"))
    links = (
        met.select(KEY, "node", "x0", other.alias("other"))
        .filter("other.x1 >= x0")
        .select(KEY, F.col("node").alias("src"), F.col("other.node").alias("dst"))
    )
    cells = (F.col("x1") - F.col("x0") + 1) * (F.col("iy1") - F.col("iy0") + 1)
    sizes = runs.select(KEY, "node", cells.alias("n"))
    return (
        connected_components(sizes, links)
        .join(sizes, [KEY, "node"])
        .groupBy(KEY, F.col("component").alias("cluster"))
        .agg(F.sum("n").alias("cells"))
        .withColumn("area", F.col("cells") * F.lit(grid_size**2))
    )


def percolation_clusters(cells: DataFrame, grid_size: float = 50.0) -> DataFrame:
    """4-connected clusters of the given cells: ``location_id, cluster, cells, area``."""
    return run_clusters(runs_of(cells), grid_size)
