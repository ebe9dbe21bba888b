"""Distance joins between buildings, points and network nodes, per location.

All of them go through ``range_join``. Copies of one footprint are collapsed before any join whose
answer depends only on the shape, so a group of copies costs one row there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.lineage import cut
from tessera.operators.counting import neighbour_counts
from tessera.operators.pyramid import nearest
from tessera.operators.range_join import range_join

KEY = "location_id"
BOX = ("x_min", "y_min", "x_max", "y_max")
SHAPE = [*BOX, "shape"]
PAIR_CELL = 2.25  # in distances: a small box and its reach meet four cells, with few strangers in them
# Where a task sorts its pairs, it holds few enough to do so in memory.
PACKED = {"hot_rows": 4_096, "pairs_per_task": 4_000_000}


def footprints(buildings: DataFrame) -> DataFrame:
    """Buildings with bounding box, centroid and ``shape``: the ring, or null for plain boxes."""
    measured = g.measure_rings(buildings)
    return measured.select(
        KEY,
        "building_id",
        "type",
        F.coalesce("area_m2", "ring_area").alias("area_m2"),
        *BOX,
        "cx",
        "cy",
        F.when(~F.col("is_box"), F.col("ring")).alias("shape"),
    )


def renamed(df: DataFrame, prefix: str, keep: Sequence[str] = (KEY,)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def _ring(prefix: str) -> str:
    x0, y0, x1, y1 = (prefix + c for c in BOX)
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    ring = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in corners)
    return f"coalesce({prefix}shape, array({ring}))"


def shape_distance(left: str, right: str) -> Column:
    """Polygon distance of a joined pair; for two boxes it is the box gap."""
    boxes = F.col(left + "shape").isNull() & F.col(right + "shape").isNull()
    return F.when(boxes, F.col("box_gap")).otherwise(g.ring_distance(_ring(left), _ring(right)))


def point_shape_distance(x: str, y: str, right: str) -> Column:
    exact = g.point_ring_distance(x, y, right + "shape")
    return F.when(F.col(right + "shape").isNull(), F.col("box_gap")).otherwise(exact)


def _box(prefix: str) -> list[str]:
    return [prefix + c for c in BOX]


def building_proximity(
    buildings: DataFrame, distance: float, weight_method: str = "distance"
) -> DataFrame:
    """Unordered building pairs within ``distance``; the weight is the distance, or 1."""
    pairs = near_pairs(buildings, distance, F.col("building_id"), packed=True)
    weight = F.col("distance") if weight_method == "distance" else F.lit(1.0)
    return pairs.select(
        KEY, F.col("first").alias("building_a"), F.col("second").alias("building_b"), "distance", weight.alias("weight")
    )


def near_pairs(buildings: DataFrame, distance: float, name: Column, packed: bool = False) -> DataFrame:
    """``location_id, first, second, distance``: unordered building pairs within ``distance``, by ``name``.

    ``first`` is the smaller of the two names. ``packed``: the pairs of a task come by their distance, so what is
    written of them is small: equal distances stand together, which else fill most of a file of pairs. Two boxes are as far apart as their bounds, so their pairs carry
    nothing but names and bounds; only pairs with a ring of another shape measure rings.
    """
    shapes = cut(footprints(buildings).select(KEY, name.alias("name"), *SHAPE))
    plain = shapes.filter(F.col("shape").isNull()).drop("shape")
    out = [KEY, F.col("a_name").alias("first"), F.col("b_name").alias("second")]
    found = range_join(
        renamed(plain, "a_"), renamed(plain, "b_"), distance, _box("a_"), _box("b_"),
        cell_size=PAIR_CELL * distance, condition=F.col("a_name") < F.col("b_name"), **(PACKED if packed else {}),
    ).select(*out, F.col("box_gap").alias("distance"))
    if packed:
        found = found.sortWithinPartitions("distance")
    odd = shapes.filter(F.col("shape").isNotNull())
    if odd.isEmpty():
        return found
    once = (F.col("a_name") < F.col("b_name")) | (F.col("b_shape").isNull() & (F.col("a_name") > F.col("b_name")))
    rings = range_join(renamed(odd, "a_"), renamed(shapes, "b_"), distance, _box("a_"), _box("b_"), condition=once)
    rings = rings.withColumn("distance", shape_distance("a_", "b_")).filter(F.col("distance") <= distance)
    first, second = (f("a_name", "b_name").alias(side) for f, side in ((F.least, "first"), (F.greatest, "second")))
    return found.unionByName(rings.select(KEY, first, second, "distance"))


def nearest_node(
    points: DataFrame,
    nodes: DataFrame,
    distance: float,
    point_xy: tuple[str, str],
) -> DataFrame:
    """For every distinct point the nearest node within ``distance``; ties go to the first node.

    ``points``: ``location_id`` and the coordinates; ``nodes``: ``location_id, node, node_order,
    x, y``. Points stay in their own cell and nodes are replicated, so the minimum is taken
    before the shuffle. Of nodes at one place only the first can win, so one row stands for them.
    """
    px, py = point_xy
    spots = cut(points.select(KEY, px, py).distinct())
    first = F.min(F.struct("node_order", "node")).alias("first")
    targets = cut(nodes.groupBy(KEY, "x", "y").agg(first).select(KEY, "first.*", "x", "y"))
    pairs = range_join(targets, spots, distance, ("x", "y", "x", "y"), (px, py, px, py))
    best = F.min(F.struct(F.col("box_gap").alias("d"), "node_order", "node")).alias("best")
    return pairs.groupBy(KEY, px, py).agg(best).select(
        KEY, px, py, F.col("best.node").alias("node"), F.col("best.d").alias("distance")
    )


def points_within(
    points: DataFrame, nodes: DataFrame, distance: float, point_xy: tuple[str, str]
) -> DataFrame:
    """Every point-node pair within ``distance``, with the distance."""
    px, py = point_xy
    nodes, points = cut(nodes), cut(points)
    return range_join(
        nodes, points, distance, ("x", "y", "x", "y"), (px, py, px, py), cell_size=PAIR_CELL * distance
    ).withColumnRenamed("box_gap", "distance")


def connect_nearest(
    buildings: DataFrame, nodes: DataFrame, distance: float = 100.0
) -> DataFrame:
    """``location_id, building_id, node, distance``: building centroid to nearest node."""
    centres = cut(footprints(buildings).select(KEY, "building_id", "cx", "cy"))
    found = nearest_node(centres, nodes, distance, ("cx", "cy"))
    return centres.join(found, [KEY, "cx", "cy"]).select(KEY, "building_id", "node", "distance")


def connect_all(buildings: DataFrame, nodes: DataFrame, distance: float = 50.0) -> DataFrame:
    """Every building-centroid to node pair within ``distance``."""
    centres = footprints(buildings).select(KEY, "building_id", "cx", "cy")
    targets = nodes.select(KEY, "node", "x", "y")
    return points_within(centres, targets, distance, ("cx", "cy")).select(
        KEY, "building_id", "node", "distance"
    )


def nearest_targets(
    probes: DataFrame,
    targets: DataFrame,
    probe_keys: Sequence[str],
    target_id: str,
    size: float,
    plane: str = KEY,
) -> DataFrame:
    """Nearest target point of every probe point, however far; ties go to the smaller id.

    ``size`` is the side of the finest cells of the search.
    """
    answer = F.struct(F.col("_d").alias("d"), F.col(target_id).alias("id"))
    best = nearest(
        probes, targets, probe_keys, ("tx", "ty", "tx", "ty"), F.col("box_gap"), answer, size, plane
    )
    return best.select(
        plane, *probe_keys, F.col("best.id").alias(target_id), F.col("best.d").alias("distance")
    )


def open_points(
    buildings: DataFrame, spacing: float = 100.0, clearance: float = 50.0
) -> DataFrame:
    """Lattice points at least ``clearance`` from every building, with that distance."""
    shapes = cut(footprints(buildings).select(KEY, *SHAPE).distinct())
    frame = shapes.groupBy(KEY).agg(
        *[(F.min if c.endswith("min") else F.max)(c).alias("e_" + c) for c in BOX]
    )

    def steps(axis: str) -> Column:
        count = F.ceil((F.col(f"e_{axis}_max") - F.col(f"e_{axis}_min")) / F.lit(spacing))
        # arange is empty on a zero range
        return F.explode(F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: i < count))

    lattice = (
        frame.withColumn("ix", steps("x"))
        .withColumn("iy", steps("y"))
        .select(
            KEY,
            "ix",
            "iy",
            (F.col("e_x_min") + F.col("ix") * F.lit(spacing)).alias("px"),
            (F.col("e_y_min") + F.col("iy") * F.lit(spacing)).alias("py"),
        )
    )
    found = nearest(
        lattice,
        renamed(shapes, "t_"),
        ["ix", "iy"],
        _box("t_"),
        point_shape_distance("px", "py", "t_"),
        F.col("_d"),
        max(spacing, clearance) / 4,
        KEY,
    )
    return found.filter(F.col("best") >= clearance).select(
        KEY, "ix", "iy", "px", "py", F.col("best").alias("min_distance")
    )


def building_density(
    points: DataFrame, buildings: DataFrame, radius: float = 200.0, method: str = "gaussian"
) -> DataFrame:
    """Built area per square metre of the disc round each point (``px, py``)."""
    shapes = cut(
        footprints(buildings).groupBy(KEY, *SHAPE, "cx", "cy").agg(F.sum("area_m2").alias("area"))
    )
    points = cut(points)
    near = range_join(
        renamed(shapes, "b_"), points.select(KEY, "px", "py").distinct(), radius, _box("b_"),
        ("px", "py", "px", "py"),
    ).filter(point_shape_distance("px", "py", "b_") <= radius)
    weight = F.lit(1.0)
    if method == "gaussian":
        dx, dy = F.col("px") - F.col("b_cx"), F.col("py") - F.col("b_cy")
        weight = F.exp(-(dx * dx + dy * dy) / F.lit(2.0 * (radius / 3.0) ** 2))
    density = F.sum(F.coalesce("b_area", F.lit(0.0)) * weight) / F.lit(math.pi * radius**2)
    sums = near.groupBy(KEY, "px", "py").agg(density.alias("density"))
    return points.join(sums, [KEY, "px", "py"], "left").withColumn(
        "density", F.coalesce("density", F.lit(0.0))
    )


def neighbour_types(buildings: DataFrame, distance: float = 100.0) -> DataFrame:
    """``location_id, shape columns, type, n``: types within ``distance``, the building included.

    Boxes no wider than the distance are counted by blocks; pairs with a ring of another shape or a wider
    box on either side are joined.
    """
    kinds = cut(footprints(buildings).groupBy(KEY, *SHAPE, "type").agg(F.count("*").alias("n")))
    side = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    plain = F.col("shape").isNull() & F.coalesce(side <= distance, F.lit(False))
    spots = kinds.select(KEY, *SHAPE).distinct()
    boxes = neighbour_counts(spots.filter(plain), kinds.filter(plain), distance)
    found = boxes.withColumn("shape", F.lit(None).cast(kinds.schema["shape"].dataType))
    odd = kinds.filter(~plain)
    if not odd.isEmpty():
        for near, around in ((odd, spots), (kinds.filter(plain), spots.filter(~plain))):
            pairs = range_join(renamed(near, "n_"), renamed(around, "s_"), distance, _box("n_"), _box("s_"))
            met = pairs.filter(shape_distance("n_", "s_") <= distance)
            found = found.unionByName(
                met.select(KEY, *[F.col("s_" + c).alias(c) for c in SHAPE], F.col("n_type").alias("type"), F.col("n_n").alias("n"))
            )
    return found.groupBy(KEY, *SHAPE, "type").agg(F.sum("n").alias("n"))


def neighbour_degrees(buildings: DataFrame, distance: float) -> DataFrame:
    """``location_id, building_id, degree``: other buildings within ``distance``, counted without the pairs."""
    around = renamed(neighbour_types(buildings, distance), "n_", keep=())
    counts = around.groupBy(*["n_" + c for c in (KEY, *SHAPE)]).agg(F.sum("n_n").alias("n_all"))
    own = footprints(buildings).select(KEY, "building_id", *SHAPE)
    same = [F.col(c) == F.col("n_" + c) for c in (KEY, *BOX)] + [F.col("shape").eqNullSafe(F.col("n_shape"))]
    return own.join(counts, same, "left").select(KEY, "building_id", F.coalesce(F.col("n_all") - 1, F.lit(0)).alias("degree"))
