"""Geometry as column expressions over ``array<struct<x,y>>`` rings and paths.

Everything here stays in the JVM. Rings are closed (first vertex repeated last). Rectangles
aligned with the axes, the common simplified footprint, take cheap arithmetic shortcuts that are
exact; every other shape takes the general segment arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0
METRES_PER_DEGREE = 111000.0
POINT = "struct<x:double,y:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


# --- projection ---------------------------------------------------------------------------


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / F.lit(2.0)))


def longitude(x: Column) -> Column:
    return F.degrees(x / F.lit(EARTH_RADIUS_M))


def latitude(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(EARTH_RADIUS_M))) - F.lit(math.pi / 2))


def to_web_mercator(path: Column) -> Column:
    """EPSG:4326 vertices to EPSG:3857 metres."""
    return F.transform(path, lambda p: point(mercator_x(p.x), mercator_y(p.y)))


def from_web_mercator(path: Column) -> Column:
    return F.transform(path, lambda p: point(longitude(p.x), latitude(p.y)))


# --- measures -----------------------------------------------------------------------------


def segments(path: Column) -> Column:
    """Consecutive vertex pairs as ``array<struct<a,b>>``."""
    n = F.size(path) - 1
    return F.zip_with(
        F.slice(path, F.lit(1), F.greatest(n, F.lit(0))),
        F.slice(path, F.lit(2), F.greatest(n, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def rounded(value: Column, digits: int) -> Column:
    """``round(value, digits)``, with decimals only for values so large or so near a half that they matter.

    Elsewhere the nearest whole number of units over the units is the same double, without a decimal for each row.
    """
    units = F.lit(float(10**digits))
    scaled = value * units
    plain = (F.abs(scaled) < 1e11) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5) / units).otherwise(F.round(value, digits))


def gap(dx: Column, dy: Column) -> Column:
    """Euclidean length, written so that any engine rounds it the same way."""
    return F.sqrt(dx * dx + dy * dy)


def path_length(path: Column) -> Column:
    start = F.element_at(path, 1)
    walk = F.aggregate(
        path,
        F.struct(start.x.alias("x"), start.y.alias("y"), F.lit(0.0).alias("length")),
        lambda s, p: F.struct(
            p.x.alias("x"), p.y.alias("y"), (s.length + gap(p.x - s.x, p.y - s.y)).alias("length")
        ),
    )
    return walk.getField("length")


def ring_measure(ring: str) -> Column:
    """All measures of a ring in one pass: bounding box, centroid, area, ``is_box``.

    Coordinates are taken relative to the first vertex: large projected values would otherwise
    cancel digits away in the cross products. The centroid is area-weighted, or the vertex mean
    when the ring encloses no area. ``is_box``: the ring is exactly its own bounding box.

    One struct-valued expression on purpose. Spread over several columns that refer to one
    another, the optimizer's constraint inference on later joins grows exponentially.
    """

    def centre(axis: str) -> str:
        return f"""CASE WHEN r.is_box THEN (r.m.{axis}_min + r.m.{axis}_max) / 2D
            WHEN r.m.twice <> 0 THEN r.m.o{axis} + r.m.m{axis} / (3D * r.m.twice)
            ELSE r.m.o{axis} + r.m.s{axis} / greatest(r.m.n - 1, 1) END AS c{axis}"""

    start = f"{ring}[0]"
    cross = "(s.dx * (p.y - s.oy) - (p.x - s.ox) * s.dy)"
    full = "(m.x_max - m.x_min) * (m.y_max - m.y_min)"
    return F.expr(f"""
      aggregate({ring},
        named_struct('ox', {start}.x, 'oy', {start}.y, 'dx', 0D, 'dy', 0D, 'twice', 0D,
          'mx', 0D, 'my', 0D, 'sx', 0D, 'sy', 0D, 'square', true, 'n', 0,
          'x_min', {start}.x, 'y_min', {start}.y, 'x_max', {start}.x, 'y_max', {start}.y),
        (s, p) -> named_struct('ox', s.ox, 'oy', s.oy, 'dx', p.x - s.ox, 'dy', p.y - s.oy,
          'twice', s.twice + {cross},
          'mx', s.mx + {cross} * (s.dx + (p.x - s.ox)),
          'my', s.my + {cross} * (s.dy + (p.y - s.oy)),
          'sx', s.sx + (p.x - s.ox), 'sy', s.sy + (p.y - s.oy),
          'square', s.square AND (p.x - s.ox = s.dx OR p.y - s.oy = s.dy), 'n', s.n + 1,
          'x_min', least(s.x_min, p.x), 'y_min', least(s.y_min, p.y),
          'x_max', greatest(s.x_max, p.x), 'y_max', greatest(s.y_max, p.y)),
        m -> transform(
          array(named_struct('m', m, 'is_box', m.n = 5 AND m.square AND {full} > 0
            AND abs(abs(m.twice) / 2D - {full}) <= 1e-9D * {full})),
          r -> struct(r.m.x_min, r.m.y_min, r.m.x_max, r.m.y_max, {centre("x")}, {centre("y")},
            r.is_box, abs(r.m.twice) / 2D AS ring_area))[0])
    """)


def ring_area(ring: str) -> Column:
    return ring_measure(ring).getField("ring_area")


def xs(path: Column) -> Column:
    return F.transform(path, lambda p: p.x)


def ys(path: Column) -> Column:
    return F.transform(path, lambda p: p.y)


def bounding_box(path: Column) -> Column:
    return F.struct(
        F.array_min(xs(path)).alias("x_min"),
        F.array_min(ys(path)).alias("y_min"),
        F.array_max(xs(path)).alias("x_max"),
        F.array_max(ys(path)).alias("y_max"),
    )


MEASURES = ["x_min", "y_min", "x_max", "y_max", "cx", "cy", "is_box", "ring_area"]


def measure_rings(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Add the measures of a ring column as columns.

    A table that already carries them, measured once at ingest, is returned as it is.
    """
    if set(MEASURES) <= set(df.columns):
        return df
    kept = [c for c in df.columns if c not in MEASURES]
    return df.withColumn("_m", ring_measure(ring)).select(
        *kept, *[F.col(f"_m.{c}").alias(c) for c in MEASURES]
    )


# --- distances and predicates -------------------------------------------------------------


# These build SQL text: the parser makes the large nested expressions far faster than one call
# per operator would. Arguments are SQL expressions for a ring/path or a coordinate.


def _edges(path: str) -> str:
    """Edges with direction and squared length, computed once per ring."""
    n = f"greatest(size({path}) - 1, 0)"
    return f"""zip_with(slice({path}, 1, {n}), slice({path}, 2, {n}), (a, b) -> named_struct(
      'ax', a.x, 'ay', a.y, 'bx', b.x, 'by', b.y, 'ux', b.x - a.x, 'uy', b.y - a.y,
      'l2', (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))"""


def _to_edge(x: str, y: str, e: str) -> str:
    """Squared distance from a point to an edge."""
    t = f"""CASE WHEN {e}.l2 > 0 THEN least(1D, greatest(0D,
      (({x} - {e}.ax) * {e}.ux + ({y} - {e}.ay) * {e}.uy) / {e}.l2)) ELSE 0D END"""
    dx, dy = f"({x} - {e}.ax - ({t}) * {e}.ux)", f"({y} - {e}.ay - ({t}) * {e}.uy)"
    return f"({dx} * {dx} + {dy} * {dy})"


def _side(e: str, x: str, y: str) -> str:
    return f"signum({e}.ux * ({y} - {e}.ay) - {e}.uy * ({x} - {e}.ax))"


def _between_edges(s: str, t: str) -> str:
    """Squared distance of two edges, 0 when they cross."""
    crossing = (
        f"{_side(s, f'{t}.ax', f'{t}.ay')} * {_side(s, f'{t}.bx', f'{t}.by')} < 0 AND "
        f"{_side(t, f'{s}.ax', f'{s}.ay')} * {_side(t, f'{s}.bx', f'{s}.by')} < 0"
    )
    ends = ", ".join(
        _to_edge(f"{e}.{end}x", f"{e}.{end}y", o) for e, o in ((s, t), (t, s)) for end in "ab"
    )
    return f"CASE WHEN {crossing} THEN 0D ELSE least({ends}) END"


def inside_ring(x: str, y: str, ring: str) -> str:
    """Even-odd rule; the rim itself is left to the distance tests."""
    return f"""size(filter({_edges(ring)}, e -> (e.ay > {y}) <> (e.by > {y})
      AND {x} < e.ux * ({y} - e.ay) / e.uy + e.ax)) % 2 = 1"""


def point_ring_distance(x: str, y: str, ring: str) -> Column:
    nearest = f"sqrt(array_min(transform({_edges(ring)}, e -> {_to_edge(x, y, 'e')})))"
    return F.expr(f"CASE WHEN {inside_ring(x, y, ring)} THEN 0D ELSE {nearest} END")


def ring_distance(a: str, b: str) -> Column:
    """Polygon-to-polygon distance: 0 when they touch, cross or contain one another."""
    nested = (
        f"{inside_ring(f'{a}[0].x', f'{a}[0].y', b)} OR {inside_ring(f'{b}[0].x', f'{b}[0].y', a)}"
    )
    pairwise = f"""transform({_edges(a)}, s ->
      array_min(transform({_edges(b)}, t -> {_between_edges('s', 't')})))"""
    return F.expr(f"CASE WHEN {nested} THEN 0D ELSE sqrt(array_min({pairwise})) END")


def path_meets_box(path: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """Whether some closed edge meets the closed rectangle, by separating axes."""
    corners = ", ".join(_side("e", x, y) for x in (x0, x1) for y in (y0, y1))
    return f"""exists({_edges(path)}, e ->
      least(e.ax, e.bx) <= {x1} AND greatest(e.ax, e.bx) >= {x0}
      AND least(e.ay, e.by) <= {y1} AND greatest(e.ay, e.by) >= {y0}
      AND array_min(array({corners})) <= 0 AND array_max(array({corners})) >= 0)"""


def ring_meets_box(ring: str, x0: str, y0: str, x1: str, y1: str) -> str:
    return f"({path_meets_box(ring, x0, y0, x1, y1)} OR {inside_ring(x0, y0, ring)})"


# --- study windows and tiles --------------------------------------------------------------


def location_bounds(
    lat: Column, lon: Column, radius_m: Column, clamped: bool = True
) -> dict[str, Column]:
    """Window of ``radius_m`` metres round a point, in degrees."""
    cosine = F.cos(F.radians(lat))
    if clamped:
        cosine = F.greatest(cosine, F.lit(1e-6))
    dlat = radius_m / F.lit(METRES_PER_DEGREE)
    dlon = radius_m / (F.lit(METRES_PER_DEGREE) * cosine)
    west, south, east, north = lon - dlon, lat - dlat, lon + dlon, lat + dlat
    if clamped:
        west, east = F.greatest(F.lit(-180.0), west), F.least(F.lit(180.0), east)
        south, north = F.greatest(F.lit(-90.0), south), F.least(F.lit(90.0), north)
    return {"west": west, "south": south, "east": east, "north": north}


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(2**zoom)))


def tile_y(lat: Column, zoom: int) -> Column:
    height = F.asinh(F.tan(F.radians(lat)))
    return F.floor((F.lit(1.0) - height / F.lit(math.pi)) / F.lit(2.0) * F.lit(float(2**zoom)))


def tile_lon(x: Column, zoom: int) -> Column:
    return x / F.lit(float(2**zoom)) * F.lit(360.0) - F.lit(180.0)


def tile_lat(y: Column, zoom: int) -> Column:
    fraction = F.lit(1.0) - F.lit(2.0) * y / F.lit(float(2**zoom))
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * fraction)))


# Fixed value: ground resolution of zoom level 0 at the equator, metres per pixel.
ZOOM0_METRES_PER_PIXEL = 156543.03392


def zoom_for_resolution(lat: Column, metres_per_pixel: Column) -> Column:
    level = F.log2(
        F.lit(ZOOM0_METRES_PER_PIXEL) * F.cos(F.radians(lat)) / metres_per_pixel
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(18.0), level)).cast("int")


def zoom_for_radius(lat: Column, radius_m: Column, pixels: float = 256.0) -> Column:
    return zoom_for_resolution(
        lat, F.greatest(radius_m * F.lit(2.0) / F.lit(pixels), F.lit(1.0))
    )


def zoom_for_extent(
    lat: Column, width_m: Column, height_m: Column, width_px: float, height_px: float
) -> Column:
    return zoom_for_resolution(
        lat, F.greatest(width_m / F.lit(width_px), height_m / F.lit(height_px), F.lit(1.0))
    )
