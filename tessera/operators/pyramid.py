"""Nearest target at any distance, through a pyramid of occupied cells.

The finest level holds the targets' cells, every further level joins ``FAN`` by ``FAN`` cells of the
one below, up to a level with a handful of cells for each plane. A cell knows the box round all its
targets and the box of one of them: nothing in the cell is nearer than the first, and something is no
farther than the far corner of the second. A probe starts at the top with all cells, keeps those whose lower
bound does not exceed its least upper bound, and takes the children of those alone. So a
probe meets a few cells on each level (from afar, those of the facing edge at most), however many
targets lie behind one another, and only the targets of the cells left at the bottom are measured.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import gap
from tessera.lineage import cut

#: Cells of one level along a side of a cell of the next.
FAN = 4
CELL = "struct<cx:bigint,cy:bigint,x0:double,y0:double,x1:double,y1:double,rx0:double,ry0:double,rx1:double,ry1:double>"


def _lower(c: str) -> str:
    """Squared distance to the box round all targets of a cell."""
    dx = f"greatest(0D, {c}.x0 - px, px - {c}.x1)"
    dy = f"greatest(0D, {c}.y0 - py, py - {c}.y1)"
    return f"({dx} * {dx} + {dy} * {dy})"


def _upper(c: str) -> str:
    """Squared distance to the far corner of one target's box."""
    dx = f"greatest(abs(px - {c}.rx0), abs(px - {c}.rx1))"
    dy = f"greatest(abs(py - {c}.ry0), abs(py - {c}.ry1))"
    return f"({dx} * {dx} + {dy} * {dy})"


def _reached(squared: str) -> str:
    """Rounding must not lose a cell that is as near as the best."""
    return f"{squared} <= best * (1 + 1e-8D) + 1e-9D"


def _merged(cells: DataFrame, plane: str, fan: int) -> DataFrame:
    """Cells of the next level, each with its children."""
    up = cells.withColumns(
        {"ux": F.floor(F.col("cell.cx") / fan), "uy": F.floor(F.col("cell.cy") / fan)}
    )
    size = (F.col("cell.rx1") - F.col("cell.rx0")) + (F.col("cell.ry1") - F.col("cell.ry0"))
    one = F.min_by("cell", F.struct(size, "cell.cx", "cell.cy"))
    merged = up.groupBy(plane, "ux", "uy").agg(
        F.min("cell.x0").alias("x0"), F.min("cell.y0").alias("y0"),
        F.max("cell.x1").alias("x1"), F.max("cell.y1").alias("y1"),
        one.alias("one"), F.collect_list("cell").alias("kids"),
    )
    own = F.struct(
        F.col("ux").alias("cx"), F.col("uy").alias("cy"), "x0", "y0", "x1", "y1",
        "one.rx0", "one.ry0", "one.rx1", "one.ry1",
    )
    return merged.select(plane, own.alias("cell"), "kids")


def _levels(targets: DataFrame, box: Sequence[str], plane: str, size: float, width: float) -> list[DataFrame]:
    """From the finest to the coarsest level: ``plane, cell, kids``."""
    x0, y0, x1, y1 = box
    area = (F.col(x1) - F.col(x0)) + (F.col(y1) - F.col(y0))
    least = F.min_by(F.struct(*[F.col(c).alias(n) for c, n in zip(box, ("rx0", "ry0", "rx1", "ry1"))]), F.struct(area, *box))
    finest = targets.groupBy(plane, "cx", "cy").agg(
        F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"),
        least.alias("one"),
    )
    cells = cut(finest.select(plane, F.struct("cx", "cy", "x0", "y0", "x1", "y1", "one.*").alias("cell")))
    out = [cells]
    while width > size:
        size *= FAN
        out.append(_merged(out[-1].select(plane, "cell"), plane, FAN))
    return out


def candidates(
    probes: DataFrame, targets: DataFrame, probe_keys: Sequence[str], box: Sequence[str], size: float, plane: str
) -> DataFrame:
    """Every probe with the targets that may be its nearest, and ``box_gap``, the distance to their boxes."""
    for c in box:
        targets = targets.filter(F.col(c).isNotNull() & (F.abs(c) < float("inf")))
    for c in ("px", "py"):
        probes = probes.filter(F.col(c).isNotNull() & (F.abs(c) < float("inf")))
    x0, y0, x1, y1 = box

    def index(low: str, high: str) -> Column:
        return F.floor((F.col(low) + F.col(high)) / F.lit(2.0 * size))

    placed = targets.withColumns({"cx": index(x0, x1), "cy": index(y0, y1)})
    spread = (
        placed.groupBy(plane)
        .agg(F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("n"))
        .agg(F.max("n")).first()[0]
    )
    levels = _levels(placed, box, plane, size, size * ((spread or 0) + 1))
    keys = [plane, *probe_keys, "px", "py"]
    top = levels[-1].groupBy(plane).agg(F.collect_list("cell").alias("cells"))
    front = probes.select(*keys).join(top, plane)
    best = F.expr(f"array_min(transform(cells, c -> {_upper('c')}))")
    for k in range(len(levels) - 1, -1, -1):
        near = (
            front.withColumn("best", best)
            .select(*keys, "best", F.explode("cells").alias("c"))
            .filter(_reached(_lower("c")))
            .select(*keys, "best", "c.cx", "c.cy")
        )
        if not k:
            break
        kids = levels[k].select(plane, "cell.cx", "cell.cy", "kids")
        front = (
            near.join(kids, [plane, "cx", "cy"]).groupBy(*keys)
            .agg(F.flatten(F.collect_list("kids")).alias("cells"))
        )

    def along(p: str, low: str, high: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(low) - F.col(p), F.col(p) - F.col(high))

    box_gap = gap(along("px", x0, x1), along("py", y0, y1))
    met = near.join(placed, [plane, "cx", "cy"]).withColumn("box_gap", box_gap)
    return met.filter(_reached("box_gap * box_gap")).drop("best", "cx", "cy")


def nearest(
    probes: DataFrame,
    targets: DataFrame,
    probe_keys: Sequence[str],
    box: Sequence[str],
    distance: Column,
    answer: Column,
    size: float,
    plane: str,
) -> DataFrame:
    """``plane, *probe_keys, px, py, best``: the least ``answer`` over the nearest targets of each probe.

    ``distance`` is the exact distance of a joined row (which has ``box_gap``, the distance to the target's
    box), ``answer`` may use it as ``_d``. ``size`` is the side of the finest cells; it changes the work, not
    the result. Probes and targets without finite coordinates never meet; probes without a target on their
    plane have no row.
    """
    met = candidates(probes, targets, probe_keys, box, size, plane).withColumn("_d", distance)
    return met.groupBy(plane, *probe_keys, "px", "py").agg(F.min(answer).alias("best"))
