"""Range joins on planar coordinates, as equi-joins on grid cells.

A bare distance predicate is planned as a nested-loop join. Here both sides are assigned to square
cells and joined on ``(key, cell)``, so the work is shuffled by place. A pair can meet in several
cells; it is kept only in the lower-left cell the two share, so no ``distinct`` over pairs is
needed. Cells that hold very many rows are split: each side's rows are dealt into shares and the
shares are joined pairwise by different tasks. Pairs grow faster than rows, so the number of tasks follows
the pairs to be compared, not the bytes or files of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import gap

Box = Sequence[str]  # column names: x_min, y_min, x_max, y_max

HOT_CELL_ROWS = 16_384
MAX_LEVEL = 60
MAX_HOT_CELLS = 10_000
PAIRS_PER_TASK = 20_000_000
MAX_TASKS = 4_000


def _own_level(df: DataFrame, box: Box, reach: float, size: float, side: str) -> DataFrame:
    """The level whose cells are at least as large as the row's box, as ``_<side>m``."""
    x_min, y_min, x_max, y_max = (F.col(c) for c in box)
    width = F.greatest(x_max - x_min, y_max - y_min) + F.lit(2 * reach)
    level = F.when(width > size, F.ceil(F.log2(width / F.lit(size)))).otherwise(F.lit(0))
    return df.withColumn(f"_{side}m", F.least(level, F.lit(MAX_LEVEL)).cast("int"))


def _in_cells(
    df: DataFrame, box: Box, reach: float, size: float, side: str, others: Sequence[int]
) -> DataFrame:
    """A row for each cell of the row's own level and of the other side's higher ``others``."""
    x_min, y_min, x_max, y_max = (F.col(c) for c in box)
    own = F.col(f"_{side}m")
    higher = F.filter(F.array(*[F.lit(m) for m in others]), lambda m: m > own)
    df = df.withColumn("_m", F.explode(F.concat(F.array(own), higher)))
    edge = F.lit(size) * F.pow(F.lit(2.0), F.col("_m"))

    def index(value: Column) -> Column:
        return F.floor(value / edge)

    return (
        df.withColumn(f"_{side}x", index(x_min - reach))
        .withColumn(f"_{side}y", index(y_min - reach))
        .withColumn("_x", F.explode(F.sequence(F.col(f"_{side}x"), index(x_max + reach))))
        .withColumn("_y", F.explode(F.sequence(F.col(f"_{side}y"), index(y_max + reach))))
    )


def _levels(left: DataFrame, right: DataFrame) -> tuple[list[int], list[int], int]:
    """The levels of either side, and the rows of the larger side."""
    found = (
        left.select(F.lit(0).alias("side"), F.col("_lm").alias("m"))
        .union(right.select(F.lit(1), "_rm")).filter("m IS NOT NULL")
        .groupBy("side", "m").count().collect()
    )
    sides = [[(m, n) for side, m, n in found if side == k] for k in (0, 1)]
    lefts, rights = (sorted(m for m, _ in side) for side in sides)
    return lefts, rights, max(sum(n for _, n in side) for side in sides)


def _split_hot_cells(
    left: DataFrame, right: DataFrame, cell: list[str], hot_rows: int, pairs_per_task: int
) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Deal the rows of crowded cells into shares (other cells keep share 0), and the tasks that the pairs need."""
    counts = (
        left.select(*cell, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(*cell, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(*cell)
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    rows, busiest, pairs = counts.agg(
        F.sum(F.col("l") + F.col("r")), F.max(F.greatest("l", "r")), F.sum(F.col("l").cast("double") * F.col("r"))
    ).first()
    tasks = min(MAX_TASKS, int((pairs or 0) / pairs_per_task) + 1)
    # At most rows/limit cells can pass the limit, so the broadcast below is bounded.
    limit = max(hot_rows, int((rows or 0) / MAX_HOT_CELLS))
    if (busiest or 0) <= limit:
        return left, right, cell, tasks
    hot = F.broadcast(
        counts.filter(F.greatest("l", "r") > limit).select(
            *cell,
            F.ceil(F.col("l") / limit).alias("_ls"),
            F.ceil(F.col("r") / limit).alias("_rs"),
        )
    )

    def dealt(df: DataFrame, own: str, other: str, own_share: str, other_share: str) -> DataFrame:
        one = F.lit(1).cast("long")
        # Hashing whole rows (ids included) deals copies of one shape apart, and a retried task
        # deals them the same way.
        shares = df.withColumn("_h", F.xxhash64(*df.columns)).join(hot, cell, "left")
        return (
            shares.withColumn(
                own_share,
                F.pmod(F.col("_h"), F.greatest(F.coalesce(own, one), one)),
            )
            .withColumn(
                other_share,
                F.explode(
                    F.sequence(F.lit(0).cast("long"), F.greatest(F.coalesce(other, one), one) - 1)
                ),
            )
            .drop("_ls", "_rs", "_h")
        )

    return (
        dealt(left, "_ls", "_rs", "_a", "_b"),
        dealt(right, "_rs", "_ls", "_b", "_a"),
        [*cell, "_a", "_b"],
        tasks,
    )


def range_join(
    left: DataFrame,
    right: DataFrame,
    distance: float,
    left_box: Box,
    right_box: Box,
    key: str | None = "location_id",
    cell_size: float | None = None,
    condition: Column | None = None,
    hot_rows: int = HOT_CELL_ROWS,
    pairs_per_task: int | None = None,
) -> DataFrame:
    """All pairs whose bounding boxes are within ``distance``, with the gap as ``box_gap``.

    The left side is the one replicated to neighbouring cells; without a ``key`` there is one plane. ``condition`` is an extra pair
    predicate evaluated inside the join.
    """
    size = float(cell_size or distance)
    pairs_per_task = min(PAIRS_PER_TASK, pairs_per_task or PAIRS_PER_TASK)
    reach = distance * (1 + 1e-9)  # rounding must not lose a pair exactly at the distance
    cell = [*([key] if key else []), "_m", "_x", "_y"]
    lefts = _own_level(left, left_box, reach, size, "l")
    rights = _own_level(right, right_box, 0.0, size, "r")
    left_levels, right_levels, rows = _levels(lefts, rights)
    lefts = _in_cells(lefts, left_box, reach, size, "l", right_levels)
    rights = _in_cells(rights, right_box, 0.0, size, "r", left_levels)
    on = cell
    if rows > hot_rows or rows * rows > pairs_per_task:  # else no cell can hold that many, and one task does
        lefts, rights, on, tasks = _split_hot_cells(lefts, rights, cell, hot_rows, pairs_per_task)
        if tasks > 1:
            lefts, rights = lefts.repartition(tasks, *on), rights.repartition(tasks, *on).hint("merge")

    def along(low: int, high: int) -> Column:
        return F.greatest(
            F.lit(0.0),
            F.col(right_box[low]) - F.col(left_box[high]),
            F.col(left_box[low]) - F.col(right_box[high]),
        )

    box_gap = gap(along(0, 2), along(1, 3))
    first_shared_cell = (
        (F.col("_m") == F.greatest("_lm", "_rm"))
        & (F.col("_x") == F.greatest("_lx", "_rx"))
        & (F.col("_y") == F.greatest("_ly", "_ry"))
    )
    pairs = lefts.join(rights, on).filter(first_shared_cell & (box_gap <= distance))
    if condition is not None:
        pairs = pairs.filter(condition)
    return pairs.withColumn("box_gap", box_gap).drop(
        "_x", "_y", "_m", "_lx", "_ly", "_lm", "_rx", "_ry", "_rm", "_a", "_b"
    )
