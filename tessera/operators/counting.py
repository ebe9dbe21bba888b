"""Numbers of neighbours within a distance, counted by groups of boxes instead of by pairs.

Boxes are dealt into tiles a few distances wide, and the boxes that may reach a tile are copied to
it. Inside a tile both sides are cut into blocks of neighbours; the bounds of two blocks settle most
pairs of blocks at once, as wholly within the distance or wholly beyond it, and only the rest compares
boxes. Crowded tiles are dealt into shares, whose counts add up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "location_id"
BOX = ("x_min", "y_min", "x_max", "y_max")
TILE = ["_x", "_y"]
TILE_SIDE = 4  # in distances: few copies and few small groups
ASKING_ROWS = 16_384
COUNTED_ROWS = 131_072
BLOCK = 32
BLOCKS_AT_ONCE = 128  # pairs of blocks compared box by box in one step


def _snake(boxes: np.ndarray) -> np.ndarray:
    """An order that keeps neighbours together: strips by x, by y within a strip."""
    strips = max(1, int(np.sqrt(len(boxes) / BLOCK)))
    rank = np.empty(len(boxes), int)
    rank[np.argsort(boxes[:, 0], kind="stable")] = np.arange(len(boxes))
    return np.lexsort((boxes[:, 1], rank * strips // len(boxes)))


def _ends(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the blocks, and the least and the greatest of their four sides."""
    starts = np.arange(0, len(boxes), BLOCK)
    return starts, np.minimum.reduceat(boxes, starts), np.maximum.reduceat(boxes, starts)


def _gap(a_low: np.ndarray, a_high: np.ndarray, b_low: np.ndarray, b_high: np.ndarray) -> np.ndarray:
    """Gaps of boxes from their lower and upper corners (first axis: x, y), as ``functions.geometry.gap`` rounds them."""

    def along(k: int) -> np.ndarray:
        d = np.maximum(b_low[k] - a_high[k], a_low[k] - b_high[k])
        np.maximum(d, 0.0, out=d)
        return np.multiply(d, d, out=d)

    square = along(0)
    square += along(1)
    return np.sqrt(square, out=square)


def _open_blocks(a: np.ndarray, b: np.ndarray, distance: float):
    """Blocks of both sides, which pairs lie wholly within the distance, and which are undecided.

    Subtraction, squares and roots keep order when rounded, so a bound never contradicts a pair.
    """
    (a_at, a_low, a_high), (b_at, b_low, b_high) = _ends(a), _ends(b)
    a_low, a_high, b_low, b_high = a_low.T[:, :, None], a_high.T[:, :, None], b_low.T[:, None], b_high.T[:, None]
    near = _gap(a_low[:2], a_high[2:], b_low[:2], b_high[2:]) <= distance
    whole = _gap(a_high[:2], a_low[2:], b_high[:2], b_low[2:]) <= distance
    return a_at, b_at, whole, near & ~whole


def _blocked(values: np.ndarray, fill: float) -> np.ndarray:
    """Rows in blocks of equal length; the last is filled up."""
    short = -len(values) % BLOCK
    filled = np.concatenate([values, np.full((short, *values.shape[1:]), fill, values.dtype)])
    return filled.reshape(-1, BLOCK, *values.shape[1:])


def count_within(a: np.ndarray, b: np.ndarray, kind: np.ndarray, weight: np.ndarray, distance: float) -> np.ndarray:
    """For every box of ``a`` the weight of the boxes of ``b`` within the distance, by kind."""
    order, other = _snake(a), _snake(b)
    a, b = a[order], b[other]
    kinds = int(kind.max()) + 1
    table = np.zeros((len(b), kinds), np.int64)
    table[np.arange(len(b)), kind[other]] = weight[other]
    a_at, b_at, whole, rest = _open_blocks(a, b, distance)
    # Sums of whole numbers below 2**53 are exact in doubles, whose matrix product is fast.
    found = np.repeat(whole.astype(float) @ np.add.reduceat(table, b_at).astype(float), BLOCK, axis=0)
    found = found.astype(np.int64).reshape(len(a_at), BLOCK, kinds)
    counts = _blocked(table, 0).astype(float)
    mine, theirs = (_blocked(side, np.nan).transpose(2, 0, 1) for side in (a, b))
    i, j = np.nonzero(rest)
    for at in range(0, len(i), BLOCKS_AT_ONCE):
        p, q = i[at : at + BLOCKS_AT_ONCE], j[at : at + BLOCKS_AT_ONCE]
        s, t = mine[:, p][:, :, :, None], theirs[:, q][:, :, None]
        met = _gap(s[:2], s[2:], t[:2], t[2:]) <= distance
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])  # pairs stand in the order of i
        found[p[first]] += np.add.reduceat(met.astype(float) @ counts[q], first).astype(np.int64)
    out = np.empty((len(a), kinds), np.int64)
    out[order] = found.reshape(-1, kinds)[: len(a)]
    return out


def _counter(distance: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def count(asking: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or counted.empty:
            return asking[[KEY, *BOX]].head(0).assign(type=pd.Series(dtype=object), n=pd.Series(dtype="int64"))
        kind, names = pd.factorize(counted["type"], use_na_sentinel=False)
        boxes = asking[list(BOX)].to_numpy(float)
        found = count_within(boxes, counted[list(BOX)].to_numpy(float), kind, counted["n"].to_numpy(), distance)
        row, k = np.nonzero(found)
        out = asking[[KEY, *BOX]].iloc[row].reset_index(drop=True)
        labels = np.array([None if pd.isna(name) else name for name in names], object)
        return out.assign(type=labels[k], n=found[row, k])

    return count


def neighbour_counts(spots: DataFrame, kinds: DataFrame, distance: float) -> DataFrame:
    """``location_id, x_min, …, type, n``: boxes of each type within the distance of every spot.

    ``spots``: ``location_id`` and a box, no two alike; ``kinds``: the same with ``type`` and the
    number ``n`` of boxes a row stands for. Boxes of either are no wider than the distance.
    """
    size = F.lit(float(TILE_SIDE * distance))
    reach = distance * (1 + 1e-9)
    widest = spots.agg(F.max(F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")))).first()[0]

    def tile(value: Column) -> Column:
        return F.floor(value / size)

    def tiles(axis: str) -> Column:
        low, high = F.col(f"{axis}_min") - reach - (widest or 0.0) * (1 + 1e-9), F.col(f"{axis}_max") + reach
        return F.explode(F.sequence(tile(low), tile(high)))

    place = [KEY, *TILE]
    spots = spots.select(KEY, *BOX, tile(F.col("x_min")).alias("_x"), tile(F.col("y_min")).alias("_y"))
    kinds = kinds.select(KEY, *BOX, "type", "n").withColumn("_x", tiles("x")).withColumn("_y", tiles("y"))
    asked = spots.groupBy(*place).agg(F.ceil(F.count("*") / ASKING_ROWS).alias("_s"))
    met = kinds.join(asked, place)
    full = kinds.join(asked, place, "left_semi").groupBy(*place).agg(F.ceil(F.count("*") / COUNTED_ROWS).alias("_t"))

    def dealt(rows: DataFrame, shares: str) -> Column:
        return F.pmod(F.xxhash64(*rows.columns), F.col(shares))

    def each(shares: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(shares) - 1))

    shares = asked.join(full, place)
    asking = spots.join(shares, place).withColumn("_a", dealt(spots, "_s")).withColumn("_b", each("_t")).drop("_s", "_t")
    counted = met.join(full, place).withColumn("_b", dealt(kinds, "_t")).withColumn("_a", each("_s")).drop("_s", "_t")
    # Names of their own, as both sides may come from one table.
    asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])
    counted = counted.select(*[F.col(c).alias(c) for c in counted.columns])
    names = [*place, "_a", "_b"]
    schema = f"{KEY} {dict(spots.dtypes)[KEY]}, {', '.join(f'{c} double' for c in BOX)}, type string, n long"
    return asking.groupBy(*names).cogroup(counted.groupBy(*names)).applyInPandas(_counter(distance), schema)
