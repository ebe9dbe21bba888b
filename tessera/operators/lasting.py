"""A few links of a building graph that hold together what the whole graph holds, after every removal.

Buildings whose lower corners share a cell half as wide as the distance are all linked with one another.
What remains of such a cell hangs together through the member removed last, and what remains of two
cells hangs together once their longest-lived link is in: one link for each building and each pair of
cells stands for all pairs within the distance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import gap
from tessera.lineage import cut
from tessera.operators import graph as gp
from tessera.operators import proximity as px
from tessera.operators.networks import Network, building_id_node, building_nodes
from tessera.operators.range_join import range_join

KEY = "location_id"
BOX = ("x_min", "y_min", "x_max", "y_max")
SHARE_ROWS = 16_384
ROWS_AT_ONCE = 256


def longest_lived(a: np.ndarray, a_gone: np.ndarray, b: np.ndarray, b_gone: np.ndarray, distance: float):
    """Places of the pair within the distance whose first removal comes last, or None.

    Both sides come in falling order of removal; a row meets only rows of the other side removed after it.
    """
    order = np.argsort(-np.concatenate([a_gone, b_gone]), kind="stable")
    at, step = 0, 16
    while at < len(order):
        end = min(at + step, len(order))
        seen, fresh = order[:end], order[at:end]
        best = None
        for mine, theirs, flip in ((a, b, False), (b, a, True)):
            shift, other = (len(a), 0) if flip else (0, len(a))
            new = fresh[(fresh >= shift) & (fresh < shift + len(mine))] - shift
            old = seen[(seen >= other) & (seen < other + len(theirs))] - other
            s, t = mine[new][:, None], theirs[old][None]
            dx = np.maximum(0.0, np.maximum(t[..., 0] - s[..., 2], s[..., 0] - t[..., 2]))
            dy = np.maximum(0.0, np.maximum(t[..., 1] - s[..., 3], s[..., 1] - t[..., 3]))
            i, j = np.nonzero(np.sqrt(dx * dx + dy * dy) <= distance)
            if len(i):
                p, q = (old[j], new[i]) if flip else (new[i], old[j])
                until = np.minimum(a_gone[p], b_gone[q])
                k = int(until.argmax())
                if best is None or until[k] > best[0]:
                    best = (until[k], int(p[k]), int(q[k]))
        if best is not None:
            return best[1:]
        at, step = end, min(2 * step, ROWS_AT_ONCE)
    return None


def _linker(distance: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def link(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = (side.sort_values("gone", ascending=False) for side in (left, right))
        boxes = [side[list(BOX)].to_numpy(float) for side in (left, right)]
        found = longest_lived(boxes[0], left["gone"].to_numpy(), boxes[1], right["gone"].to_numpy(), distance)
        rows = [] if found is None else [(left[KEY].iloc[0], left["node"].iloc[found[0]], right["node"].iloc[found[1]])]
        return pd.DataFrame(rows, columns=[KEY, "src", "dst"])

    return link


def lasting_links(buildings: DataFrame, distance: float, order: DataFrame) -> DataFrame:
    """``location_id, src, dst``: links enough to tell the parts of the graph after each removal.

    ``order``: ``location_id, node, gone``, the place of each building in the removal.
    """
    shapes = px.footprints(buildings).select(KEY, building_id_node().alias("node"), *px.SHAPE)
    shapes = cut(shapes.join(order.select(KEY, "node", "gone"), [KEY, "node"]))
    size = F.lit(distance / 2.0)
    boxes = cut(
        shapes.filter("shape IS NULL AND x_min IS NOT NULL").select(
            KEY, "node", "gone", *BOX, F.floor(F.col("x_min") / size).alias("i"), F.floor(F.col("y_min") / size).alias("j")
        )
    )
    bounds = [(F.min if c.endswith("min") else F.max)(c).alias(c) for c in BOX]
    last = F.max(F.struct("gone", "node", *[F.col(c).alias("h" + c) for c in BOX])).alias("last")
    cells = cut(boxes.groupBy(KEY, "i", "j").agg(last, F.count("*").alias("n"), *bounds))
    inner = boxes.join(cells.select(KEY, "i", "j", F.col("last.node").alias("hub")), [KEY, "i", "j"])
    links = inner.filter("node <> hub").select(KEY, F.col("node").alias("src"), F.col("hub").alias("dst"))

    pairs = cut(
        range_join(
            px.renamed(cells, "a_"), px.renamed(cells, "b_"), distance, ["a_" + c for c in BOX], ["b_" + c for c in BOX],
            condition=F.struct("a_i", "a_j") < F.struct("b_i", "b_j"),
        )
    )

    def along(axis: str) -> Column:
        a, b = (F.col(f"{side}_last") for side in "ab")
        return F.greatest(F.lit(0.0), b[f"h{axis}_min"] - a[f"h{axis}_max"], a[f"h{axis}_min"] - b[f"h{axis}_max"])

    # Two last members within the distance are the longest-lived link there can be.
    settled = gap(along("x"), along("y")) <= distance
    links = links.unionByName(
        pairs.filter(settled).select(KEY, F.col("a_last.node").alias("src"), F.col("b_last.node").alias("dst"))
    )

    def members(side: str, other: str) -> DataFrame:
        shares, others = (F.ceil(F.col(f"{s}_n") / SHARE_ROWS) for s in (side, other))
        open_pairs = pairs.filter(~settled).select(
            KEY, "a_i", "a_j", "b_i", "b_j", shares.alias("shares"),
            F.explode(F.sequence(F.lit(1).cast("long"), others)).alias(f"share_{other}"),
        )
        rows = boxes.withColumnsRenamed({"i": f"{side}_i", "j": f"{side}_j"})
        dealt = open_pairs.join(rows, [KEY, f"{side}_i", f"{side}_j"]).withColumn(
            f"share_{side}", F.pmod(F.xxhash64("node"), F.col("shares")) + 1
        )
        return dealt.select(*[F.col(c).alias(c) for c in (*group, "node", "gone", *BOX)])

    group = [KEY, "a_i", "a_j", "b_i", "b_j", "share_a", "share_b"]
    schema = f"{KEY} {dict(boxes.dtypes)[KEY]}, src string, dst string"
    left, right = members("a", "b").groupBy(*group), members("b", "a").groupBy(*group)
    links = links.unionByName(left.cogroup(right).applyInPandas(_linker(distance), schema))

    odd = shapes.filter("shape IS NOT NULL")
    if not odd.isEmpty():
        met = range_join(
            px.renamed(odd, "a_"), px.renamed(shapes, "b_"), distance, ["a_" + c for c in BOX], ["b_" + c for c in BOX],
            condition=F.col("a_node") != F.col("b_node"),
        ).filter(px.shape_distance("a_", "b_") <= distance)
        links = links.unionByName(met.select(KEY, F.col("a_node").alias("src"), F.col("b_node").alias("dst")))
    return links


def building_robustness(buildings: DataFrame, distance: float, strategy: str = "random", seed: int = 42) -> DataFrame:
    """``graph.robustness`` of the graph of buildings within ``distance``, without its pairs.

    Strategies: degree, which is counted by blocks, or (seeded) random.
    """
    network = Network(building_nodes(buildings), None)
    if strategy == "degree":
        importance = px.neighbour_degrees(buildings, distance).select(
            KEY, building_id_node().alias("node"), F.col("degree").cast("double").alias("importance")
        )
    elif strategy == "random":
        importance = gp.removal_order(network, strategy, seed)
    else:
        raise ValueError(f"{strategy} needs the pairs: use graph.robustness")
    importance = cut(importance)
    links = lasting_links(buildings, distance, gp.removal_ranks(importance))
    return gp.robustness(network._replace(edges=cut(links)), importance)
