"""Connected components by repeated contraction, for all locations at once.

Each round every node hooks onto its neighbour of smallest hash, pointer jumping turns the hooks
into stars, and the edges are rewritten between star centres. The edge table shrinks
geometrically; hashing the hooking order keeps the chains short on grids and long streets. Once
few enough edges are left (a checked count), each location's remainder is labelled inside a task
instead of paying for more rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut

KEY = "location_id"
FINISH_EDGES = 1_000_000


def _priority(name: str):
    return F.struct(F.xxhash64(F.col(name)).alias("h"), F.col(name).alias("n"))


def _jump(parents: DataFrame) -> DataFrame:
    above = parents.select(KEY, F.col("u").alias("parent"), F.col("parent").alias("grand"))
    return parents.join(above, [KEY, "parent"]).select(
        KEY, "u", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")
    )


def _stars(edges: DataFrame) -> DataFrame:
    hooks = (
        edges.groupBy(KEY, "u")
        .agg(F.min(_priority("v")).alias("best"))
        .select(
            KEY,
            "u",
            F.when(F.col("best") < _priority("u"), F.col("best.n"))
            .otherwise(F.col("u"))
            .alias("parent"),
        )
    )
    parents = cut(hooks)
    while True:
        parents = cut(_jump(_jump(_jump(parents).drop("moved")).drop("moved")))
        if parents.filter("moved").isEmpty():
            return parents.drop("moved")
        parents = parents.drop("moved")


def _label_remainder(part: pd.DataFrame) -> pd.DataFrame:
    """Star centres for the edges of one location: hook roots, then halve the paths."""
    codes, names = pd.factorize(pd.concat([part["u"], part["v"]], ignore_index=True))
    u, v = codes[: len(part)], codes[len(part) :]
    root = np.arange(len(names))
    while True:
        before = root.copy()
        np.minimum.at(root, root[u], root[v])
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    out = pd.DataFrame({"u": names, "parent": names[root]})
    out.insert(0, KEY, part[KEY].iloc[0])
    return out


def component_labels(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """``(location_id, u, component)`` for every node that has an edge."""
    src, dst = F.col("src"), F.col("dst")
    # Both directions from one pass: a union would work out the edges twice.
    ways = F.array(F.struct(src.alias("u"), dst.alias("v")), F.struct(dst.alias("u"), src.alias("v")))
    current = cut(edges.filter(src != dst).select(KEY, F.explode(ways).alias("way")).select(KEY, "way.*"))
    kind = dict(current.dtypes)["u"]
    labels = None
    while remaining := current.count():
        finish = remaining <= finish_edges
        if finish:
            stars = current.groupBy(KEY).applyInPandas(
                _label_remainder, f"{KEY} long, u {kind}, parent {kind}"
            )
        else:
            stars = _stars(current)
        if labels is None:
            labels = stars
        else:
            step = stars.select(KEY, F.col("u").alias("parent"), F.col("parent").alias("next"))
            labels = labels.join(step, [KEY, "parent"], "left").select(
                KEY, "u", F.coalesce("next", "parent").alias("parent")
            )
        if finish:
            break
        left = stars.select(KEY, "u", F.col("parent").alias("pu"))
        right = stars.select(KEY, F.col("u").alias("v"), F.col("parent").alias("pv"))
        current = cut(
            current.join(left, [KEY, "u"])
            .join(right, [KEY, "v"])
            .filter("pu <> pv")
            .select(KEY, F.col("pu").alias("u"), F.col("pv").alias("v"))
            .distinct()
        )
    if labels is None:
        empty = current.select(KEY, "u", F.col("u").alias("component"))
        return empty
    labels = cut(labels)
    smallest = labels.groupBy(KEY, "parent").agg(F.min("u").alias("component"))
    return labels.join(smallest, [KEY, "parent"]).select(KEY, "u", "component")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(location_id, node, component)``; the component is named by its smallest node."""
    labels = component_labels(edges).withColumnRenamed("u", "node")
    return (
        nodes.select(KEY, "node")
        .join(labels, [KEY, "node"], "left")
        .select(KEY, "node", F.coalesce("component", "node").alias("component"))
    )


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy(KEY, "component").agg(F.count(F.lit(1)).alias("size"))
