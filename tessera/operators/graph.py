"""Graph analytics on node and edge tables, for all locations at once.

Shortest paths of components up to ``SMALL_COMPONENT`` nodes are solved inside tasks on dense arrays,
split into slices of source nodes so no task owns more than a bounded piece; those with very many links first
lose the links that are no shortest path between their own ends. Larger components take the join-based routes
below; all give the same numbers. Fiedler values of components up to ``SMALL_EDGES`` edges
are solved in a task, those of larger ones by joins and grouped sums over all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.operators.components import component_sizes, connected_components
from tessera.operators.networks import density, degrees

KEY = "location_id"
SMALL_COMPONENT = 4096
CROWDED_NODES = 256
CROWDED_LINKS = 16  # links for each node, above which a small component is first reduced by tables of its nodes
SMALL_EDGES = 500_000
SOURCES_PER_SLICE = 128
PAIRS_PER_BATCH = 20_000_000_000
TIE = 1e-12  # relative tolerance for equally short paths


def both_ways(edges: DataFrame) -> DataFrame:
    """``location_id, u, v, w`` in both directions."""
    forward = edges.select(
        KEY, F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").alias("w")
    )
    return forward.unionByName(
        forward.select(KEY, F.col("v").alias("u"), F.col("u").alias("v"), "w")
    )


def graph_density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    m = edges.groupBy(KEY).agg(F.count("*").alias("num_edges"))
    n = nodes.groupBy(KEY).agg(F.count("*").alias("num_nodes"))
    return (
        n.join(m, KEY, "left")
        .fillna(0, ["num_edges"])
        .withColumn("density", density(F.col("num_nodes"), F.col("num_edges")))
    )


def degree_centrality(network) -> DataFrame:
    """Degree over n − 1 per node; 1 for a lone node."""
    n = network.nodes.groupBy(KEY).agg(F.count("*").alias("n"))
    value = F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.lit(1.0))
    return degrees(network).join(n, KEY).select(KEY, "node", value.alias("degree_centrality"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Local clustering coefficient per node.

    Edges point from lower to higher (degree, name), which bounds the fan-out of every node by
    the square root of the edge count; each triangle is then found once.
    """
    sym = both_ways(edges.filter("src <> dst"))
    degree = sym.groupBy(KEY, "u").agg(F.count("*").alias("d"))
    ranked = (
        edges.filter("src <> dst")
        .select(KEY, "src", "dst")
        .join(degree.select(KEY, F.col("u").alias("src"), F.col("d").alias("ds")), [KEY, "src"])
        .join(degree.select(KEY, F.col("u").alias("dst"), F.col("d").alias("dd")), [KEY, "dst"])
    )
    low, high = F.struct("ds", "src"), F.struct("dd", "dst")
    up = cut(
        ranked.select(
            KEY,
            F.when(low < high, F.col("src")).otherwise(F.col("dst")).alias("a"),
            F.when(low < high, F.col("dst")).otherwise(F.col("src")).alias("b"),
        )
    )
    wedges = up.join(up.withColumnRenamed("b", "c"), [KEY, "a"]).filter("b < c")
    closing = up.select(
        KEY, F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c")
    )
    corners = wedges.join(closing, [KEY, "b", "c"]).select(
        KEY, F.explode(F.array("a", "b", "c")).alias("node")
    )
    triangles = corners.groupBy(KEY, "node").agg(F.count("*").alias("t"))
    value = F.lit(2.0) * F.col("t") / (F.col("d") * (F.col("d") - 1))
    return (
        nodes.select(KEY, "node")
        .join(triangles, [KEY, "node"], "left")
        .join(degree.withColumnRenamed("u", "node"), [KEY, "node"], "left")
        .select(KEY, "node", F.coalesce(F.when(F.col("d") > 1, value), F.lit(0.0)).alias("clustering"))
    )


# --- shortest paths -----------------------------------------------------------------------

PATH_SCHEMA = (
    "location_id long, node string, reach long, dist_sum double, hop_sum double, hop_max double, "
    "dependency double"
)


def _relax(sources: np.ndarray, n: int, u, v, w, starts) -> np.ndarray:
    """Distances sources × nodes; edges are sorted by target, ``starts`` marks each target."""
    dist = np.full((len(sources), n), np.inf)
    dist[np.arange(len(sources)), sources] = 0.0
    targets = v[starts]
    while True:
        best = np.minimum.reduceat(dist[:, u] + w, starts, axis=1)
        better = best < dist[:, targets]
        if not better.any():
            return dist
        dist[:, targets] = np.where(better, best, dist[:, targets])


def _links_of(front: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links that start at the nodes of ``front``, and for each the place of its node in ``front``."""
    many = count[front]
    shift = first[front] - (np.cumsum(many) - many)
    owner = np.repeat(np.arange(len(front)), many)
    return owner, np.arange(len(owner)) + shift[owner]


def _once(places: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Every place once; ``mark`` is scratch over all places."""
    order = np.arange(len(places))
    mark[places] = order
    return places[mark[places] == order]


def _walk(src: np.ndarray, n: int, v: np.ndarray, first: np.ndarray, count: np.ndarray, follows=None):
    """Hops from every source to every node over the links that ``follows`` admits, and these links by their places.

    A place is the row of a source times ``n`` plus a node. Every place is left once, so a link is looked at
    once for a source, however many rounds there are.
    """
    depth, mark = np.full(len(src) * n, -1, np.int32), np.empty(len(src) * n, np.int64)
    front, step, used = np.arange(len(src)) * n + src, 0, []
    depth[front] = 0
    while len(front):
        node = front % n
        owner, link = _links_of(node, first, count)
        here, there = front[owner], (front - node)[owner] + v[link]
        if follows is not None:
            kept = follows(here, there, link)
            here, there, link = here[kept], there[kept], link[kept]
            used.append((here, there, link))
        front, step = _once(there[depth[there] < 0], mark), step + 1
        depth[front] = step
    return depth, [np.concatenate(side) for side in zip(*used)]


def _dependencies(src: np.ndarray, dist: np.ndarray, v, w, first, count) -> np.ndarray:
    """What the shortest paths from the sources to all others owe to every node."""
    n, far, free = dist.shape[1], dist.ravel(), w == 0

    def tight(here, there, link):
        kept = free[link]
        some = np.flatnonzero(~kept)
        a, b = here[some], there[some]
        kept[some] = np.abs(far[a] + w[link[some]] - far[b]) <= TIE * np.maximum(1.0, far[b])
        return kept

    depth, (here, there, link) = _walk(src, n, v, first, count, tight)
    # Links as short as the tolerance are tight both ways: keep only those that lead one hop further.
    kept = ~tight(there, here, link) | (depth[here] + 1 == depth[there])
    here, there = here[kept], there[kept]
    # The walk lists the links of a place together. A place is passed on when all its links have come in.
    count, waiting, first = np.bincount(here, minlength=len(far)), np.bincount(there, minlength=len(far)), np.zeros(len(far), int)
    heads = np.flatnonzero(np.r_[True, here[1:] != here[:-1]][: len(here)])
    first[here[heads]] = heads
    start = np.arange(len(src)) * n + src
    sigma, mark, rounds, front = np.zeros(len(far)), np.empty(len(far), np.int64), [], start
    sigma[start] = 1.0
    while len(front):
        owner, link = _links_of(front, first, count)
        a, b = front[owner], there[link]
        np.add.at(sigma, b, sigma[a])
        np.subtract.at(waiting, b, 1)
        rounds.append((a, b))
        front = _once(b[waiting[b] == 0], mark)
    back = 1.0 / sigma
    for a, b in reversed(rounds):
        np.add.at(back, a, back[b])
    owed = sigma * back - 1.0
    owed[start] = 0.0
    return owed.reshape(dist.shape).sum(axis=0)


def path_sums(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, mine: np.ndarray, hops: bool, dependency: bool) -> dict:
    """Path sums of the nodes ``mine`` and what their paths owe to all; links stand in both directions."""
    order = np.argsort(u, kind="stable")
    u, v, w = u[order], v[order], w[order]
    count = np.bincount(u, minlength=n)
    first = np.cumsum(count) - count
    # Nodes that zero-weight links hold together are as far as one another from everything.
    label = _touching(n, u[w <= 0], v[w <= 0])
    apart = np.flatnonzero(label[u] != label[v])
    apart = apart[np.argsort(label[v[apart]], kind="stable")]
    to = label[v[apart]]
    heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
    out = {k: np.zeros(n) for k in ("reach", "dist_sum", "hop_sum", "hop_max", "dependency")}
    step = max(1, 2_000_000 // max(len(u), 1))
    for at in range(0, len(mine), step):
        src = mine[at : at + step]
        parts, row = np.unique(label[src], return_inverse=True)
        dist = _relax(parts, label.max() + 1, label[u[apart]], to, w[apart], heads) if len(to) else np.zeros((1, 1))
        dist = np.ascontiguousarray(dist[row][:, label])
        out["reach"][src] = n
        out["dist_sum"][src] = dist.sum(axis=1)
        if hops:
            steps = _walk(src, n, v, first, count)[0].reshape(dist.shape)
            out["hop_sum"][src] = steps.sum(axis=1)
            out["hop_max"][src] = steps.max(axis=1)
        if dependency:
            out["dependency"] += _dependencies(src, dist, v, w, first, count)
    return out


def _sliced(number: int, n: int) -> np.ndarray:
    return np.arange(number * SOURCES_PER_SLICE, min((number + 1) * SOURCES_PER_SLICE, n))


def _slice_paths(part: pd.DataFrame, hops: bool = True, dependency: bool = True) -> pd.DataFrame:
    """Path sums and dependencies for one slice of source nodes of one small component."""
    names, codes = np.unique(np.concatenate([part["u"], part["v"]]).astype(str), return_inverse=True)
    n, m = len(names), len(part)
    mine = _sliced(int(part["slice"].iloc[0]), n)
    frame = pd.DataFrame({"node": names, **path_sums(n, codes[:m], codes[m:], part["w"].to_numpy(float), mine, hops, dependency)})
    frame.insert(0, KEY, part[KEY].iloc[0])
    frame["reach"] = frame["reach"].astype("int64")
    return frame


def _small_paths(edges: DataFrame, hops: bool = True, dependency: bool = True) -> DataFrame:
    """``edges``: location_id, component, size, u, v, w of small components. What is not asked for is 0."""
    slices = F.sequence(F.lit(0), F.floor((F.col("size") - 1) / SOURCES_PER_SLICE).cast("int"))
    return (
        edges.withColumn("slice", F.explode(slices))
        .groupBy(KEY, "component", "slice")
        .applyInPandas(lambda part: _slice_paths(part, hops, dependency), PATH_SCHEMA)
        .groupBy(KEY, "node")
        .agg(
            F.max("reach").alias("reach"),
            *[F.sum(c).alias(c) for c in ("dist_sum", "hop_sum")],
            F.max("hop_max").alias("hop_max"),
            F.sum("dependency").alias("dependency"),
        )
    )


def coded(groups: DataFrame, edges: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes with a number within their group, and the edges inside groups once each, by the numbers ``a`` and ``b``.

    ``groups``: ``location_id, node``, the group's columns and its ``size``. Numbers take less room in a task than names.
    """
    place = Window.partitionBy(*group).orderBy("node")
    codes = cut(groups.withColumn("code", (F.row_number().over(place) - 1).cast("int")))
    first = codes.select(*dict.fromkeys([KEY, *group]), "size", F.col("node").alias("src"), F.col("code").alias("a"))
    second = codes.select(KEY, F.col("node").alias("dst"), F.col("code").alias("b"))
    links = edges.join(first, [KEY, "src"]).join(second, [KEY, "dst"])
    return codes, links.select(*group, "size", "a", "b", F.col("weight").alias("w"))


CROWDED_SCHEMA = "location_id long, component string, a int, b int, w double, dist_sum double, hop_sum double, hop_max double"


def _touching(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, … of the parts that links hold together."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return np.unique(root, return_inverse=True)[1]


def _hops(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and maximum of the hops from every node of a component."""
    table = np.zeros((n, n), np.float32)
    table[a, b] = table[b, a] = 1
    open_, front = ~np.eye(n, dtype=bool), np.eye(n, dtype=np.float32)
    total, most, step = np.zeros(n), np.zeros(n), 0
    while True:
        fresh = (front @ table > 0) & open_
        found = fresh.sum(axis=1)
        if not found.any():
            return total, most
        step += 1
        total += step * found
        most[found > 0] = step
        open_ &= ~fresh
        front = fresh.astype(np.float32)


def shortest_links(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances from every node of a component, and which links are shortest paths between their own ends."""
    # Nodes that zero-weight links hold together are as far as one another from everything.
    label = _touching(n, a[w <= 0], b[w <= 0])
    count = np.bincount(label)
    far = np.full((len(count), len(count)), np.inf)
    np.minimum.at(far, (label[a], label[b]), w)
    far = np.minimum(far, far.T)
    np.fill_diagonal(far, 0.0)
    for k in range(len(far)):
        np.minimum(far, far[:, k, None] + far[k], out=far)
    # A link on some shortest path is a shortest path between its own ends, within the tolerance.
    return (far @ count)[label], w - far[label[a], label[b]] <= 4 * TIE * max(1.0, far.max())


def _reduced(hops: bool):
    """Sums of distances and hops of one crowded component, and its links that are shortest paths themselves."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["size"].iloc[0])
        a, b, w = part["a"].to_numpy(), part["b"].to_numpy(), part["w"].to_numpy(float)
        sums, kept = shortest_links(n, a, b, w)
        total, most = _hops(n, a, b) if hops else (np.zeros(n), np.zeros(n))
        sums = pd.DataFrame({"a": np.arange(n), "dist_sum": sums, "hop_sum": total, "hop_max": most})
        links = pd.DataFrame({"a": a[kept], "b": b[kept], "w": w[kept]})
        out = pd.concat([sums, links]).reindex(columns=["a", "b", "w", "dist_sum", "hop_sum", "hop_max"])
        out["b"] = out["b"].astype("Int32")
        out.insert(0, KEY, part[KEY].iloc[0])
        out.insert(1, "component", part["component"].iloc[0])
        return out

    return solve


def _crowded_paths(sized: DataFrame, edges: DataFrame, hops: bool, dependency: bool) -> DataFrame:
    """The sums of ``_small_paths`` for components with very many links, whose paths use few of them."""
    part = [KEY, "component"]
    codes, links = coded(sized, edges, part)
    found = cut(links.groupBy(*part).applyInPandas(_reduced(hops), CROWDED_SCHEMA))
    sums = found.filter("b IS NULL").withColumnRenamed("a", "code").join(codes, [*part, "code"])
    sums = sums.select(KEY, "node", F.col("size").cast("long").alias("reach"), "dist_sum", "hop_sum", "hop_max")
    if not dependency:
        return sums.withColumn("dependency", F.lit(0.0))
    ends = [codes.select(*part, F.col("code").alias(c), F.col("node").alias(name)) for c, name in (("a", "src"), ("b", "dst"))]
    kept = found.filter("b IS NOT NULL").join(ends[0], [*part, "a"]).join(ends[1], [*part, "b"])
    kept = cut(both_ways(kept.withColumnRenamed("w", "weight")))
    inside = kept.join(codes.select(*part, "size", F.col("node").alias("u")), [KEY, "u"])
    return sums.join(_small_paths(inside, hops=False).select(KEY, "node", "dependency"), [KEY, "node"])


def _distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``location_id, s, v, d`` by relaxing only the rows improved in the last round."""
    known = cut(sources.select(KEY, F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0.0).alias("d")))
    frontier = known
    while not frontier.isEmpty():
        step = (
            frontier.withColumnRenamed("v", "u")
            .join(edges, [KEY, "u"])
            .groupBy(KEY, "s", "v")
            .agg(F.min(F.col("d") + F.col("w")).alias("nd"))
        )
        frontier = cut(
            step.join(known, [KEY, "s", "v"], "left")
            .filter(F.col("d").isNull() | (F.col("nd") < F.col("d")))
            .select(KEY, "s", "v", F.col("nd").alias("d"))
        )
        known = cut(known.unionByName(frontier).groupBy(KEY, "s", "v").agg(F.min("d").alias("d")))
    return known


def _spread(wave: DataFrame, tight: DataFrame, at: str, to: str) -> DataFrame:
    """Sum of repeated one-step propagation of ``val`` along the tight edges."""
    total, wave = wave, cut(wave)
    while True:
        wave = cut(
            wave.withColumnRenamed("v", at)
            .join(tight, [KEY, "s", at])
            .groupBy(KEY, "s", F.col(to).alias("v"))
            .agg(F.sum("val").alias("val"))
        )
        if wave.isEmpty():
            return total
        total = cut(total.unionByName(wave).groupBy(KEY, "s", "v").agg(F.sum("val").alias("val")))


def _large_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The same sums by joins, for components that no task should hold."""
    edges = cut(edges.select(KEY, "u", "v", "w"))
    dist = _distances(edges, sources)
    hops = _distances(edges.withColumn("w", F.lit(1.0)), sources)
    at_u = dist.select(KEY, "s", F.col("v").alias("u"), F.col("d").alias("du"))
    slack = F.abs(F.col("du") + F.col("w") - F.col("d"))
    tight = cut(
        at_u.join(edges, [KEY, "u"])
        .join(dist, [KEY, "s", "v"])
        .filter(slack <= TIE * F.greatest(F.lit(1.0), "d"))
        .select(KEY, "s", "u", "v", "w")
    )
    back_too = tight.select(KEY, "s", F.col("u").alias("v"), F.col("v").alias("u")).distinct()
    tight = cut(
        tight.join(back_too.withColumn("both", F.lit(True)), [KEY, "s", "u", "v"], "left").withColumn(
            "both", F.coalesce("both", F.lit(False))
        )
    )
    if not tight.filter("both").isEmpty():
        depth = cut(sources.select(KEY, F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0).alias("h")))
        fresh = depth
        while not fresh.isEmpty():
            fresh = cut(
                fresh.withColumnRenamed("v", "u")
                .join(tight, [KEY, "s", "u"])
                .groupBy(KEY, "s", "v")
                .agg((F.min("h") + 1).alias("h"))
                .join(depth.select(KEY, "s", "v"), [KEY, "s", "v"], "left_anti")
            )
            depth = cut(depth.unionByName(fresh))
        from_u = depth.select(KEY, "s", F.col("v").alias("u"), F.col("h").alias("hu"))
        tight = cut(
            tight.join(from_u, [KEY, "s", "u"])
            .join(depth, [KEY, "s", "v"])
            .filter("NOT both OR hu + 1 = h")
            .select(KEY, "s", "u", "v")
        )
    tight = tight.select(KEY, "s", "u", "v")
    start = sources.select(KEY, F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("val"))
    sigma = _spread(start, tight, "u", "v")
    back = _spread(sigma.withColumn("val", F.lit(1.0) / F.col("val")), tight, "v", "u")
    owed = (
        sigma.join(back.withColumnRenamed("val", "b"), [KEY, "s", "v"])
        .filter("s <> v")
        .groupBy(KEY, F.col("v").alias("node"))
        .agg(F.sum(F.col("val") * F.col("b") - 1.0).alias("dependency"))
    )
    sums = dist.groupBy(KEY, F.col("s").alias("node")).agg(
        F.count("*").alias("reach"), F.sum("d").alias("dist_sum")
    )
    hop = hops.groupBy(KEY, F.col("s").alias("node")).agg(
        F.sum("d").alias("hop_sum"), F.max("d").alias("hop_max")
    )
    return (
        sums.join(hop, [KEY, "node"])
        .join(owed, [KEY, "node"], "left")
        .select(KEY, "node", "reach", "dist_sum", "hop_sum", "hop_max", F.coalesce("dependency", F.lit(0.0)).alias("dependency"))
    )


def path_statistics(
    nodes: DataFrame,
    edges: DataFrame,
    components: DataFrame | None = None,
    small: int = SMALL_COMPONENT,
    hops: bool = True,
    dependency: bool = True,
) -> DataFrame:
    """Per node: component, its size, reach, distance and hop sums, dependency on the node.

    Exact all-source paths are quadratic in a component by definition. Sources of large components
    go through in batches so that the live table keeps a bounded size; every source is covered.
    Without ``hops`` or ``dependency`` their columns are left out.
    """
    parts = cut(components if components is not None else connected_components(nodes, edges))
    sized = cut(parts.join(component_sizes(parts), [KEY, "component"]))
    edges = edges.filter("src <> dst")
    within = sized.filter((F.col("size") > CROWDED_NODES) & (F.col("size") <= small))
    links = edges.join(within.withColumnRenamed("node", "src"), [KEY, "src"]).groupBy(KEY, "component", "size")
    crowded = cut(links.agg(F.count("*").alias("links")).filter(F.col("links") > CROWDED_LINKS * F.col("size")))
    plain, stats = sized, None
    if not crowded.isEmpty():
        keys = crowded.select(KEY, "component")
        stats = _crowded_paths(sized.join(keys, [KEY, "component"], "left_semi"), edges, hops, dependency)
        plain = sized.join(keys, [KEY, "component"], "left_anti")
    inside = both_ways(edges).join(plain.withColumnRenamed("node", "u"), [KEY, "u"])
    found = _small_paths(inside.filter(F.col("size") <= small), hops, dependency)
    stats = found if stats is None else stats.unionByName(found)
    large = sized.filter(F.col("size") > small)
    pairs = large.agg(F.sum("size")).first()[0]
    if pairs:
        batches = int(pairs // PAIRS_PER_BATCH) + 1
        links = inside.filter(F.col("size") > small)
        turn = F.pmod(F.xxhash64("node"), F.lit(batches))
        done = [_large_paths(links, large.filter(turn == i)) for i in range(batches)]
        summed = done[0]
        for more in done[1:]:
            summed = summed.unionByName(more)
        # A node's dependency collects over all batches, its own sums come from one.
        summed = summed.groupBy(KEY, "node").agg(
            *[F.max(c).alias(c) for c in ("reach", "dist_sum", "hop_sum", "hop_max")],
            F.sum("dependency").alias("dependency"),
        )
        stats = stats.unionByName(summed)
    zero = {"reach": 1, "dist_sum": 0.0, "hop_sum": 0.0, "hop_max": 0.0, "dependency": 0.0}
    unasked = [] if hops else ["hop_sum", "hop_max"]
    return sized.join(stats, [KEY, "node"], "left").fillna(zero).drop(*unasked, *([] if dependency else ["dependency"]))


def _with_order(stats: DataFrame) -> DataFrame:
    return stats.join(stats.groupBy(KEY).agg(F.count("*").alias("n")), KEY)


def betweenness(stats: DataFrame) -> DataFrame:
    scale = (F.col("n") - 1) * (F.col("n") - 2)
    value = F.when(F.col("n") > 2, F.col("dependency") / scale).otherwise(F.lit(0.0))
    return _with_order(stats).select(KEY, "node", value.alias("betweenness"))


def closeness(stats: DataFrame) -> DataFrame:
    near = F.col("reach") - 1
    value = F.when(
        (F.col("dist_sum") > 0) & (F.col("n") > 1),
        near / F.col("dist_sum") * near / (F.col("n") - 1),
    ).otherwise(F.lit(0.0))
    return _with_order(stats).select(KEY, "node", value.alias("closeness"))


def hop_statistics(stats: DataFrame) -> DataFrame:
    """Diameter and mean hop distance of the whole graph or of its largest component."""
    per_part = stats.groupBy(KEY, "component").agg(
        F.max("size").alias("size"), F.max("hop_max").alias("diameter"), F.sum("hop_sum").alias("hops")
    )
    best = per_part.groupBy(KEY).agg(
        F.min(F.struct(-F.col("size"), "component", "size", "diameter", "hops")).alias("b"),
        F.count("*").alias("num_components"),
    )
    size = F.col("b.size")
    mean = F.when(size > 1, F.col("b.hops") / (size * (size - 1))).otherwise(F.lit(0.0))
    return best.select(
        KEY,
        size.alias("largest_cc_size"),
        (F.col("num_components") == 1).alias("is_connected"),
        F.col("b.diameter").alias("diameter"),
        mean.alias("avg_path_length"),
    )


# --- spectra ------------------------------------------------------------------------------


def _power_iteration(rounds: int, tolerance: float):
    """Per-location kernel for small graphs; nodes come as zero-weight loops among the edges."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        a, b, w = part["a"].to_numpy(), part["b"].to_numpy(), part["w"].to_numpy(float)
        n = int(part["size"].iloc[0])
        x, done = np.full(n, 1.0 / n), False
        for _ in range(rounds):
            y = x + np.bincount(b, weights=w * x[a], minlength=n) + np.bincount(a, weights=w * x[b], minlength=n)
            y /= np.sqrt((y * y).sum()) or 1.0
            done = np.abs(y - x).sum() < n * tolerance
            x = y
            if done:
                break
        frame = pd.DataFrame({"code": np.arange(n), "eigenvector": x if done else np.zeros(n)})
        frame.insert(0, KEY, part[KEY].iloc[0])
        return frame

    return solve


def eigenvector(
    nodes: DataFrame,
    edges: DataFrame,
    rounds: int = 100,
    tolerance: float = 1e-6,
    small: int = SMALL_COMPONENT,
) -> DataFrame:
    """Eigenvector centrality by power iteration; 0 for a location that does not converge."""
    n = cut(nodes.groupBy(KEY).agg(F.count("*").alias("n")))
    few = n.filter(F.col("n") <= small).withColumnRenamed("n", "size")
    codes, links = coded(nodes.select(KEY, "node").join(few, KEY), edges, [KEY])
    loops = codes.select(KEY, "size", F.col("code").alias("a"), F.col("code").alias("b"), F.lit(0.0).alias("w"))
    solved = links.unionByName(loops).groupBy(KEY)
    found = solved.applyInPandas(_power_iteration(rounds, tolerance), f"{KEY} long, code int, eigenvector double")
    found = found.join(codes, [KEY, "code"]).select(KEY, "node", "eigenvector")
    big = n.filter(F.col("n") > small).select(KEY)
    if big.isEmpty():
        return found
    large_nodes = nodes.join(big, KEY, "left_semi")
    large_edges = edges.join(big, KEY, "left_semi")
    return found.unionByName(_large_eigenvector(large_nodes, large_edges, rounds, tolerance))


def _large_eigenvector(
    nodes: DataFrame, edges: DataFrame, rounds: int, tolerance: float
) -> DataFrame:
    """The same by joins; a location is frozen in the round it converges."""
    links = cut(both_ways(edges))
    n = nodes.groupBy(KEY).agg(F.count("*").alias("n"))
    state = cut(
        nodes.select(KEY, "node")
        .join(n, KEY)
        .select(KEY, "node", "n", (F.lit(1.0) / F.col("n")).alias("x"), F.lit(False).alias("done"))
    )
    for i in range(1, rounds + 1):
        inflow = (
            links.join(state.filter("NOT done").select(KEY, F.col("node").alias("u"), "x"), [KEY, "u"])
            .groupBy(KEY, F.col("v").alias("node"))
            .agg(F.sum(F.col("w") * F.col("x")).alias("in"))
        )
        raw = state.join(inflow, [KEY, "node"], "left").withColumn(
            "y", F.col("x") + F.coalesce("in", F.lit(0.0))
        )
        norms = raw.groupBy(KEY).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        scaled = raw.join(norms, KEY).withColumn(
            "y", F.when(F.col("norm") > 0, F.col("y") / F.col("norm")).otherwise(F.col("y"))
        )
        shift = scaled.groupBy(KEY).agg(F.sum(F.abs(F.col("y") - F.col("x"))).alias("shift"))
        state = scaled.join(shift, KEY).select(
            KEY,
            "node",
            "n",
            F.when(F.col("done"), F.col("x")).otherwise(F.col("y")).alias("x"),
            (F.col("done") | (F.col("shift") < F.col("n") * tolerance)).alias("done"),
        )
        state = cut(state)
        if i % 10 == 0 and state.filter("NOT done").isEmpty():
            break
    return state.select(KEY, "node", F.when(F.col("done"), F.col("x")).otherwise(F.lit(0.0)).alias("eigenvector"))


def laplacian(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sparse ``location_id, row, col, value`` of D − A, zeros of the diagonal included."""
    sym = both_ways(edges)
    weight = sym.groupBy(KEY, F.col("u").alias("node")).agg(F.sum("w").alias("d"))
    diagonal = (
        nodes.select(KEY, "node")
        .join(weight, [KEY, "node"], "left")
        .select(KEY, F.col("node").alias("row"), F.col("node").alias("col"), F.coalesce("d", F.lit(0.0)).alias("value"))
    )
    off = sym.select(KEY, F.col("u").alias("row"), F.col("v").alias("col"), (-F.col("w")).alias("value"))
    return diagonal.unionByName(off)


FIEDLER_SCHEMA = "location_id long, component string, fiedler double"


def _inverse_apply(degree: np.ndarray, u, v, w, rhs: np.ndarray) -> np.ndarray:
    """Solve L x = rhs orthogonal to the constant vector, by conjugate gradients scaled by degree."""

    def smooth(r: np.ndarray) -> np.ndarray:
        z = r / degree
        return z - z.mean()

    x, r = np.zeros_like(rhs), rhs - rhs.mean()
    goal = 1e-13 * np.linalg.norm(r)
    if goal == 0:
        return x
    z = smooth(r)
    p, rz, best, stale = z, r @ z, np.inf, 0
    while True:
        lp = degree * p - np.bincount(u, w * p[v], len(degree))
        bend = p @ lp
        # What is left of the right-hand side is rounding, along which there is no descent.
        if not (rz > 0 and bend > 0 and np.isfinite(rz / bend)):
            return x - x.mean()
        step = rz / bend
        x += step * p
        r -= step * lp
        size = np.linalg.norm(r)
        # Rounding ends the descent at some size; the outer iteration corrects what is left.
        stale = 0 if size < 0.5 * best else stale + 1
        best = min(best, size)
        if size <= goal or stale > 2 * len(degree) + 50:
            return x - x.mean()
        z = smooth(r)
        new = r @ z
        p, rz = z + new / rz * p, new


def _component_fiedler(part: pd.DataFrame) -> pd.DataFrame:
    """Smallest non-zero Laplacian eigenvalue of one component, from its edges alone.

    If few nodes are left without the trees that hang on them, equations are solved exactly: up the trees, on the
    table of what is left, and down again. Else inverse iteration on a small subspace of vectors orthogonal to the
    constant one. Either stops at the residual bound (an eigenvalue lies within the residual of the estimate), for any size.
    """
    names, codes = np.unique(np.concatenate([part["u"], part["v"]]).astype(str), return_inverse=True)
    n, m = len(names), len(part)
    u, v, w = codes[:m], codes[m:], part["w"].to_numpy(float)
    degree = np.bincount(u, w, n)

    def product(q: np.ndarray) -> np.ndarray:
        return degree[:, None] * q - np.stack([np.bincount(u, w * x[v], n) for x in q.T], axis=1)

    rounds, core = _hanging(n, u, v, w)
    if len(core) <= SMALL_COMPONENT:
        corrected = _tree_inverse(n, u, v, w, rounds, core)
        start = np.c_[np.arange(n) == degree.argmin(), np.random.Generator(np.random.PCG64(n)).normal(size=(n, 4))]
        return _fiedler_row(part, descent(product, corrected, start[:, : min(5, n - 1)], degree.max()))

    def inverse(q: np.ndarray) -> np.ndarray:
        return np.stack([_inverse_apply(degree, u, v, w, x) for x in q.T], axis=1)

    return _fiedler_row(part, _least_value(degree, product, inverse))


TREE_ROUNDS = 64  # a round costs a pass over the links that are left; what is deeper stays with the rest


def _hanging(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[list, np.ndarray]:
    """Leaves, what they hang on and by what weight, round by round without the leaves before; and the nodes left.

    Links stand in both directions. Nodes that several links join stay.
    """
    rounds, left = [], np.ones(n, bool)
    while len(rounds) < TREE_ROUNDS:
        count = np.bincount(u, minlength=n)
        mine = (count[u] == 1) & ((count[v] > 1) | (u > v))  # of two that hang on each other one stays
        if not mine.any():
            break
        rounds.append((u[mine], v[mine], w[mine]))
        left[u[mine]] = False
        kept = left[u] & left[v]
        u, v, w = u[kept], v[kept], w[kept]
    return rounds, np.flatnonzero(left)


def _tree_inverse(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, rounds: list, core: np.ndarray):
    """The solution of L x = r for columns r that sum to 0, but for a constant."""
    place = np.full(n, -1)
    place[core] = np.arange(len(core))
    inside = (place[u] >= 0) & (place[v] >= 0)
    table = np.zeros((len(core), len(core)))
    np.subtract.at(table, (place[u[inside]], place[v[inside]]), w[inside])
    weight = -table.sum(axis=1)
    table[np.arange(len(core)), np.arange(len(core))] += weight
    # The added constant moves the value 0 of the constant vector away and no other.
    solver = np.linalg.inv(table + (weight.mean() or 1.0) / len(core))

    def solve(r: np.ndarray) -> np.ndarray:
        r = r - r.mean(axis=0)
        for leaf, to, _ in rounds:
            for column in r.T:
                column += np.bincount(to, column[leaf], n)
        x = np.zeros(r.shape)
        x[core] = solver @ (r[core] - r[core].mean(axis=0))
        for leaf, to, weight in reversed(rounds):
            x[leaf] = x[to] + r[leaf] / weight[:, None]
        return x

    return solve


def _apart(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns in the span of ``x``, orthogonal to ``basis`` and to the constant vector."""
    for _ in range(2):
        x = x - x.mean(axis=0)
        x, _ = np.linalg.qr(x - basis @ (basis.T @ x))
    return x


def descent(laplacian, corrected, start: np.ndarray, top: float) -> float:
    """Smallest non-zero eigenvalue of a connected graph's Laplacian, from its products with a few columns.

    Descent in the span of a few vectors, their residuals as ``corrected`` by an approximate solution, and their last
    steps, until the residual is small beside the value; the error of the value is of the order of the residual squared.
    ``top``: the largest weight of a node.
    """
    n, k = start.shape
    none = np.zeros((n, 0))
    x, p, lp, before, idle = _apart(start, none), none, none, np.inf, 0
    lx, floor = laplacian(x), 1e-14 * top * np.sqrt(n)
    while True:
        form = x.T @ lx
        values, turn = np.linalg.eigh((form + form.T) / 2)
        x, lx = x @ turn, lx @ turn
        value, rest = float(values[0]), lx - x * values
        idle = 0 if value < before * (1 - 1e-14) else idle + 1
        if np.linalg.norm(rest[:, 0]) <= max(1e-7 * value, floor) or idle > 6:
            return max(0.0, value)
        before = min(before, value)
        if 3 * k >= n:  # the span below would be the whole space
            values = np.linalg.eigvalsh(laplacian(np.eye(n)))
            return max(0.0, float(values[1]))
        z = _apart(corrected(rest), x)
        basis, image = np.c_[x, z], np.c_[lx, laplacian(z)]
        for _ in range(2):
            share = basis.T @ p
            p, lp = p - basis @ share, lp - image @ share
        spread, turn = np.linalg.eigh(p.T @ p)
        kept = spread > 1e-20 * spread.max(initial=1e-300)
        turn = turn[:, kept] / np.sqrt(spread[kept])
        basis, image = np.c_[basis, p @ turn], np.c_[image, lp @ turn]
        form = basis.T @ image
        turn = np.linalg.eigh((form + form.T) / 2)[1][:, :k]
        step = turn[k:]
        p, lp = basis[:, k:] @ step, image[:, k:] @ step
        x, lx = basis @ turn, image @ turn


def _least_value(degree: np.ndarray, product, inverse) -> float:
    n = len(degree)
    draw = np.random.Generator(np.random.PCG64(n))
    q = draw.normal(size=(n, min(4, n - 1)))
    before = np.inf
    while True:
        q, _ = np.linalg.qr(q - q.mean(axis=0))
        lq = product(q)
        values, turn = np.linalg.eigh(q.T @ lq)
        q, lq = q @ turn, lq @ turn
        value = float(values[0])
        residual = np.linalg.norm(lq[:, 0] - value * q[:, 0])
        floor = 1e-14 * degree.max() * np.sqrt(n)
        # The error of the value is of the order of the residual squared.
        if residual <= max(1e-7 * value, floor) or abs(before - value) <= 1e-15 * value:
            return value
        before = value
        q = inverse(q)


def _fiedler_row(part: pd.DataFrame, value: float) -> pd.DataFrame:
    row = {KEY: part[KEY].iloc[0], "component": part["component"].iloc[0], "fiedler": max(0.0, value)}
    return pd.DataFrame([row])


def table_fiedler(table: np.ndarray) -> float:
    """Smallest non-zero Laplacian eigenvalue of a connected graph from its symmetric table of weights, which is overwritten."""
    n, degree = len(table), table.sum(axis=1)
    np.negative(table, out=table)
    table[np.arange(n), np.arange(n)] += degree
    # The added constant moves the value 0 of the constant vector away and no other.
    solver = np.linalg.inv(table + degree.mean() / n)
    return max(0.0, _least_value(degree, lambda q: table @ q, lambda q: solver @ q))


def _crowded_fiedler(part: pd.DataFrame) -> pd.DataFrame:
    """The same for a component of few nodes and very many links, from a table of its nodes."""
    n = int(part["size"].iloc[0])
    table = np.zeros((n, n))
    np.add.at(table, (part["a"].to_numpy(), part["b"].to_numpy()), part["w"].to_numpy(float))
    table += table.T
    return _fiedler_row(part, table_fiedler(table))


BASIS = ("x", "r", "p")


def _turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Coefficients of the smallest Ritz vector in the span of x, r and p, from their dot products."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            mass, form = (
                np.array([[getattr(row, f"{kind}_{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)])
                for kind in ("m", "a")
            )
            scale = np.sqrt(np.maximum(np.diag(mass), 1e-300))
            mass, form = mass / np.outer(scale, scale), form / np.outer(scale, scale)
            spread, turn = np.linalg.eigh(mass)
            kept = turn[:, spread > 1e-10] / np.sqrt(spread[spread > 1e-10])
            values, vectors = np.linalg.eigh(kept.T @ form @ kept)
            out.append((kept @ vectors[:, 0] / scale, float(values[0])))
        frame = batch[[KEY, "component"]].copy()
        for k, name in enumerate(BASIS):
            frame[f"c_{name}"] = [c[k] for c, _ in out]
        frame["value"] = [v for _, v in out]
        yield frame


def _large_fiedler(members: DataFrame, links: DataFrame, patience: int = 6) -> DataFrame:
    """``location_id, component, fiedler`` by descent in the span of the vector, its residual and the last step.

    One round is one product of the Laplacian (a join of the links with the nodes) and the dot products of
    three vectors (a grouped sum), for all components at once. A component is settled once its residual is
    small beside its value, or its value has not fallen for ``patience`` rounds, which is the end of what
    doubles resolve; settled ones are set aside. No task holds a component.
    """
    part = [KEY, "component"]
    links = cut(links.select(*part, "u", "v", "w"))
    degree = links.groupBy(*part, F.col("u").alias("node")).agg(F.sum("w").alias("degree"))

    def product(state: DataFrame, column: str) -> DataFrame:
        """``state`` with the Laplacian's product with a column, as ``l<column>``."""
        ends = state.select(*part, F.col("node").alias("v"), F.col(column).alias("_x"))
        pull = links.join(ends, [*part, "v"]).groupBy(*part, F.col("u").alias("node")).agg(F.sum(F.col("w") * F.col("_x")).alias("_p"))
        return state.join(pull, [*part, "node"]).withColumn(f"l{column}", F.col("degree") * F.col(column) - F.col("_p")).drop("_p")

    def centred(state: DataFrame, column: str) -> DataFrame:
        mean = state.groupBy(*part).agg(F.avg(column).alias("_mean"))
        return state.join(mean, part).withColumn(column, F.col(column) - F.col("_mean")).drop("_mean")

    start = F.shiftrightunsigned(F.xxhash64("node"), 11) / F.lit(2.0**53) - 0.5
    state = members.select(*part, "node").join(degree, [*part, "node"]).withColumn("x", start)
    zero = F.lit(0.0)
    state = cut(product(centred(state, "x"), "x").withColumns({"p": zero, "lp": zero, "least": F.lit(float("inf")), "idle": F.lit(0)}))
    done = None
    while True:
        sums = state.groupBy(*part).agg(
            F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("lx")).alias("xlx"),
            F.max("degree").alias("top"), F.count("*").alias("n"),
        )
        state = state.join(sums, part).withColumn("value", F.col("xlx") / F.col("xx"))
        state = state.withColumn("rest", F.col("lx") - F.col("value") * F.col("x"))
        size = state.groupBy(*part).agg(F.sqrt(F.sum(F.col("rest") * F.col("rest"))).alias("residual"))
        fell = F.col("value") < F.col("least") * (1 - 1e-15)
        idle = F.when(fell, 0).otherwise(F.col("idle") + 1)
        settled = (F.col("residual") <= F.greatest(1e-6 * F.col("value"), 1e-14 * F.col("top") * F.sqrt("n")) * F.sqrt("xx")) | (
            idle > patience
        )
        state = cut(
            state.join(size, part).withColumns({"settled": settled, "idle": idle, "least": F.least("least", "value")})
            .drop("residual", "xlx", "xx", "top", "n")
        )
        ended = cut(state.filter("settled").groupBy(*part).agg(F.greatest(F.lit(0.0), F.max("value")).alias("fiedler")))
        done = ended if done is None else done.unionByName(ended)
        state = state.filter("NOT settled")
        if state.isEmpty():
            return done
        state = cut(product(centred(state.withColumn("r", F.col("rest") / F.col("degree")), "r"), "r"))
        dots = [
            F.sum(F.col(a) * F.col(f"{'l' if kind == 'a' else ''}{b}")).alias(f"{kind}_{i}{j}")
            for kind in ("m", "a") for i, a in enumerate(BASIS) for j, b in enumerate(BASIS) if i <= j
        ]
        schema = ", ".join(f"{c} {t}" for c, t in state.select(*part).dtypes) + ", c_x double, c_r double, c_p double, value double"
        turn = state.groupBy(*part).agg(*dots).mapInPandas(_turned, schema).drop("value")
        step = {n: F.col("c_r") * F.col(f"{n}r") + F.col("c_p") * F.col(f"{n}p") for n in ("", "l")}
        state = cut(
            state.join(turn, part)
            .select(
                *part, "node", "degree", "least", "idle", step[""].alias("p"), step["l"].alias("lp"),
                (F.col("c_x") * F.col("x") + step[""]).alias("x"), (F.col("c_x") * F.col("lx") + step["l"]).alias("lx"),
            )
        )


def component_fiedler(
    nodes: DataFrame,
    edges: DataFrame,
    components: DataFrame | None = None,
    small: int = SMALL_EDGES,
) -> DataFrame:
    """``location_id, component, size, fiedler`` of every component with two or more nodes.

    A component held together only by zero-weight edges is split for the Laplacian: exactly 0.
    Every component has a value. A task holds the edges of one component, up to ``small`` of them, or the table of
    up to ``SMALL_COMPONENT`` nodes; larger components are solved by joins.
    """
    parts = cut(components if components is not None else connected_components(nodes, edges))
    sizes = component_sizes(parts).filter("size >= 2")
    weighted = edges.filter("weight > 0 AND src <> dst")
    if edges.filter("weight <= 0").isEmpty():
        solid = parts
    else:
        solid = cut(connected_components(nodes, weighted))
    solid_sizes = component_sizes(solid).filter("size >= 2")
    # Only components that stay whole over positive weights have a value above 0.
    whole = sizes.join(solid_sizes.select(KEY, "component", F.col("size").alias("solid")), [KEY, "component"]).filter("size = solid")
    members = solid.join(whole.select(KEY, "component", "size"), [KEY, "component"])
    links = both_ways(weighted).join(members.withColumnRenamed("node", "u"), [KEY, "u"])
    counts = links.groupBy(KEY, "component").agg((F.count("*") / 2).alias("links"))
    links = links.join(counts, [KEY, "component"])
    many = cut(counts.filter(F.col("links") > small).join(sizes, [KEY, "component"]))
    few = F.col("size") <= min(SMALL_COMPONENT, small)
    crowded, large = (many.filter(kind).select(KEY, "component", "links") for kind in (few, ~few))
    values = links.filter(F.col("links") <= small).groupBy(KEY, "component").applyInPandas(_component_fiedler, FIEDLER_SCHEMA)
    part = [KEY, "component"]
    if not crowded.isEmpty():
        inside = members.join(crowded, part, "left_semi")
        values = values.unionByName(coded(inside, weighted, part)[1].groupBy(*part).applyInPandas(_crowded_fiedler, FIEDLER_SCHEMA))
    if not large.isEmpty():
        values = values.unionByName(
            _large_fiedler(members.join(large, part, "left_semi"), links.join(large.select(*part), part, "left_semi"))
        )
    pending = values.withColumn("solved", F.lit(True))
    return sizes.join(pending, [KEY, "component"], "left").select(
        KEY, "component", "size",
        F.when(F.col("solved"), F.col("fiedler")).otherwise(F.lit(0.0)).alias("fiedler"),
    )


def graph_fiedler(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Algebraic connectivity of each whole graph: 0 unless it is one component."""
    n = nodes.groupBy(KEY).agg(F.count("*").alias("n"))
    full = n.join(parts.select(KEY, "size", "fiedler"), KEY, "left").groupBy(KEY).agg(
        F.max(F.when(F.col("size") == F.col("n"), F.col("fiedler"))).alias("fiedler")
    )
    return full.select(KEY, F.coalesce("fiedler", F.lit(0.0)).alias("fiedler"))


# --- robustness ---------------------------------------------------------------------------


def removal_ranks(importance: DataFrame) -> DataFrame:
    """``location_id, node, gone, n``: the place in the removal, most important node first, and the nodes in all."""
    from tessera.operators.ordering import running_positions

    ranked = running_positions(importance, [KEY], [F.col("importance").desc(), F.col("node")]).select(
        KEY, "node", F.col("before").cast("long").alias("gone"), F.col("group_total").alias("n")
    )
    return cut(ranked)


def robustness(network, importance: DataFrame) -> DataFrame:
    """First removal, most important node first, that disconnects each connected graph.

    An edge survives until its earlier end goes. With a maximum spanning forest over that time,
    what is left after i removals has (n − i) − (forest edges still alive) components, so one
    forest and one running count answer every step at once.
    ``importance``: ``location_id, node, importance``; ties fall to the smaller name. A graph that
    never disconnects before it is empty has critical fraction 0.
    """
    from tessera.operators.components import component_labels
    from tessera.operators.ordering import running_positions

    ranked = removal_ranks(importance)
    order = ranked.select(KEY, "node", "gone")
    timed = (
        network.edges.filter("src <> dst")
        .join(order.select(KEY, F.col("node").alias("src"), F.col("gone").alias("a")), [KEY, "src"])
        .join(order.select(KEY, F.col("node").alias("dst"), F.col("gone").alias("b")), [KEY, "dst"])
        .select(KEY, F.least("a", "b").alias("until"), F.struct("src", "dst").alias("edge"), F.col("src").alias("u"), F.col("dst").alias("v"))
    )
    current, forest = cut(timed), None
    while not current.isEmpty():
        ends = current.select(KEY, F.col("u").alias("node"), "until", "edge", "u", "v").unionByName(
            current.select(KEY, F.col("v").alias("node"), "until", "edge", "u", "v")
        )
        # The longest-lived edge of every node; the edge itself breaks ties the same way for both ends.
        chosen = cut(
            ends.groupBy(KEY, "node")
            .agg(F.max(F.struct("until", "edge", "u", "v")).alias("e"))
            .select(KEY, "e.*")
            .distinct()
        )
        picked = chosen.select(KEY, "until")
        forest = picked if forest is None else forest.unionByName(picked)
        labels = cut(component_labels(chosen.select(KEY, F.col("u").alias("src"), F.col("v").alias("dst"))))
        current = cut(
            current.join(labels.select(KEY, "u", F.col("component").alias("cu")), [KEY, "u"])
            .join(labels.select(KEY, F.col("u").alias("v"), F.col("component").alias("cv")), [KEY, "v"])
            .filter("cu <> cv")
            .select(KEY, F.col("cu").alias("u"), F.col("cv").alias("v"), "until", "edge")
            .groupBy(KEY, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .agg(F.max(F.struct("until", "edge")).alias("e"))
            .select(KEY, "e.until", "e.edge", "u", "v")
        )
    totals = ranked.groupBy(KEY).agg(F.count("*").alias("n"))
    if forest is None:
        return totals.select(KEY, F.lit(0.0).alias("robustness"), F.lit(0.0).alias("critical_fraction"))
    ends_at = forest.groupBy(KEY, "until").agg(F.count("*").alias("m"))
    size = forest.groupBy(KEY).agg(F.count("*").alias("forest"))
    steps = ranked.join(ends_at.withColumnRenamed("until", "gone"), [KEY, "gone"], "left").fillna(0, ["m"])
    placed = running_positions(steps.select(KEY, "gone", "n", "m"), [KEY], ["gone"], weight="m")
    left = F.col("n") - F.col("gone") - 1
    alive = F.col("forest") - F.col("before") - F.col("m")
    first = (
        placed.join(size, KEY)
        .filter((left > 0) & (left - alive > 1))
        .groupBy(KEY)
        .agg(F.min(F.col("gone") + 1).alias("step"))
    )
    whole = (F.col("n") >= 3) & (F.col("forest") == F.col("n") - 1)
    fraction = F.coalesce(F.col("step") / F.col("n"), F.lit(0.0))
    return (
        totals.join(size, KEY, "left")
        .fillna(0, ["forest"])
        .join(first, KEY, "left")
        .select(
            KEY,
            F.when(whole, F.lit(1.0) - fraction).otherwise(F.lit(0.0)).alias("robustness"),
            F.when(whole, fraction).otherwise(F.lit(0.0)).alias("critical_fraction"),
        )
    )


def removal_order(network, strategy: str = "random", seed: int = 42, stats: DataFrame | None = None) -> DataFrame:
    """Importance of every node for a removal strategy: degree, betweenness or (seeded) random."""
    if strategy == "degree":
        return degrees(network).select(KEY, "node", F.col("degree").cast("double").alias("importance"))
    if strategy == "betweenness":
        found = stats if stats is not None else path_statistics(network.nodes, network.edges)
        return betweenness(found).withColumnRenamed("betweenness", "importance")
    return network.nodes.select(
        KEY, "node", F.xxhash64(F.lit(seed), "node").cast("double").alias("importance")
    )
