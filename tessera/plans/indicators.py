"""The six indicators, each as one row per location.

Two variants exist of most: ``*_a`` from the detailed calculators, ``*_b`` from the batch
calculator that fills the result table. Locations come from the buildings table unless a
``locations`` table is passed; there, empty locations get the documented zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.operators import cluster as cl
from tessera.operators import graph as gp
from tessera.operators import grid as gr
from tessera.operators import networks as nw
from tessera.operators import overlap as ov
from tessera.operators import proximity as px
from tessera.operators import tables as tb
from tessera.operators.components import connected_components
from tessera.operators.networks import Network
from tessera.operators.proximity import footprints

KEY = "location_id"


def _clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _with_locations(df: DataFrame, locations: DataFrame | None) -> DataFrame:
    """One row for every location, numbers 0 where the indicator found nothing."""
    if locations is None:
        return df
    return locations.select(KEY).join(df, KEY, "left").fillna(0)


# --- sparsity -----------------------------------------------------------------------------


def building_count(buildings: DataFrame, min_area: float = 10.0) -> DataFrame:
    return footprints(buildings).groupBy(KEY).agg(
        F.count_if(F.col("area_m2") >= min_area).alias("building_count")
    )


def spatial_filling_ratio(buildings: DataFrame) -> DataFrame:
    """Built area over the area of the bounds; 0 for empty bounds."""
    shapes = footprints(buildings.withColumn("area_m2", F.lit(None).cast("double")))
    box = (F.max("x_max") - F.min("x_min")) * (F.max("y_max") - F.min("y_min"))
    return shapes.groupBy(KEY).agg(
        F.when(box > 0, F.sum("area_m2") / box).otherwise(F.lit(0.0)).alias("filling_ratio")
    )


def sparsity_a(
    buildings: DataFrame,
    sizes: list[int] = gr.BOX_SIZES,
    min_area: float = 10.0,
    locations: DataFrame | None = None,
) -> DataFrame:
    """Fractal dimension per counted building."""
    dimension = gr.fractal_dimension(gr.box_counts(buildings, sizes), len(sizes))
    joined = (
        building_count(buildings, min_area)
        .join(dimension, KEY, "left")
        .fillna(0.0, ["fractal_dimension"])
    )
    ratio = F.coalesce(F.try_divide("fractal_dimension", "building_count"), F.lit(0.0))
    return _with_locations(
        joined.select(KEY, ratio.alias("sparsity"), "fractal_dimension", "building_count"), locations
    )


def sparsity_b(buildings: DataFrame) -> DataFrame:
    """2 minus the clipped fractal dimension; 0 below four buildings."""
    dimension = gr.fractal_dimension(
        gr.box_counts_wide(buildings), len(gr.WIDE_BOX_SIZES)
    )
    counts = buildings.groupBy(KEY).agg(F.count("*").alias("n"))
    value = _clip(F.lit(2.0) - _clip(F.col("fractal_dimension"), 0.0, 2.0), 0.0, 2.0)
    return counts.join(dimension, KEY).select(
        KEY, F.when(F.col("n") < 4, F.lit(0.0)).otherwise(value).alias("sparsity")
    )


# --- multi-nodality -----------------------------------------------------------------------


def multi_nodality_a(
    buildings: DataFrame,
    eps: float = 50.0,
    min_samples: int = 5,
    dispersion: str = "variance",
    diversity: str = "constant",
    locations: DataFrame | None = None,
) -> DataFrame:
    """Number of cores × dispersion × diversity; zeros below two buildings."""
    labelled = cl.dbscan(cl.centroids(buildings), eps, min_samples)
    parts = (
        cl.num_cores(labelled)
        .join(cl.core_dispersion(labelled, dispersion), KEY)
        .join(cl.core_diversity(labelled, diversity), KEY)
    )
    enough = F.col("num_points") >= 2

    def kept(column: str) -> Column:
        zero = F.lit(0).cast(dict(parts.dtypes)[column])
        return F.when(enough, F.col(column)).otherwise(zero).alias(column)

    product = F.col("num_cores") * F.col("core_dispersion") * F.col("core_diversity")
    return _with_locations(
        parts.select(
            KEY,
            F.when(enough, product).otherwise(F.lit(0.0)).alias("multi_nodality"),
            *[kept(c) for c in ("num_cores", "core_dispersion", "core_diversity")],
        ),
        locations,
    )


def multi_nodality_b(buildings: DataFrame) -> DataFrame:
    """Clusters over the expected number, at most 1; 0 below ten buildings."""
    labelled = cl.dbscan(cl.centroids(buildings))
    expected = F.least(F.lit(10), F.floor(F.col("num_points") / 10))
    value = F.least(F.lit(1.0), F.try_divide(F.col("num_cores"), expected))
    return cl.num_cores(labelled).select(
        KEY,
        F.when(expected > 0, value).otherwise(F.lit(0.0)).alias("multi_nodality"),
    )


# --- permeability -------------------------------------------------------------------------

# Fixed value: site percolation threshold of the square lattice.
PERCOLATION_THRESHOLD = 0.5927


def permeability_a(
    buildings: DataFrame,
    roads: DataFrame | None = None,
    resolution: float = 10.0,
    grid_size: float = 50.0,
    threshold: float = 0.3,
    road_mode: str = "crossed",
    locations: DataFrame | None = None,
) -> DataFrame:
    """Largest open cluster over all open area; no row is made for an empty cell."""
    bounds = cut(gr.grid_frame(buildings, resolution, locations))
    blocked = gr.blocked_cells(
        buildings, bounds, roads, resolution, grid_size, threshold, road_mode
    )
    clusters = gr.run_clusters(gr.open_runs(blocked, bounds), grid_size)
    sums = clusters.groupBy(KEY).agg(
        F.max("area").alias("largest_cluster_area"),
        F.sum("area").alias("total_open_area"),
        F.count("*").alias("num_clusters"),
    )
    places = (locations if locations is not None else buildings).select(KEY).distinct()
    ratio = F.coalesce(F.try_divide("largest_cluster_area", "total_open_area"), F.lit(0.0))
    return (
        places.join(sums, KEY, "left")
        .fillna(0)
        .select(
            KEY,
            ratio.alias("permeability"),
            "largest_cluster_area",
            "total_open_area",
            "num_clusters",
            F.lit(PERCOLATION_THRESHOLD).alias("percolation_threshold"),
        )
    )


def permeability_b(buildings: DataFrame, roads: DataFrame, resolution: float = 50.0) -> DataFrame:
    """Largest cluster of occupied cells over all cells; 0 without buildings or roads."""
    shapes = footprints(buildings)
    bounds = gr.frame(shapes)
    size = F.lit(resolution)
    occupied = (
        shapes.join(bounds, KEY)
        .select(
            KEY,
            F.floor((F.col("cx") - F.col("fx0")) / size).alias("ix"),
            F.floor((F.col("cy") - F.col("fy0")) / size).alias("iy"),
        )
        .distinct()
    )
    largest = (
        gr.percolation_clusters(occupied, resolution).groupBy(KEY).agg(F.max("cells").alias("most"))
    )
    cells = (F.floor((F.col("fx1") - F.col("fx0")) / size) + 1) * (
        F.floor((F.col("fy1") - F.col("fy0")) / size) + 1
    )
    with_roads = roads.select(KEY).distinct().withColumn("has_roads", F.lit(True))
    value = F.least(F.lit(1.0), F.col("most") / cells)
    return (
        bounds.join(largest, KEY)
        .join(with_roads, KEY, "left")
        .select(
            KEY,
            F.when(F.col("has_roads"), value).otherwise(F.lit(0.0)).alias("permeability"),
        )
    )


# --- resilience ---------------------------------------------------------------------------


def materialised(network: Network) -> Network:
    """The tables of a network, computed once for the several analyses that read them."""
    return Network(cut(network.nodes), cut(network.edges))


def network_metrics(network: Network) -> DataFrame:
    """Fiedler value and the accompanying measures of each location's graph."""
    nodes, edges = materialised(network)
    parts = cut(connected_components(nodes, edges))
    stats = cut(gp.path_statistics(nodes, edges, parts))
    fiedler = gp.graph_fiedler(nodes, gp.component_fiedler(nodes, edges, components=parts))
    return _metrics(gp.graph_density(nodes, edges), fiedler, gp.clustering(nodes, edges), stats)


def _metrics(density: DataFrame, fiedler: DataFrame, clustering: DataFrame, stats: DataFrame) -> DataFrame:
    means = (
        gp.betweenness(stats)
        .join(gp.closeness(stats), [KEY, "node"])
        .join(clustering, [KEY, "node"])
        .groupBy(KEY)
        .agg(
            F.avg("clustering").alias("avg_clustering"),
            F.avg("betweenness").alias("avg_betweenness"),
            F.avg("closeness").alias("avg_closeness"),
        )
    )
    hops = gp.hop_statistics(stats).withColumn(
        "largest_cc_size", F.when(~F.col("is_connected"), F.col("largest_cc_size"))
    )
    return density.join(fiedler, KEY).join(means, KEY).join(hops.drop("is_connected"), KEY)


def _table_metrics(solved: tb.Solved) -> DataFrame:
    """``network_metrics`` of the locations solved from tables."""
    n, m = F.col("size"), F.col("links")
    counts = solved.graphs.select(KEY, n.alias("num_nodes"), m.alias("num_edges"), nw.density(n, m).alias("density"))
    clustering = solved.nodes.select(KEY, "node", "clustering")
    return _metrics(counts, solved.graphs.select(KEY, "fiedler"), clustering, cut(tb.path_statistics(solved)))


def _building_metrics(buildings: DataFrame, roads: DataFrame | None = None) -> DataFrame:
    """``network_metrics`` of the building graph, or of the mixed graph if ``roads`` are given."""
    streets = None if roads is None else materialised(nw.street_part(buildings, roads))
    solved = tb.solve(buildings, 100.0, {"fiedler", "hops", "clustering", "paths", "passed"}, streets)
    found = _table_metrics(solved)
    if solved.rest is None:
        return found
    rest = nw.building_network(_within(buildings, solved.rest))
    if streets is not None:
        rest = nw.united(rest, Network(*(_within(side, solved.rest) for side in streets)))
    return found.unionByName(network_metrics(rest))


def _within(rows: DataFrame, places: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(places), KEY, "left_semi")


def mixed_fiedler(buildings: DataFrame, roads: DataFrame) -> DataFrame:
    """``location_id, resilience``: the headline of ``resilience_a`` without its other measures.

    The mixed graph holds the nodes of the other two, so wherever one of them has a value it has one and comes first.
    """
    streets = materialised(nw.street_part(buildings, roads))
    return _whole_fiedler(tb.solve(buildings, 100.0, {"fiedler"}, streets), buildings, streets).select(
        KEY, F.col("fiedler").alias("resilience")
    )


def _whole_fiedler(solved: tb.Solved, buildings: DataFrame, streets: Network | None = None) -> DataFrame:
    """``location_id, fiedler, n`` of the graph of buildings within 100 m, and of ``streets`` if given."""
    value = solved.graphs.select(KEY, "fiedler", F.col("size").alias("n"))
    if solved.rest is None:
        return value
    rest = nw.building_network(_within(buildings, solved.rest))
    if streets is not None:
        rest = nw.united(rest, Network(*(_within(side, solved.rest) for side in streets)))
    return value.unionByName(_graph_fiedler(rest))


def _graph_fiedler(network: Network) -> DataFrame:
    """``location_id, fiedler, n`` of each location's whole graph."""
    nodes, edges = materialised(network)
    n = nodes.groupBy(KEY).agg(F.count("*").alias("n"))
    return gp.graph_fiedler(nodes, gp.component_fiedler(nodes, edges)).join(n, KEY).select(KEY, "fiedler", "n")


def resilience_a(buildings: DataFrame, roads: DataFrame) -> DataFrame:
    """Measures of the road, building and mixed graphs; the headline is the first available."""
    measured = {
        "road": network_metrics(nw.road_network(roads)),
        "building": _building_metrics(buildings),
        "mixed": _building_metrics(buildings, roads),
    }
    out = None
    for name, found in measured.items():
        found = found.withColumn("resilience", F.col("fiedler")).withColumnRenamed(
            "fiedler", "fiedler_value"
        )
        named = found.select(
            KEY, *[F.col(c).alias(f"{name}_{c}") for c in found.columns if c != KEY]
        )
        out = named if out is None else out.join(named, KEY, "full")
    headline = F.coalesce(
        "mixed_resilience", "building_resilience", "road_resilience", F.lit(0.0)
    )
    return out.withColumn("resilience", headline)


def resilience_single(
    buildings: DataFrame, roads: DataFrame | None = None, network: Network | None = None
) -> DataFrame:
    """One Fiedler value: of the given graph, else the building graph, else the road graph."""
    choices = [_graph_fiedler(network)] if network is not None else []
    choices.append(_whole_fiedler(tb.solve(buildings, 100.0, {"fiedler"}), buildings))
    if roads is not None:
        choices.append(_graph_fiedler(nw.road_network(roads)))
    out, names = None, []
    for i, choice in enumerate(choices):
        value = choice.filter("n > 1").select(KEY, F.col("fiedler").alias(f"f{i}"))
        names.append(f"f{i}")
        out = value if out is None else out.join(value, KEY, "full")
    return out.select(KEY, F.coalesce(*names, F.lit(0.0)).alias("resilience"))


def resilience_b(network: Network) -> DataFrame:
    """Smallest Fiedler value over the components with an edge, a tenth of it, within [0, 1]."""
    nodes, edges = materialised(network)
    least = gp.component_fiedler(nodes, edges).groupBy(KEY).agg(F.min("fiedler").alias("f"))
    value = F.when(F.col("f").isNotNull(), _clip(F.col("f") / 10.0, 0.0, 1.0)).otherwise(0.0)
    return nodes.select(KEY).distinct().join(least, KEY, "left").select(KEY, value.alias("resilience"))


# --- emergence ----------------------------------------------------------------------------

CENTRALITIES = ["betweenness", "closeness", "eigenvector"]


def _centrality(nodes: DataFrame, edges: DataFrame, method: str) -> DataFrame:
    if method == "eigenvector":
        return gp.eigenvector(nodes, edges)
    stats = gp.path_statistics(nodes, edges, hops=False, dependency=method == "betweenness")
    return gp.betweenness(stats) if method == "betweenness" else gp.closeness(stats)


def _building_centrality(buildings: DataFrame, distance: float, method: str) -> DataFrame:
    """The same of the graph of buildings within ``distance``, listing pairs only where no table holds a location."""
    asked = {"eigenvector": {"eigenvector"}, "closeness": {"paths"}, "betweenness": {"paths", "passed"}}[method]
    solved = tb.solve(buildings, distance, asked)
    if method == "eigenvector":
        scores = solved.nodes.select(KEY, "node", "eigenvector")
    elif method == "closeness":
        scores = gp.closeness(tb.path_statistics(solved, dependency=False))
    else:
        scores = gp.betweenness(cut(tb.path_statistics(solved)))
    if solved.rest is None:
        return scores
    rest = buildings.join(F.broadcast(solved.rest), KEY, "left_semi")
    return scores.unionByName(_centrality(*materialised(nw.building_network(rest, distance)), method))


def emergence_a(
    buildings: DataFrame,
    network: Network | None = None,
    method: str = "betweenness",
    density_method: str = "gaussian",
    radius: float = 200.0,
    reach: float = 200.0,
) -> DataFrame:
    """Mean of centrality / (1 + density) over open points and the three centrality types.

    Only ``method`` is computed; the other types, and points with no node within ``reach``, count
    as zeros. The graph defaults to buildings within 200 m of one another.
    """
    nodes = nw.building_nodes(buildings) if network is None else cut(network.nodes)
    points = cut(px.open_points(buildings))
    order = F.col("node_type").alias("kind"), F.length("node").alias("len"), F.col("node").alias("name")
    ranked = nodes.withColumn("node_order", F.struct(*order))
    nearest = cut(px.nearest_node(points, ranked, reach, ("px", "py")))
    # No other location's scores meet a point, and a graph's scores depend on its own location alone.
    asked = nearest.select(KEY).distinct()
    if network is None:
        scores = _building_centrality(_within(buildings, asked), 200.0, method)
    else:
        scores = _centrality(*(cut(_within(side, asked)) for side in (nodes, network.edges)), method)
    dense = px.building_density(points, buildings, radius, density_method)
    scored = (
        dense.join(nearest.select(KEY, "px", "py", "node"), [KEY, "px", "py"], "left")
        .join(scores, [KEY, "node"], "left")
        .withColumn("c", F.coalesce(method, F.lit(0.0)))
    )
    kinds = len(CENTRALITIES)
    sums = scored.groupBy(KEY).agg(
        (F.sum(F.col("c") / (1 + F.col("density"))) / (F.count("*") * kinds)).alias("emergence"),
        F.count("*").alias("num_open_spaces"),
        (F.count("*") * kinds).alias("num_emergence_scores"),
        *[
            (F.avg("c") if k == method else F.lit(0.0)).alias(f"mean_{k}") for k in CENTRALITIES
        ],
    )
    return buildings.select(KEY).distinct().join(sums, KEY, "left").fillna(0)


def emergence_b(buildings: DataFrame, network: Network) -> DataFrame:
    """Mean degree centrality × buildings per square metre × 1000, at most 1."""
    shapes = footprints(buildings)
    area = (F.max("x_max") - F.min("x_min")) * (F.max("y_max") - F.min("y_min"))
    built = shapes.groupBy(KEY).agg(F.count("*").alias("b"), area.alias("area"))
    # The mean over nodes of degree/(n − 1) needs the two counts only.
    counts = gp.graph_density(network.nodes, network.edges)
    n, m = F.col("num_nodes"), F.col("num_edges")
    mean = F.when(n > 1, F.lit(2.0) * m / (n * (n - 1))).otherwise(F.lit(1.0))
    density = F.when(F.col("area") > 0, F.col("b") / F.col("area")).otherwise(F.lit(0.0))
    return built.join(counts, KEY).select(
        KEY, F.least(F.lit(1.0), mean * density * 1000).alias("emergence")
    )


# --- all together -------------------------------------------------------------------------

# The row reported when a location could not be computed.
DEFAULT_ROW = {
    "sparsity": 0.5, "resilience": 0.5, "multi_nodality": 0.5, "permeability": 0.5,
    "emergence": 0.5, "overlap": 0.0,
}


def all_indicators(
    buildings: DataFrame,
    roads: DataFrame,
    locations: DataFrame | None = None,
    missing: str = "drop",
    overlap_mode: str = "documented",
) -> DataFrame:
    """The result table: six batch indicators per location.

    A location without any feature is dropped, or gets the default row (``missing='default'``).
    """
    network = materialised(nw.urban_network(buildings, roads))
    parts = {
        "sparsity": sparsity_b(buildings),
        "resilience": resilience_b(network),
        "multi_nodality": multi_nodality_b(buildings),
        "permeability": permeability_b(buildings, roads),
        "emergence": emergence_b(buildings, network),
        "overlap": ov.overlap(buildings, overlap_mode),
    }
    with_features = buildings.select(KEY).union(roads.select(KEY)).distinct()
    out = with_features
    for name, df in parts.items():
        out = out.join(df.select(KEY, name), KEY, "left").fillna(0.0, [name])
    if locations is None:
        return out
    kept = locations.join(out, KEY, "inner" if missing == "drop" else "left")
    return kept if missing == "drop" else kept.fillna(DEFAULT_ROW)


def detailed_indicators(
    buildings: DataFrame, roads: DataFrame, road_mode: str = "crossed", overlap_mode: str = "documented"
) -> DataFrame:
    """The detailed variants side by side, with the sizes of the data behind them."""
    network = materialised(nw.urban_network(buildings, roads))
    counts = gp.graph_density(*network).select(
        KEY, F.col("num_nodes").alias("network_nodes"), F.col("num_edges").alias("network_edges")
    )
    parts = [
        sparsity_a(buildings).select(KEY, "sparsity", "fractal_dimension"),
        multi_nodality_a(buildings).select(KEY, "multi_nodality", "num_cores"),
        permeability_a(buildings, roads, road_mode=road_mode).select(KEY, "permeability", "num_clusters"),
        emergence_a(buildings, network).select(KEY, "emergence", "num_open_spaces"),
        mixed_fiedler(buildings, roads),
        ov.overlap(buildings, overlap_mode).select(KEY, "overlap"),
        buildings.groupBy(KEY).agg(F.count("*").alias("buildings")),
        roads.groupBy(KEY).agg(F.count("*").alias("roads")),
    ]
    out = counts
    for part in parts:
        out = out.join(part, KEY, "left")
    return out
