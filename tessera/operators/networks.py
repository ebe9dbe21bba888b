"""Spatial networks as node and edge tables, all locations at once.

Nodes: ``location_id, node, node_type, x, y, …``; edges: ``location_id, src, dst, weight,
edge_type, …`` with ``src < dst``, one row per unordered pair. Building nodes are ``b:<id>``,
shared road nodes ``r:<x>:<y>`` in rounded units, unshared ones ``r:<road>_<vertex>``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.lineage import cut
from tessera.operators import proximity as px
from tessera.operators.components import component_sizes, connected_components

KEY = "location_id"


class Network(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def _node_key(p: Column, digits: int) -> Column:
    def unit(value: Column) -> Column:
        return F.rint(value * F.lit(float(10**digits))).cast("long").cast("string")

    return F.concat_ws(":", F.lit("r"), unit(p.x), unit(p.y))


def building_id_node(column: str = "building_id") -> Column:
    return F.concat(F.lit("b:"), F.col(column).cast("string"))


def building_nodes(buildings: DataFrame) -> DataFrame:
    return px.footprints(buildings).select(
        KEY,
        building_id_node().alias("node"),
        F.lit("building").alias("node_type"),
        F.col("cx").alias("x"),
        F.col("cy").alias("y"),
        F.col("building_id").cast("string").alias("building_id"),
        F.coalesce("type", F.lit("unknown")).alias("building_type"),
        F.coalesce("area_m2", F.lit(0.0)).alias("area"),
        F.lit(None).cast("string").alias("road_type"),
    )


def road_nodes(roads: DataFrame, digits: int) -> DataFrame:
    """One node per rounded vertex; position and type come from its first appearance."""
    order = F.struct("road_id", "vertex_index")
    return (
        roads.select(KEY, "road_id", "type", F.posexplode("path").alias("vertex_index", "p"))
        .groupBy(KEY, _node_key(F.col("p"), digits).alias("node"))
        .agg(F.min(F.struct(order.alias("o"), "p", "type")).alias("first"))
        .select(
            KEY,
            "node",
            F.col("first.o").alias("node_order"),
            F.col("first.p.x").alias("x"),
            F.col("first.p.y").alias("y"),
            F.coalesce("first.type", F.lit("unknown")).alias("road_type"),
        )
    )


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def road_edges(roads: DataFrame, digits: int) -> DataFrame:
    """Street segments between shared nodes; the first road on a pair sets weight and type.

    The weight is the length of the whole road, as the reference results have it.
    """
    parts = roads.select(
        KEY,
        "road_id",
        "type",
        g.path_length(F.col("path")).alias("length"),
        F.posexplode(g.segments(F.col("path"))).alias("i", "s"),
    )
    ends = _ordered(_node_key(F.col("s.a"), digits), _node_key(F.col("s.b"), digits))
    first = F.min(F.struct("road_id", "i", "length", "type")).alias("first")
    return (
        parts.select(KEY, *ends, "road_id", "i", "length", "type")
        .filter("src <> dst")
        .groupBy(KEY, "src", "dst")
        .agg(first)
        .select(
            KEY,
            "src",
            "dst",
            F.col("first.length").alias("weight"),
            F.lit("road").alias("edge_type"),
            F.coalesce("first.type", F.lit("unknown")).alias("road_type"),
        )
    )


def _connectors(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        KEY,
        *_ordered(building_id_node(), F.col("node")),
        F.col("distance").alias("weight"),
        F.lit("building_road_connection").alias("edge_type"),
        F.lit(None).cast("string").alias("road_type"),
    )


def _connectors_within(buildings: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """An edge for every building centroid and node within ``reach``; a building is named once, not for each pair."""
    centres = px.footprints(buildings).select(KEY, building_id_node().alias("building"), "cx", "cy")
    return px.points_within(centres, nodes.select(KEY, "node", "x", "y"), reach, ("cx", "cy")).select(
        KEY,
        *_ordered(F.col("building"), F.col("node")),
        F.col("distance").alias("weight"),
        F.lit("building_road_connection").alias("edge_type"),
        F.lit(None).cast("string").alias("road_type"),
    )


def _road_node_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        KEY,
        "node",
        F.lit("road").alias("node_type"),
        "x",
        "y",
        F.lit(None).cast("string").alias("building_id"),
        F.lit(None).cast("string").alias("building_type"),
        F.lit(None).cast("double").alias("area"),
        "road_type",
    )


def urban_network(buildings: DataFrame, roads: DataFrame, reach: float = 100.0) -> Network:
    """Buildings, streets, and a connector from each building to its nearest street node."""
    streets = road_nodes(roads, digits=2)
    links = px.connect_nearest(buildings, streets, reach)
    nodes = building_nodes(buildings).unionByName(_road_node_rows(streets))
    return Network(nodes, road_edges(roads, digits=2).unionByName(_connectors(links)))


def road_network(roads: DataFrame) -> Network:
    return Network(_road_node_rows(road_nodes(roads, digits=6)), road_edges(roads, digits=6))


def building_network(
    buildings: DataFrame, distance: float = 100.0, weight_method: str = "distance"
) -> Network:
    pairs = px.near_pairs(buildings, distance, building_id_node())
    weight = F.col("distance") if weight_method == "distance" else F.lit(1.0)
    edges = pairs.select(
        KEY,
        F.col("first").alias("src"),
        F.col("second").alias("dst"),
        weight.alias("weight"),
        F.lit("building_building").alias("edge_type"),
        F.lit(None).cast("string").alias("road_type"),
    )
    return Network(building_nodes(buildings), edges)


def street_part(buildings: DataFrame, roads: DataFrame, reach: float = 50.0) -> Network:
    """Street nodes, and the edges of the mixed network that have an end there."""
    s = road_network(roads)
    streets = road_nodes(roads, digits=6)
    return Network(s.nodes, s.edges.unionByName(_connectors_within(buildings, streets, reach)))


def united(first: Network, second: Network) -> Network:
    return Network(*(a.unionByName(b) for a, b in zip(first, second)))


def mixed_network(
    buildings: DataFrame, roads: DataFrame, distance: float = 100.0, reach: float = 50.0
) -> Network:
    """Building graph and street graph joined by every building-node pair within ``reach``."""
    return united(building_network(buildings, distance), street_part(buildings, roads, reach))


# --- networks in degrees, road vertices not shared ----------------------------------------


def _vertices(roads: DataFrame, min_vertices: int) -> DataFrame:
    return roads.filter(F.size("path") >= min_vertices).select(
        KEY,
        "road_id",
        F.size("path").alias("vertices"),
        F.posexplode("path").alias("vertex_index", "p"),
    )


def _vertex_name(road: str, index: Column) -> Column:
    return F.concat(F.lit("r:"), F.col(road).cast("string"), F.lit("_"), index.cast("string"))


def _vertex_nodes(vertices: DataFrame) -> DataFrame:
    return vertices.select(
        KEY,
        _vertex_name("road_id", F.col("vertex_index")).alias("node"),
        F.struct("road_id", "vertex_index").alias("node_order"),
        F.col("p.x").alias("x"),
        F.col("p.y").alias("y"),
        F.lit(None).cast("string").alias("road_type"),
    )


def _segment_edges(roads: DataFrame) -> DataFrame:
    parts = roads.select(KEY, "road_id", F.posexplode(g.segments(F.col("path"))).alias("i", "s"))
    ends = _ordered(
        _vertex_name("road_id", F.col("i")), _vertex_name("road_id", F.col("i") + F.lit(1))
    )
    return parts.select(
        KEY,
        *ends,
        g.gap(F.col("s.a.x") - F.col("s.b.x"), F.col("s.a.y") - F.col("s.b.y")).alias("weight"),
        F.lit("road").alias("edge_type"),
        F.lit(None).cast("string").alias("road_type"),
    )


def corrected_network(buildings: DataFrame, roads: DataFrame, reach: float = 0.001) -> Network:
    """Unshared road vertices; each building joins its nearest vertex (road ends excluded)."""
    vertices = _vertices(roads, 2)
    starts = _vertex_nodes(vertices.filter(F.col("vertex_index") < F.col("vertices") - 1))
    links = px.connect_nearest(buildings, starts, reach)
    nodes = building_nodes(buildings).unionByName(_road_node_rows(_vertex_nodes(vertices)))
    return Network(nodes, _segment_edges(roads).unionByName(_connectors(links)))


def coordinate_network(
    buildings: DataFrame, roads: DataFrame, building_reach: float = 0.002, road_reach: float = 0.001
) -> Network:
    """Near centroids, road segments, and every centroid-vertex pair within reach."""
    centres = cut(px.footprints(buildings).select(KEY, building_id_node().alias("node"), "cx", "cy"))
    pairs = px.range_join(
        px.renamed(centres, "a_"),
        px.renamed(centres, "b_"),
        building_reach,
        ("a_cx", "a_cy", "a_cx", "a_cy"),
        ("b_cx", "b_cy", "b_cx", "b_cy"),
        cell_size=px.PAIR_CELL * building_reach,
        condition=F.col("a_node") < F.col("b_node"),
        **px.PACKED,
    ).sortWithinPartitions("box_gap").select(
        KEY,
        F.col("a_node").alias("src"),
        F.col("b_node").alias("dst"),
        F.col("box_gap").alias("weight"),
        F.lit("building_connection").alias("edge_type"),
        F.lit(None).cast("string").alias("road_type"),
    )
    vertices = _vertex_nodes(_vertices(roads, 1))
    links = _connectors_within(buildings, vertices, road_reach)
    segments = _segment_edges(roads).withColumn("edge_type", F.lit("road_segment"))
    nodes = building_nodes(buildings).unionByName(_road_node_rows(vertices))
    return Network(nodes, pairs.unionByName(segments).unionByName(links))


# --- derived tables -----------------------------------------------------------------------


ENDS = {
    "building_building": {"building"},
    "building_connection": {"building"},
    "road": {"road"},
    "road_segment": {"road"},
    "building_road_connection": {"building", "road"},
}


def induced_subgraph(network: Network, node_type: str, closed: bool = False) -> Network:
    """Nodes of a type and the edges between them.

    ``closed``: the ends of every edge are nodes, as in the networks built here; then an edge's type tells
    what it joins, and only edges of other types are joined with the nodes.
    """
    nodes = network.nodes.filter(F.col("node_type") == node_type)
    ids = nodes.select(KEY, "node")
    known = F.coalesce(F.col("edge_type").isin(*ENDS), F.lit(False)) if closed else F.lit(False)
    edges = network.edges.filter(~known).join(
        ids.withColumnRenamed("node", "src"), [KEY, "src"], "left_semi"
    ).join(ids.withColumnRenamed("node", "dst"), [KEY, "dst"], "left_semi")
    edges = edges.select(network.edges.columns)
    inside = [kind for kind, ends in ENDS.items() if ends == {node_type}]
    if closed and inside:
        edges = edges.unionByName(network.edges.filter(F.col("edge_type").isin(*inside)))
    return Network(nodes, edges)


def degrees(network: Network) -> DataFrame:
    """Degree per node and the more-than-three flag."""
    ends = network.edges.select(KEY, F.explode(F.array("src", "dst")).alias("node"))
    counts = ends.groupBy(KEY, "node").agg(F.count("*").alias("degree"))
    return (
        network.nodes.select(KEY, "node")
        .join(counts, [KEY, "node"], "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
        .withColumn("is_hub", F.col("degree") > 3)
    )


def network_export(network: Network) -> Network:
    nodes = network.nodes.select(KEY, "node", "x", "y", F.coalesce("node_type", F.lit("unknown")).alias("node_type"))
    edges = network.edges.select(
        KEY,
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        F.coalesce("weight", F.lit(1.0)).alias("weight"),
        F.coalesce("edge_type", F.lit("unknown")).alias("edge_type"),
    )
    return Network(nodes, edges)


def density(n: Column, m: Column) -> Column:
    return F.when((n > 1) & (m > 0), F.lit(2.0) * m / (n * (n - 1))).otherwise(F.lit(0.0))


def counts_by_type(rows: DataFrame, kind: str, total: str, name: str) -> DataFrame:
    """``location_id``, the number of rows, and a map from each type present to its rows.

    Types are counted before anything is gathered, so a location gathers one entry for each type.
    """
    entry = F.struct(F.coalesce(kind, F.lit("")).alias("key"), F.col("n").alias("value"))
    return rows.groupBy(KEY, kind).agg(F.count("*").alias("n")).groupBy(KEY).agg(
        F.sum("n").alias(total),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name),
    )


def type_counts(network: Network) -> DataFrame:
    """Numbers of nodes and edges, whole and by every type present, one row per location."""
    nodes = counts_by_type(network.nodes, "node_type", "num_nodes", "nodes_by_type")
    edges = counts_by_type(network.edges, "edge_type", "num_edges", "edges_by_type")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return (
        nodes.join(edges, KEY, "left")
        .fillna(0, ["num_edges"])
        .withColumn("edges_by_type", F.coalesce("edges_by_type", none))
    )


def network_statistics(network: Network) -> DataFrame:
    """Sizes, density, connectivity and counts by every type present, one row per location."""
    network = Network(cut(network.nodes), cut(network.edges))
    sizes = component_sizes(connected_components(network.nodes, network.edges))
    parts = sizes.groupBy(KEY).agg(
        F.count("*").alias("num_components"), F.max("size").alias("largest_component_size")
    )
    return (
        type_counts(network)
        .join(parts, KEY)
        .withColumn("density", density(F.col("num_nodes"), F.col("num_edges")))
        .withColumn("is_connected", F.col("num_components") == 1)
    )
