"""Hand-computed graphs, and the join-based routes against the in-task ones."""

import math

import numpy as np
import pandas as pd
import pytest

from tessera.operators import graph
from tessera.operators.networks import Network

# location -> (nodes, edges)
GRAPHS = {
    1: ("abc", [("a", "b", 1.0), ("b", "c", 1.0)]),
    2: ("abcd", [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 1.0)]),
    3: ("abcde", [(x, y, 1.0) for i, x in enumerate("abcde") for y in "abcde"[i + 1 :]]),
    4: ("habcd", [(x, "h", 2.0) for x in "abcd"]),
    5: ("abcd", [("a", "b", 1.0), ("c", "d", 1.0)]),
    6: ("ab", [("a", "b", 0.0)]),
    7: ("abcd", [("a", "b", 0.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 2.0)]),
}


@pytest.fixture(scope="module")
def network(spark):
    nodes = [(k, n) for k, (names, _) in GRAPHS.items() for n in names]
    edges = [(k, *sorted(e[:2]), e[2]) for k, (_, es) in GRAPHS.items() for e in es]
    return Network(
        spark.createDataFrame(nodes, "location_id long, node string"),
        spark.createDataFrame(edges, "location_id long, src string, dst string, weight double"),
    )


def values(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def test_fiedler(network):
    parts = graph.component_fiedler(*network)
    whole = values(graph.graph_fiedler(network.nodes, parts), "location_id", "fiedler")
    for place, want in {1: 1.0, 2: 2.0, 3: 5.0, 4: 2.0, 5: 0.0, 6: 0.0}.items():
        assert math.isclose(whole[(place,)], want, abs_tol=1e-9)
    per_part = [r.fiedler for r in parts.filter("location_id = 5").collect()]
    assert all(math.isclose(v, 2.0) for v in per_part) and len(per_part) == 2


def test_fiedler_by_joins(network, spark):
    """Components past the bound of a task, against the route inside tasks."""
    street = [(9, f"s{k:02}", f"s{k + 1:02}", 1.0 + k % 3) for k in range(3)]
    street = spark.createDataFrame(street, "location_id long, src string, dst string, weight double")
    some = "location_id IN (2, 4)"
    nodes = network.nodes.filter(some).union(street.selectExpr("location_id", "explode(array(src, dst)) AS node").distinct())
    edges = network.edges.filter(some).union(street)
    one, two = (
        values(graph.component_fiedler(nodes, edges, small=small), "location_id", "component", "fiedler")
        for small in (graph.SMALL_EDGES, 2)
    )
    assert set(one) == set(two) and all(math.isclose(one[k], two[k], rel_tol=1e-8, abs_tol=1e-9) for k in one)


def test_fiedler_of_large_components(spark):
    """Where the closed form is known: a path and a lattice, past any size solved densely."""
    path = [(1, f"p{k:04}", f"p{k + 1:04}", 1.0) for k in range(1599)]
    lattice = [(2, f"{i:02}.{j:02}", f"{i + 1:02}.{j:02}", 1.0) for i in range(99) for j in range(100)]
    lattice += [(2, f"{i:02}.{j:02}", f"{i:02}.{j + 1:02}", 1.0) for i in range(100) for j in range(99)]
    edges = spark.createDataFrame(path + lattice, "location_id long, src string, dst string, weight double")
    nodes = edges.selectExpr("location_id", "explode(array(src, dst)) AS node").distinct()
    got = values(graph.component_fiedler(nodes, edges), "location_id", "fiedler")
    for place, n in {1: 1600, 2: 100}.items():
        assert math.isclose(got[(place,)], 2 - 2 * math.cos(math.pi / n), rel_tol=1e-8)


def test_edges_shorter_than_a_float_step_end(spark):
    edges = [(1, "a", "b", 5000.0), (1, "b", "c", 1.9e-9), (1, "c", "d", 5000.0)]
    frame = spark.createDataFrame(edges, "location_id long, src string, dst string, weight double")
    nodes = spark.createDataFrame([(1, n) for n in "abcd"], "location_id long, node string")
    for size in (1500, 1):
        stats = graph.path_statistics(nodes, frame, small=size)
        hub = values(graph.betweenness(stats), "location_id", "node", "betweenness")
        assert math.isclose(hub[(1, "b")], 2 / 3) and math.isclose(hub[(1, "c")], 2 / 3)
        assert hub[(1, "a")] == hub[(1, "d")] == 0.0


def test_paths(network):
    stats = graph.path_statistics(*network)
    hub = values(graph.betweenness(stats), "location_id", "node", "betweenness")
    assert math.isclose(hub[(4, "h")], 1.0)
    assert math.isclose(hub[(1, "b")], 1.0)
    assert math.isclose(hub[(2, "a")], 1 / 6)
    near = values(graph.closeness(stats), "location_id", "node", "closeness")
    assert math.isclose(near[(1, "b")], 1.0)
    assert math.isclose(near[(4, "h")], 0.5)
    assert math.isclose(near[(5, "a")], 1 / 3)
    hops = {r.location_id: r for r in graph.hop_statistics(stats).collect()}
    assert hops[2].diameter == 2 and math.isclose(hops[2].avg_path_length, 4 / 3)
    assert hops[5].largest_cc_size == 2 and not hops[5].is_connected


def test_paths_by_joins(network):
    def rows(df):
        cols = ["reach", "dist_sum", "hop_sum", "hop_max", "dependency"]
        return {(r.location_id, r.node): [float(r[c]) for c in cols] for r in df.collect()}

    direct = rows(graph.path_statistics(*network))
    joined = rows(graph.path_statistics(*network, small=1))
    assert direct.keys() == joined.keys()
    for k, want in direct.items():
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(want, joined[k])), (k, want, joined[k])


def test_clustering_and_degree(network):
    local = values(graph.clustering(*network), "location_id", "node", "clustering")
    assert all(math.isclose(local[(3, n)], 1.0) for n in "abcde")
    assert local[(2, "a")] == 0.0
    assert math.isclose(local[(7, "c")], 1 / 3)
    centre = values(graph.degree_centrality(network), "location_id", "node", "degree_centrality")
    assert math.isclose(centre[(4, "h")], 1.0)


def test_eigenvector(network):
    found = values(graph.eigenvector(*network), "location_id", "node", "eigenvector")
    assert all(math.isclose(found[(3, n)], 1 / math.sqrt(5), abs_tol=1e-5) for n in "abcde")
    only = [df.filter("location_id in (1, 3)") for df in network]
    joined = values(graph.eigenvector(*only, small=0), "location_id", "node", "eigenvector")
    assert joined.keys() == {k for k in found if k[0] in (1, 3)}
    assert all(math.isclose(found[k], v, abs_tol=1e-9) for k, v in joined.items())


def test_robustness(network):
    order = graph.removal_order(network, "degree")
    found = values(graph.robustness(network, order), "location_id", "critical_fraction")
    assert math.isclose(found[(1,)], 1 / 3)
    assert math.isclose(found[(4,)], 1 / 5)
    assert found[(3,)] == 0.0  # complete graphs never disconnect
    assert found[(5,)] == 0.0  # disconnected to begin with
    # cycle: removing a leaves the path b-c-d, removing b keeps c-d
    assert found[(2,)] == 0.0


def test_fiedler_of_two_stars_with_many_leaves():
    """Solves whose remainder is rounding alone."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        weights = np.append(60.0, np.round(rng.uniform(1, 100, 751), 1)[1:])
        ends = ["h0"] + [f"h{k}" for k in rng.integers(0, 2, 750)], ["h1"] + [f"s{k}" for k in range(750)]
        frame = {"u": ends[0] + ends[1], "v": ends[1] + ends[0], "w": np.r_[weights, weights]}
        found = graph._component_fiedler(pd.DataFrame({"location_id": 1, "component": "h0", **frame}))
        codes, names = pd.factorize(pd.Series(frame["u"] + frame["v"]))
        half = len(codes) // 2
        matrix = np.zeros((len(names), len(names)))
        np.add.at(matrix, (codes[:half], codes[half:]), -frame["w"])
        np.fill_diagonal(matrix, -matrix.sum(axis=1))
        assert math.isclose(found.fiedler[0], np.linalg.eigvalsh(matrix)[1], rel_tol=1e-8)


def test_type_counts_need_no_components(network, monkeypatch):
    from tessera.operators import networks

    def never(*args):
        raise AssertionError("components are not asked for")

    monkeypatch.setattr(networks, "connected_components", never)
    typed = Network(network.nodes.selectExpr("*", "'building' AS node_type"), network.edges.selectExpr("*", "'road' AS edge_type"))
    rows = {r.location_id: r for r in networks.type_counts(typed).collect()}
    assert (rows[3].num_nodes, rows[3].num_edges, rows[3].edges_by_type) == (5, 10, {"road": 10})
