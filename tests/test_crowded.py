"""Components with very many links: by tables of their nodes, against the routes over their links."""

import math
import random

import pytest

from tessera.operators import graph
from tessera.operators.networks import Network


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(12)
    edges, nodes = [], []
    for place, n in ((1, 40), (2, 25)):
        spots = [(rng.uniform(0, 30), rng.uniform(0, 10), rng.uniform(0, 3)) for _ in range(n)]
        nodes += [(place, f"n{i:02}") for i in range(n)]
        for i, (x, y, r) in enumerate(spots):
            for j, (p, q, t) in enumerate(spots[:i]):
                gap = max(0.0, math.hypot(x - p, y - q) - r - t)
                if gap < 12:
                    edges.append((place, f"n{j:02}", f"n{i:02}", gap))
    nodes.append((3, "lone"))
    assert sum(e[3] == 0 for e in edges) > 20
    return Network(
        spark.createDataFrame(nodes, "location_id long, node string"),
        spark.createDataFrame(edges, "location_id long, src string, dst string, weight double"),
    )


def test_paths_of_crowded_components(crowd, monkeypatch):
    columns = ["reach", "dist_sum", "hop_sum", "hop_max", "dependency"]

    def rows(**asked):
        found = graph.path_statistics(*crowd, **asked)
        kept = [c for c in columns if c in found.columns]
        return kept, {(r.location_id, r.node): [float(r[c]) for c in kept] for r in found.collect()}

    _, plain = rows()
    calls = []
    inner = graph._crowded_paths
    monkeypatch.setattr(graph, "_crowded_paths", lambda *a: calls.append(a) or inner(*a))
    monkeypatch.setattr(graph, "CROWDED_NODES", 3)
    monkeypatch.setattr(graph, "CROWDED_LINKS", 1)
    for asked in ({}, {"hops": False}, {"hops": False, "dependency": False}):
        kept, crowded = rows(**asked)
        assert crowded.keys() == plain.keys() and len(kept) == 5 - 2 * ("hops" in asked) - ("dependency" in asked)
        for k, got in crowded.items():
            want = [plain[k][columns.index(c)] for c in kept]
            assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(want, got)), (k, want, got)
    assert len(calls) == 3


def test_fiedler_of_crowded_components(crowd, monkeypatch):
    edges = crowd.edges.filter("weight > 0")

    def found(**kwargs):
        return {(r.location_id, r.component): r.fiedler for r in graph.component_fiedler(crowd.nodes, edges, **kwargs).collect()}

    want = found()
    monkeypatch.setattr(graph, "_large_fiedler", None)  # not reached
    got = found(small=100)
    assert got.keys() == want.keys() and len(want) >= 2
    assert all(math.isclose(got[k], v, rel_tol=1e-8) for k, v in want.items())


def test_eigenvectors_of_thousands_of_nodes_stay_in_a_task(spark, monkeypatch):
    """A star of 2,000 leaves: the centre has the root of the leaves' number times a leaf's value."""
    edges = spark.range(2000).selectExpr("1L AS location_id", "'hub' AS src", "concat('leaf', id) AS dst", "1.0D AS weight")
    nodes = edges.selectExpr("location_id", "dst AS node").union(spark.sql("SELECT 1L, 'hub'"))
    monkeypatch.setattr(graph, "_large_eigenvector", None)  # not reached
    found = {r.node: r.eigenvector for r in graph.eigenvector(nodes, edges, rounds=300).collect()}
    assert len(found) == 2001 and math.isclose(found["hub"], math.sqrt(0.5), rel_tol=1e-3)
    assert math.isclose(found["hub"], math.sqrt(2000) * found["leaf7"], rel_tol=1e-3)
