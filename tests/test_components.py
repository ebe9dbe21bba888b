"""Both routes of connected components against a plain union-find."""

import random

import pytest

from tessera.operators.components import component_labels, connected_components


def expected(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("finish_edges", [0, 30, 10**6])
def test_labels(spark, finish_edges):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(60)]
    blobs = [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)]
    star = [(300, 301 + i) for i in range(20)]
    edges = [e for e in chain + blobs + star if e[0] != e[1]]
    rows = [(k, *e) for k in (1, 2) for e in edges]
    df = spark.createDataFrame(rows, "location_id long, src long, dst long")
    want = expected({n for e in edges for n in e}, edges)
    got = component_labels(df, finish_edges).collect()
    assert len(got) == 2 * len(want)
    assert all(want[r.u] == r.component for r in got)


def test_lone_nodes(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "location_id long, node string")
    edges = spark.createDataFrame([(1, "b", "c", 1.0)], "location_id long, src string, dst string, weight double")
    got = {r.node: r.component for r in connected_components(nodes, edges).collect()}
    assert got == {"a": "a", "b": "b", "c": "b"}
    assert {r.component for r in connected_components(nodes, edges.limit(0)).collect()} == set("abc")


def test_edges_are_worked_out_once(spark):
    """The edges of a network come from joins; both directions must not repeat them."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "location_id long, src string, dst string")
    labels = component_labels(edges.mapInArrow(watched, edges.schema)).collect()
    assert {(r.u, r.component) for r in labels} == {(n, "a") for n in "abc"}
    assert seen.value == 2
