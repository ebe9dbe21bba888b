"""Building graphs solved from tables of gaps, against the routes over listed links."""

import math
import random

import numpy as np
import pytest

from tessera.operators import graph
from tessera.operators import networks as nw
from tessera.operators import tables
from tessera.plans import indicators as ind

BUILDINGS = "location_id long, building_id long, type string, area_m2 double, ring array<struct<x:double,y:double>>"
ROADS = "location_id long, road_id long, type string, width double, path array<struct<x:double,y:double>>"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


@pytest.fixture(scope="module")
def town(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        x, y = rng.uniform(0, 30), rng.uniform(0, 30)  # crowded, with overlaps
        if i % 4 == 0:
            x, y = rng.uniform(-300, 300), rng.uniform(-300, 300)
        rows.append((i % 3, i, "x", 20.0, box(x, y, rng.uniform(1, 9), rng.uniform(1, 9))))
    rows.append((2, 900, "x", 9.0, [(40.0, 0.0), (50.0, 10.0), (40.0, 20.0), (30.0, 10.0), (40.0, 0.0)]))  # no box
    rows += [(4, 901, "x", 9.0, box(0.0, 0.0, 5.0, 5.0)), (4, 902, "x", 9.0, box(900.0, 0.0, 5.0, 5.0))]
    roads = [(p, 10 * p + k, "y", 5.0, [(60.0 * k, 0.0), (60.0 * k, 60.0), (60.0 * k + 60, 60.0)]) for p in (0, 2, 7) for k in range(3)]
    return spark.createDataFrame(rows, BUILDINGS), spark.createDataFrame(roads, ROADS)


@pytest.fixture
def listed(monkeypatch):
    seen, inner = [], nw.building_network
    monkeypatch.setattr(nw, "building_network", lambda df, *a: seen.append({r[0] for r in df.select("location_id").distinct().collect()}) or inner(df, *a))
    return seen


def same(got, want, key=lambda r: r.location_id):
    got, want = ({key(r): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and got
    for k, row in want.items():
        assert got[k].keys() == row.keys()
        for c, v in row.items():
            assert got[k][c] == v or math.isclose(got[k][c], v, rel_tol=1e-8, abs_tol=1e-12), (k, c, got[k][c], v)


@pytest.mark.parametrize("mixed", [False, True])
def test_metrics_from_tables(town, listed, mixed):
    buildings, roads = town
    want = ind.network_metrics(nw.mixed_network(buildings, roads) if mixed else nw.building_network(buildings))
    del listed[:]
    got = ind._building_metrics(buildings, roads if mixed else None)
    assert listed == [{2}]  # only the location with a ring that is no box
    same(got.select(want.columns), want)


@pytest.mark.parametrize("method", ind.CENTRALITIES)
def test_emergence_from_tables(town, listed, method):
    buildings, _ = town
    want = ind.emergence_a(buildings, nw.building_network(buildings, 200.0), method)
    del listed[:]
    got = ind.emergence_a(buildings, method=method)
    assert listed == [{2}]
    same(got, want)
    assert any(r.emergence > 0 for r in got.collect())


def test_resilience_from_tables(town, listed, monkeypatch):
    buildings, roads = town
    headline = ind.resilience_a(buildings, roads).select("location_id", "resilience")
    del listed[:]
    same(ind.mixed_fiedler(buildings, roads), headline)
    got = ind.resilience_single(buildings, roads)
    assert all(places == {2} for places in listed)
    monkeypatch.setattr(graph, "SMALL_COMPONENT", 1)  # every location of two nodes goes through its links
    del listed[:]
    want = ind.resilience_single(buildings, roads)
    assert listed == [{0, 1, 2, 4}]
    same(got, want)


def test_table_kernels():
    rng = np.random.default_rng(3)
    near = np.triu(rng.random((300, 300)) < 0.008, 1)
    near |= near.T
    root = tables.part_roots(near)
    total, most = tables.hop_sums(near, rng.permutation(300))
    want = [graph._walk(np.array([s]), 300, *walkable(near))[0] for s in range(300)]
    assert [set(np.flatnonzero(d >= 0)) for d in want] == [set(np.flatnonzero(root == r)) for r in root]
    assert [d[d > 0].sum() for d in want] == total.tolist() and [d.max() for d in want] == most.tolist()


def walkable(near):
    u, v = np.nonzero(near)
    count = np.bincount(u, minlength=len(near))
    return v, np.cumsum(count) - count, count


@pytest.mark.parametrize("given", [False, True])
def test_only_locations_with_open_points_are_scored(town, spark, monkeypatch, given):
    """A location whose buildings leave no open point needs no paths, whatever its size."""
    buildings, _ = town
    full = [(9, 2000 + i, "x", 20.0, box(20.0 * (i % 6), 20.0 * (i // 6), 5.0, 5.0)) for i in range(36)]
    both = buildings.unionByName(spark.createDataFrame(full, BUILDINGS))
    want = ind.emergence_a(buildings)
    seen, inner = [], ind._centrality if given else ind._building_centrality

    def scored(first, *more):
        seen.extend(r[0] for r in first.select("location_id").distinct().collect())
        return inner(first, *more)

    monkeypatch.setattr(ind, "_centrality" if given else "_building_centrality", scored)
    got = ind.emergence_a(both, nw.building_network(both, 200.0) if given else None)
    assert 9 not in seen and seen
    same(got.filter("location_id <> 9"), want)
    assert got.filter("location_id = 9").first().asDict() == {**dict.fromkeys(got.columns, 0), "location_id": 9}
