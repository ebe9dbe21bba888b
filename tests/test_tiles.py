"""Fiedler values of building graphs from tiles, against dense tables and the routes that existed before."""

import numpy as np
import pytest
from test_tables import BUILDINGS, ROADS, box, listed, same, town  # noqa: F401

from tessera.operators import graph, tables, tiles
from tessera.operators import networks as nw
from tessera.plans import indicators as ind


def dense(boxes, links, distance):
    table = tables.gap_table(boxes, distance)
    near = np.isfinite(table)
    table[~near] = 0.0
    for a, b, w in zip(*links):
        table[a, b] = table[b, a] = w
        near[a, b] = near[b, a] = True
    values = np.linalg.eigvalsh(np.diag(table.sum(axis=1)) - table)
    return values[1], int(near.sum()) // 2, table


@pytest.mark.parametrize("seed, wide, crossings", [(0, 300, 0), (1, 900, 40), (2, 60, 0), (3, 2000, 3)])
def test_value_of_a_town(seed, wide, crossings):
    rng = np.random.default_rng(seed)
    low = np.r_[rng.uniform(0, 40, (500, 2)), rng.uniform(0, wide, (200, 2)), np.c_[np.arange(0, wide, 60), np.full(-(-wide // 60), 20.0)]]
    boxes = np.c_[low, low + rng.uniform(1, 8, low.shape)]
    spots = rng.uniform(0, wide, (crossings, 2))
    places = np.r_[boxes[:, :2], spots]
    solid = np.r_[boxes, np.full((crossings, 4), np.nan)]
    joined = [(len(boxes) + k, int(rng.integers(0, len(boxes))), rng.uniform(1, 50)) for k in range(crossings) for _ in range(3)]
    joined = {(a, b): w for a, b, w in joined}
    a, b = (np.array([k[i] for k in joined], int) for i in (0, 1))
    links = a, b, np.array(list(joined.values()), float)
    order = rng.permutation(len(solid))  # the order of the nodes is not that of their places
    place = np.argsort(order)
    links = place[links[0]], place[links[1]], links[2]
    want, count, table = dense(solid[order], links, 100.0)
    got, found = tiles.fiedler(solid[order], places[order], links, 100.0)
    assert found == count
    assert tiles.whole(solid[order], links, 100.0) == (not tables.part_roots(table > 0).any())
    assert np.isclose(got, max(want, 0.0), rtol=1e-9, atol=1e-9)


def test_odd_towns():
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)

    def value(rows, links=none):
        boxes = np.array(rows, float)
        return tiles.fiedler(boxes, boxes[:, :2], links, 100.0)

    assert value([[0, 0, 5, 5]]) == (0.0, 0)
    assert value([[0, 0, 5, 5], [5, 0, 9, 5]]) == (0.0, 1)  # they touch: connected, but without weight
    assert np.isclose(value([[0, 0, 5, 5], [8, 0, 9, 5]])[0], 6.0)
    assert value([[0, 0, 5, 5], [8, 0, 9, 5], [900, 0, 905, 5]])[0] == 0.0
    # A far building whose one link is very short is the slowest part, beside a neighbour in its own cell.
    rows = [[3 * k, 0, 3 * k + 1, 1] for k in range(400)] + [[1300, 0, 1301, 1], [1297.9, 0, 1299.999, 1]]
    assert np.isclose(value(rows)[0], dense(np.array(rows, float), none, 100.0)[0], rtol=1e-9)


def test_larger_locations_list_no_pairs(town, listed, monkeypatch):  # noqa: F811
    buildings, roads = town
    want = [f(buildings, roads).collect() for f in (ind.resilience_single, ind.mixed_fiedler)]
    monkeypatch.setattr(graph, "SMALL_COMPONENT", 30)  # every location but one goes past it
    del listed[:]
    got = [f(buildings, roads).collect() for f in (ind.resilience_single, ind.mixed_fiedler)]
    assert all(places == {2} for places in listed)  # only the location with a ring that is no box
    for one, two in zip(want, got):
        one, two = (dict(map(tuple, rows)) for rows in (one, two))
        assert one.keys() == two.keys() and all(np.isclose(one[k], two[k], rtol=1e-8, atol=1e-12) for k in one)


def test_trees_on_few_nodes_are_solved_exactly(monkeypatch):
    """Stars and longer trees on a ring, with weights of very different sizes, without a single inner iteration."""
    import pandas as pd

    monkeypatch.setattr(graph, "_inverse_apply", lambda *args: pytest.fail("an inner iteration"))
    for seed, ring in ((0, 12), (1, 1), (2, 2), (3, 40)):
        rng = np.random.default_rng(seed)
        links = {(k, (k + 1) % ring): rng.uniform(10, 60) for k in range(ring)} if ring > 2 else {(0, 1): 30.0} if ring == 2 else {}
        for k in range(ring, 900):
            on = int(rng.integers(0, ring if k < 700 else k))
            links[(on, k)] = float(np.round(rng.uniform(0.05, 80), 2)) if k % 50 else 0.001
        a, b = (np.array([k[i] for k in links]) for i in (0, 1))
        w = np.array(list(links.values()))
        matrix = np.zeros((900, 900))
        matrix[a, b] = matrix[b, a] = -w
        np.fill_diagonal(matrix, -matrix.sum(axis=1))
        rows = {"u": [f"n{k}" for k in np.r_[a, b]], "v": [f"n{k}" for k in np.r_[b, a]], "w": np.r_[w, w]}
        found = graph._component_fiedler(pd.DataFrame({"location_id": 1, "component": "n0", **rows}))
        assert np.isclose(found.fiedler[0], np.linalg.eigvalsh(matrix)[1], rtol=1e-8, atol=1e-11)


def test_several_links_between_two_nodes_add_up():
    import pandas as pd

    rows = {"u": list("abab"), "v": list("baba"), "w": [1.0, 1.0, 2.0, 2.0]}
    found = graph._component_fiedler(pd.DataFrame({"location_id": 1, "component": "a", **rows}))
    assert np.isclose(found.fiedler[0], 6.0)
