"""Neighbour counts by blocks against brute force."""

import collections
import random

import numpy as np

from tessera.operators import counting
from tessera.operators import proximity as px

SCHEMA = "location_id long, building_id long, type string, area_m2 double, ring array<struct<x:double,y:double>>"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def test_blocks_count_every_pair_exactly():
    rng = np.random.default_rng(5)
    low = np.round(rng.uniform(0, 120, (3000, 2)), 1)
    a = np.hstack([low, low + rng.integers(2, 9, (3000, 2))])
    b, kind, weight = a[::2], rng.integers(0, 3, 1500), rng.integers(1, 4, 1500)
    along = [np.maximum(0, np.maximum(b[:, k] - a[:, k + 2, None], a[:, k, None] - b[:, k + 2])) for k in (0, 1)]
    near = np.sqrt(along[0] * along[0] + along[1] * along[1]) <= 50.0
    want = near @ (np.eye(3, dtype=int)[kind] * weight[:, None])
    assert (counting.count_within(a, b, kind, weight, 50.0) == want).all()


def test_neighbour_types_with_shares_wide_boxes_and_other_shapes(spark, monkeypatch):
    monkeypatch.setattr(counting, "ASKING_ROWS", 16)
    monkeypatch.setattr(counting, "COUNTED_ROWS", 24)
    rng = random.Random(2)
    rows = []
    for i in range(150):
        x, y = round(rng.uniform(-90, 90), 1), round(rng.uniform(-20, 60), 1)
        ring = box(x, y, rng.randint(2, 8), 5.0)
        if i % 25 == 0:
            ring = [(x, y), (x + 6.0, y), (x, y + 3.0), (x, y)]
        if i % 40 == 1:
            ring = box(x, y, 70.0, 4.0)
        rows.append((i % 2, i, [None, "a", "b"][i % 3], 1.0, ring))
    rows += [(*row[:1], row[1] + 1000, *row[2:]) for row in rows[:30]]
    shapes = spark.createDataFrame(rows, SCHEMA)
    pairs = px.building_proximity(shapes, 20.0).collect()
    kinds = {r[1]: r[2] for r in rows}
    want = collections.Counter((i, kind) for i, kind in kinds.items())
    for p in pairs:
        want[p.building_a, kinds[p.building_b]] += 1
        want[p.building_b, kinds[p.building_a]] += 1
    near = px.renamed(px.neighbour_types(shapes, 20.0), "n_", keep=())
    own = px.footprints(shapes)
    same = [own[c] == near["n_" + c] for c in ("location_id", *px.BOX)] + [own["shape"].eqNullSafe(near["n_shape"])]
    got = {(r.building_id, r.n_type): r.n_n for r in own.join(near, same).select("building_id", "n_type", "n_n").collect()}
    assert got == want


def test_a_crowd_is_counted_without_its_pairs(spark):
    """24,000 different boxes within reach of one another: 5.8e8 pairs."""
    rows = spark.range(24_000).selectExpr(
        "1L AS location_id", "id AS building_id", "if(id % 3 = 0, 'a', 'b') AS type", "1.0D AS area_m2",
        "double(id % 160) / 10 AS x", "double(id div 160) / 10 AS y",
    )
    corners = ", ".join(f"named_struct('x', x + {dx}, 'y', y + {dy})" for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))
    shapes = rows.selectExpr("location_id", "building_id", "type", "area_m2", f"array({corners}) AS ring")
    got = px.neighbour_types(shapes, 100.0).groupBy("type", "n").count().collect()
    assert {(r.type, r.n, r["count"]) for r in got} == {("a", 8_000, 24_000), ("b", 16_000, 24_000)}
