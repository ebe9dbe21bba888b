"""Small fixtures against brute force and hand-computed values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators import cluster as cl
from tessera.operators import grid as gr
from tessera.operators import networks as nw
from tessera.operators import ordering
from tessera.operators import proximity as px
from tessera.operators import statistics as st
from tessera.operators.range_join import range_join
from tessera.plans import indicators as ind
from tessera.sources import locations as loc
from tessera.sources import results as rs

SCHEMA = "location_id long, building_id long, type string, area_m2 double, ring array<struct<x:double,y:double>>"


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def make(spark, shapes, area=100.0, kind="residential"):
    rows = [(1, i, kind, area, ring) for i, ring in enumerate(shapes)]
    return spark.createDataFrame(rows, SCHEMA)


# --- geometry -----------------------------------------------------------------------------


def test_ring_measures(spark):
    triangle = [(0.0, 0.0), (6.0, 0.0), (0.0, 3.0), (0.0, 0.0)]
    flat = [(0.0, 0.0), (2.0, 0.0), (4.0, 0.0), (0.0, 0.0)]
    rows = px.g.measure_rings(make(spark, [square(2.0, 3.0, 4.0), triangle, flat])).orderBy("building_id").collect()
    assert (rows[0].ring_area, rows[0].cx, rows[0].cy, rows[0].is_box) == (16.0, 4.0, 5.0, True)
    assert (rows[1].ring_area, rows[1].cx, rows[1].cy, rows[1].is_box) == (9.0, 2.0, 1.0, False)
    assert (rows[2].ring_area, rows[2].cx, rows[2].cy, rows[2].is_box) == (0.0, 2.0, 0.0, False)


def test_polygon_distances(spark):
    diamond = [(10.0, 5.0), (15.0, 0.0), (20.0, 5.0), (15.0, 10.0), (10.0, 5.0)]
    big = [(-50.0, -50.0), (90.0, -50.0), (95.0, 90.0), (-50.0, 90.0), (-50.0, -50.0)]
    shapes = [square(0.0, 4.0, 2.0), diamond, square(30.0, 4.0, 2.0), big]
    pairs = px.building_proximity(make(spark, shapes), 15.0).collect()
    got = {(r.building_a, r.building_b): r.distance for r in pairs}
    assert math.isclose(got[(0, 1)], 8.0)  # edge to the diamond's tip
    assert math.isclose(got[(1, 2)], 10.0)
    assert (0, 2) not in got
    assert got[(0, 3)] == got[(1, 3)] == got[(2, 3)] == 0.0  # contained


def test_range_join_splits_hot_cells(spark):
    rng = random.Random(3)
    points = [(1, i, 0.0, 0.0) if i % 3 == 0 else (1, i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(120)]
    df = spark.createDataFrame(points, "location_id long, id long, x double, y double")
    other = df.select("location_id", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    want = {(a[1], b[1]) for a in points for b in points if math.hypot(a[2] - b[2], a[3] - b[3]) <= 10}
    for hot_rows in (5, 50_000):
        got = range_join(df, other, 10.0, "x y x y".split(), "x2 y2 x2 y2".split(), hot_rows=hot_rows).select("id", "id2").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_range_join_of_boxes_of_all_sizes(spark):
    from tessera.operators import range_join as rj

    rng = random.Random(4)
    boxes = []
    for i in range(90):
        side = rng.choice([0.0, 1.0, 9.0, 80.0, 700.0])
        x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
        boxes.append((i % 2, i, x, y, x + side, y + side * rng.random()))
    boxes += [(0, 90, -25_000.0, -25_000.0, 25_000.0, 25_000.0), (1, 91, 5000.0, 0.0, 5001.0, 40_000.0)]
    box = ["x0", "y0", "x1", "y1"]
    df = spark.createDataFrame(boxes, "location_id long, id long, x0 double, y0 double, x1 double, y1 double")
    other = df.select("location_id", F.col("id").alias("id2"), *[F.col(c).alias("o" + c) for c in box])

    def apart(a, b):
        dx = max(0.0, b[2] - a[4], a[2] - b[4])
        return math.sqrt(dx * dx + max(0.0, b[3] - a[5], a[3] - b[5]) ** 2)

    for distance in (3.0, 60.0):
        want = {(a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and apart(a, b) <= distance}
        for hot_rows in (5, 50_000):
            got = range_join(df, other, distance, box, ["o" + c for c in box], hot_rows=hot_rows).select("id", "id2").collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want
    # One footprint of 50 km among 10,000 small ones: a few rows for each, not one for each cell.
    small = spark.range(10_000).selectExpr(
        "0L AS location_id", "id", "10D * (id % 100) AS x0", "10D * (id div 100) AS y0", "10D * (id % 100) + 5 AS x1",
        "10D * (id div 100) + 5 AS y1",
    )
    both = rj._own_level(small.union(df.filter("id = 90")), box, 20.0, 20.0, "l")
    levels = [r[0] for r in both.select("_lm").distinct().collect()]
    assert rj._in_cells(both, box, 20.0, 20.0, "l", levels).count() < 200_000


def test_nearest_target_is_found_far_away(spark):
    probes = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 900.0, 0.0), (2, 3, 5.0, 5.0)], "location_id long, p long, px double, py double")
    targets = spark.createDataFrame([(1, 7, 3.0, 4.0), (1, 8, 100.0, 0.0)], "location_id long, t long, tx double, ty double")
    got = {r.p: (r.t, r.distance) for r in px.nearest_targets(probes, targets, ["p"], "t", size=1.0).collect()}
    assert got == {1: (7, 5.0), 2: (8, 800.0)}  # no target in location 2


def test_nearest_site_long_list(spark):
    sites = loc.curated_locations(spark)
    given = [(1, 35.0, 139.0), (1, 40.0, -74.0), (1, 35.0, 139.0), (2, 40.0, -74.0), (3, None, 139.0), (4, 35.0, float("nan"))]
    rows = spark.createDataFrame(given, "location_id long, latitude double, longitude double")
    short, long = (
        sorted(map(str, st.nearest_site(rows, sites, **more).select("location_id", "latitude", "site_id", "site", "radius").collect()))
        for more in ({}, {"max_sites": 3})
    )
    assert short == long and len(short) == len(given)
    found = {r.location_id: r.site for r in st.nearest_site(rows, sites).collect()}
    assert found[3] is None and found[4] is None and found[1] and found[2]


def test_nearest_targets_by_brute_force(spark):
    rng = random.Random(9)
    spots = [(p, t, rng.gauss(0, 10) + 5000 * (t % 3), rng.gauss(0, 10)) for p in (1, 2) for t in range(60)]
    spots += [(1, 200 + k, 100 * math.cos(k), 100 * math.sin(k)) for k in range(40)]  # a ring round the origin
    spots += [(1, 300, 5000.0, 0.0), (1, 301, 5000.0, 0.0), (2, 302, None, 0.0), (2, 303, math.inf, 0.0)]
    asked = [(1, 0, 0.0, 0.0), (1, 1, 5000.0, 0.0), (2, 2, 1e6, -1e6), (2, 3, None, 1.0), (3, 4, 0.0, 0.0)]
    asked += [(1 + k % 2, 5 + k, rng.uniform(-9000, 9000), rng.uniform(-50, 50)) for k in range(40)]
    probes = spark.createDataFrame(asked, "location_id long, p long, px double, py double")
    targets = spark.createDataFrame(spots, "location_id long, t long, tx double, ty double")
    want = {}
    for plane, p, x, y in asked:
        if x is None:
            continue
        near = [(math.sqrt((x - a) ** 2 + (y - b) ** 2), t) for q, t, a, b in spots if q == plane and a is not None and a < math.inf]
        if near:
            want[p] = min(near)[1]
    for size in (3.0, 50.0, 1e5):
        got = {r.p: r.t for r in px.nearest_targets(probes, targets, ["p"], "t", size=size).collect()}
        assert got == want
    assert px.nearest_targets(probes, targets.limit(0), ["p"], "t", size=5.0).count() == 0


def test_a_far_probe_meets_few_targets(spark):
    """A probe far from a dense town measures its facing edge at most, not its 40,000 buildings."""
    from tessera.operators import pyramid

    town = spark.range(40_000).selectExpr(
        "1L AS location_id", "id AS t", "10D * (id % 200) AS tx", "10D * (id div 200) AS ty"
    )
    probes = spark.createDataFrame([(1, 1, 100_000.0, 700.0)], "location_id long, p long, px double, py double")
    place = ["p"], ("tx", "ty", "tx", "ty")
    assert pyramid.candidates(probes, town, *place, 25.0, "location_id").count() < 400
    best = px.nearest_targets(probes, town, ["p"], "t", size=25.0).first()
    assert (best.t, best.distance) == (14_199, 98_010.0)


def test_draws_repeat_whatever_the_partitions(spark):
    cities = loc.seven_cities(spark).selectExpr("location_id AS city_order", "latitude", "longitude")
    wanted = spark.range(1, 60).withColumnRenamed("id", "location_id")
    n = cities.count()
    first, second = (
        sorted(tuple(r) for r in loc.sample_locations_cycle(wanted.repartition(k), cities, n).collect())
        for k in (1, 5)
    )
    assert first == second
    moved = spark.range(20_000).agg(
        F.avg(loc.drawn_normal(3, F.col("id"))).alias("m"), F.stddev(loc.drawn_normal(3, F.col("id"))).alias("s")
    ).first()
    assert abs(moved.m) < 0.03 and abs(moved.s - 1) < 0.03


# --- order and quantiles ------------------------------------------------------------------


def test_exact_quantiles(spark):
    rng = random.Random(5)
    data = {"a": [rng.gauss(0, 1) for _ in range(101)], "b": [float(rng.randrange(4)) for _ in range(50)], "c": [2.5]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = ordering.exact_quantiles(df, ["k"], "v", {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()
    for r in got:
        want = np.quantile(data[r.k], [0.25, 0.5, 0.9])
        assert np.allclose([r.q1, r.m, r.q9], want)


def test_running_positions(spark):
    df = spark.range(200).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    got = ordering.running_positions(df, ["g"], ["v"]).collect()
    assert all(r.before == r.v and r.group_total == 200 for r in got)


# --- sparsity, clustering, percolation on shapes with known answers -----------------------------


def test_dense_block(spark):
    shapes = [square(139.767 + i * 1e-4, 35.681 + j * 1e-4, 5e-5) for i in range(10) for j in range(10)]
    row = ind.sparsity_a(make(spark, shapes, area=50.0)).first()
    assert row.building_count == 100 and row.sparsity >= 0


def test_empty_and_single(spark):
    places = spark.createDataFrame([(1,)], "location_id long")
    row = ind.sparsity_a(make(spark, []), locations=places).first()
    assert (row.sparsity, row.fractal_dimension, row.building_count) == (0.0, 0.0, 0)
    row = ind.sparsity_a(make(spark, [square(139.767, 35.681, 0.001)])).first()
    assert row.building_count == 1 and row.sparsity >= 0
    row = ind.multi_nodality_a(make(spark, []), locations=places).first()
    assert (row.multi_nodality, row.num_cores) == (0.0, 0)


def test_cluster_labels(spark):
    def cores(labels):
        df = spark.createDataFrame([(1, c) for c in labels], "location_id long, cluster_id int")
        return cl.num_cores(df).first().num_cores

    assert cores([0, 0, 1, 1, -1]) == 2
    assert cores([-1, -1, -1]) == 0
    points = [(1, 0.0, 0.0, 0), (1, 1.0, 1.0, 0), (1, 2.0, 2.0, 1), (1, 3.0, 3.0, 1)]
    df = spark.createDataFrame(points, "location_id long, x double, y double, cluster_id int")
    assert cl.core_dispersion(df).first().core_dispersion == 0.0


def brute_dbscan(points, eps, k):
    near = [[j for j, q in enumerate(points) if math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) <= eps] for p in points]
    label, n = [-1] * len(points), 0
    for i in range(len(points)):
        if label[i] != -1 or len(near[i]) < k:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if label[j] != -1:
                continue
            label[j] = n
            if len(near[j]) >= k:
                stack.extend(near[j])
        n += 1
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_dbscan_against_brute_force(spark, seed):
    rng = random.Random(seed)
    points = [(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(150)]
    points += [(40.0 + rng.gauss(0, 8), 200.0 + rng.gauss(0, 8)) for _ in range(120)]
    points += [(150.0, 150.0)] * 30  # copies
    rng.shuffle(points)
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(points)], "location_id long, building_id long, x double, y double")
    got = {r.building_id: r.cluster_id for r in cl.dbscan(df, 20.0, 5).collect()}
    assert [got[i] for i in range(len(points))] == brute_dbscan(points, 20.0, 5)


def test_checkerboard(spark):
    cells = [(1, i, j) for i in range(5) for j in range(5) if (i + j) % 2 == 0]
    df = spark.createDataFrame(cells, "location_id long, ix long, iy long")
    rows = gr.percolation_clusters(df, 50.0).collect()
    assert len(rows) == 13 and all(r.cells == 1 and r.area == 2500.0 for r in rows)


def flood(cells):
    """4-connected clusters of a set of cells, by plain flooding."""
    left, sizes = set(cells), []
    while left:
        todo, size = [left.pop()], 0
        while todo:
            x, y = todo.pop()
            size += 1
            for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if near in left:
                    left.remove(near)
                    todo.append(near)
        sizes.append(size)
    return sorted(sizes)


def test_open_runs_against_flooding(spark):
    rng = random.Random(6)
    sides = {1: (17, 13, 0.5), 2: (30, 8, 0.2), 3: (9, 9, 0.0), 4: (6, 6, 1.0), 5: (0, 4, 0.0), 6: (12, 20, 0.04), 7: (1, 9, 0.4)}
    blocked, want = [], {}
    for place, (nx, ny, share) in sides.items():
        closed = {(x, y) for x in range(nx) for y in range(ny) if rng.random() < share}
        blocked += [(place, x, y) for x, y in closed]
        want[place] = flood({(x, y) for x in range(nx) for y in range(ny)} - closed)
    frames = spark.createDataFrame([(k, nx, ny) for k, (nx, ny, _) in sides.items()], "location_id long, nx long, ny long")
    runs = gr.open_runs(spark.createDataFrame(blocked, "location_id long, ix long, iy long"), frames)
    got = {}
    for r in gr.run_clusters(runs).collect():
        got.setdefault(r.location_id, []).append(r.cells)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_one_building_far_off(spark):
    """A hundred million empty cells are a few bands, not rows."""
    shapes = [square(60.0 * k, 60.0 * (k % 3), 30.0) for k in range(12)] + [square(100_000.0, 100_000.0, 30.0)]
    df = make(spark, shapes, area=900.0)
    bounds = gr.grid_frame(df, 10.0)
    runs = gr.open_runs(gr.blocked_cells(df, bounds, grid_size=50.0), bounds)
    assert runs.count() < 300
    nx, ny = bounds.select("nx", "ny").first()
    blocked = gr.blocked_cells(df, bounds, grid_size=50.0).count()
    row = ind.permeability_a(df).first()
    assert blocked > 0 and row.total_open_area == (nx * ny - blocked) * 2500.0


def test_small_grid(spark):
    cells = gr.analysis_grid(gr.grid_frame(make(spark, [square(0.0, 0.0, 40.0)]), 10.0)).collect()
    assert {(r.ix, r.iy) for r in cells} == {(i, j) for i in range(3) for j in range(3)}


def test_diagonal_road_cells(spark):
    shapes = make(spark, [square(0.0, 0.0, 100.0)])
    roads = spark.createDataFrame([(1, 1, [(5.0, 5.0), (75.0, 40.0)])], "location_id long, road_id long, path array<struct<x:double,y:double>>")
    bounds = gr.grid_frame(shapes, 10.0)
    got = {(r.ix, r.iy) for r in gr.road_cells(roads, bounds, 10.0).collect()}
    want = set()
    for t in range(100001):
        x, y = 5 + 70 * t / 100000, 5 + 35 * t / 100000
        want.add((int(x // 10), int(y // 10)))
    assert want <= got  # closed cells: corner touches count too
    assert all(any(abs(a - c) + abs(b - d) <= 1 for c, d in want) for a, b in got)


# --- result table -------------------------------------------------------------------------


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 35.0, 139.0, "x", 800, 0.1, 0.2, 0.3, 0.4, 0.5, 0.0)], rs.RESULT_SCHEMA)
    rs.write_results(df, str(tmp_path / "second"), "csv")
    rs.write_results(df, str(tmp_path / "columns"))
    read = rs.read_results(spark, str(tmp_path / "first"), str(tmp_path / "second"))
    assert read.collect() == df.collect() == spark.read.parquet(str(tmp_path / "columns")).collect()
    with pytest.raises(FileNotFoundError):
        rs.read_results(spark, str(tmp_path / "nothing"))


def test_constant_metric(spark):
    df = spark.createDataFrame([(i, float(i), 3.0) for i in range(4)], "location_id long, a double, b double")
    assert st.correlation(df, "a", "b").first().correlation is None
    out = st.normalise_minmax(df, ["a", "b"]).orderBy("location_id").collect()
    assert [r.a_normalized for r in out] == [0.0, 1 / 3, 2 / 3, 1.0] and all(r.b_normalized == 0 for r in out)


def test_nearest_node_meets_a_place_once(spark):
    """Many nodes at one place: the first by order wins, and one row stands for them in the join."""
    nodes = spark.range(400).selectExpr(
        "1L AS location_id", "concat('n', id) AS node", "400 - id AS node_order", "0.0D AS x", "cast(id % 2 AS double) AS y"
    )
    points = spark.createDataFrame([(1, 3.0, 0.0), (1, 3.0, 1.0), (1, 50.0, 0.0)], "location_id long, px double, py double")
    seen = []
    join = px.range_join

    def counted(left, *args, **kwargs):
        seen.append(left.count())
        return join(left, *args, **kwargs)

    px.range_join = counted
    try:
        found = px.nearest_node(points, nodes, 10.0, ("px", "py")).collect()
    finally:
        px.range_join = join
    assert {(r.py, r.node, r.distance) for r in found} == {(0.0, "n398", 3.0), (1.0, "n399", 3.0)} and len(found) == 2
    assert seen == [2]


def test_fixed_rounds_the_exact_value(spark):
    values = [0.0005, -0.0005, 0.00049999, 0.0006, 0.0625, 0.0015, 0.9995, -0.0001, 0.0, 0.00005, 12.3455]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 4):
        for row in rows.select("v", labels.fixed(F.col("v"), digits).alias("text")).collect():
            assert row.text == f"{row.v:.{digits}f}"


def test_pairs_are_spread_over_tasks(spark, monkeypatch):
    """A crowded table in one partition: as many tasks as its pairs need, and every pair once."""
    from tessera.operators import range_join as rj

    monkeypatch.setattr(rj, "PAIRS_PER_TASK", 2_000)
    rng = random.Random(8)
    corners = [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(150)]
    shapes = [square(x, y, 3.0) for x, y in corners]
    diamond = [(30.0, 20.0), (40.0, 10.0), (50.0, 20.0), (40.0, 30.0), (30.0, 20.0)]
    table = make(spark, [diamond, *shapes, diamond]).coalesce(1)
    pairs = px.building_proximity(table, 20.0)
    rows = pairs.withColumn("task", F.spark_partition_id()).collect()
    got = {(r.building_a, r.building_b): r.distance for r in rows}
    assert len(rows) == len(got) and len({r.task for r in rows}) > 3 and all(a < b for a, b in got)

    def apart(a, b):
        return math.hypot(*[max(0.0, abs(p - q) - 3.0) for p, q in zip(a, b)])

    boxes = {k: d for k, d in got.items() if k[0] > 0 and k[1] < 151}
    want = {(i + 1, j + 1): apart(corners[i], corners[j]) for i in range(150) for j in range(i + 1, 150)}
    assert boxes.keys() == {k for k, d in want.items() if d <= 20.0}
    assert all(math.isclose(d, want[k], abs_tol=1e-9) for k, d in boxes.items())
    assert got[(0, 151)] == 0.0  # two rings that are no boxes
    assert {j for i, j in got if i == 0 and j < 151} == {i for i, j in got if j == 151 and i > 0}
    named = nw.building_network(table, 20.0).edges.collect()
    ends = {tuple(sorted((f"b:{a}", f"b:{b}"))) for a, b in got}
    assert len(named) == len(ends) and {(r.src, r.dst) for r in named} == ends
    boxes_only = px.building_proximity(make(spark, shapes), 20.0)
    plan = boxes_only._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "transform(" not in plan  # boxes are compared without rings


def test_subgraph_of_buildings_needs_no_join_of_edges(spark):
    road = [(1, 1, "residential", 4.0, [(0.0, 0.0), (30.0, 0.0)])]
    roads = spark.createDataFrame(road, "location_id long, road_id long, type string, width double, path array<struct<x:double,y:double>>")
    network = nw.mixed_network(make(spark, [square(9.0 * k, 1.0, 2.0) for k in range(9)]), roads, 20.0)
    fast = nw.induced_subgraph(network, "building", closed=True).edges
    for kind in ("building", "road"):
        got, want = (nw.induced_subgraph(network, kind, closed).edges.collect() for closed in (True, False))
        assert sorted(map(str, got)) == sorted(map(str, want)) and got
    only = fast.filter("edge_type = 'building_building'")
    assert "LeftSemi" not in only._jdf.queryExecution().optimizedPlan().toString()
    odd = network._replace(edges=network.edges.withColumn("edge_type", F.lit("path")))
    assert nw.induced_subgraph(odd, "building", closed=True).edges.count() == fast.count()


def test_rounded_is_round(spark):
    from tessera.functions import geometry as g

    rng = random.Random(9)
    values = [0.0, -0.0, 0.5, 1.0000005, 2.5e-7, 1.5e-6, -1.5e-6, 1e300, 123456.7890125, float("nan"), float("inf"), None]
    values += [rng.uniform(-300, 300) for _ in range(3000)] + [rng.randrange(10**9) / 10**7 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (6, 12):
        found = df.select(g.rounded(F.col("v"), digits).alias("a"), F.round("v", digits).alias("b"))
        assert found.filter("NOT a <=> b").count() == 0


def test_written_pairs_come_by_distance(spark):
    """Equal distances stand together in a task's rows, so a file of pairs takes little room."""
    shapes = [square(4.0 * (k * 7 % 20), 4.0 * (k * 11 % 23), 3.0) for k in range(300)]
    table, none = make(spark, shapes), spark.createDataFrame([], "location_id long, road_id long, type string, width double, path array<struct<x:double,y:double>>")
    pairs = px.building_proximity(table, 60.0).select("building_a", "building_b", "distance")
    near = nw.coordinate_network(table, none, 60.0, 60.0).edges.select("src", "dst", "weight")
    for found in (pairs, near):
        rows = found.withColumn("task", F.spark_partition_id()).collect()
        assert len({r[:2] for r in rows}) == len(rows) > 10_000
        for task in {r.task for r in rows}:
            mine = [r[2] for r in rows if r.task == task]
            assert mine == sorted(mine)
