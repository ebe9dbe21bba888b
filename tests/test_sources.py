"""Ingested features: what a read touches, and that nothing near an edge is lost."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import features as ft
from tessera.sources import locations as loc

ZOOM = 8


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        side = rng.choice([0.0, 0.001, 0.5, 1.4, 6.0])
        x, y = rng.uniform(128, 146), rng.uniform(28, 46)
        ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
        rows.append((i, ring))
    df = spark.createDataFrame(rows, "fid long, ring array<struct<x:double,y:double>>")
    path = str(tmp_path_factory.mktemp("features") / "table")
    ft.write_features(df, path, "ring", ZOOM)
    return df, path


def scans(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [part.split("\n")[0] for part in plan.split("FileScan parquet")[1:]]


def test_windows_over_stored_features(spark, stored, monkeypatch, tmp_path):
    df, path = stored
    places = [(k, 30.0 + k % 4 * 3, 130.0 + k, 40_000.0 * (1 + k % 3)) for k in range(14)] + [(99, 35.0, 139.0, 400_000.0)]
    places = spark.createDataFrame(places, "location_id long, latitude double, longitude double, radius double")
    got = ft.stored_features_in_windows(spark, path, places, ZOOM).select("location_id", "fid")
    want = ft.features_in_windows(df, places, "ring", zoom=7).select("location_id", "fid")
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > len({f for _, f in rows}) > 100
    scan = [s for s in scans(got) if "tile" in s][0]
    assert "PartitionFilters: [tile" in scan and "ring" not in scan.split("ReadSchema:")[1]
    places.write.parquet(str(tmp_path / "places"))
    monkeypatch.setattr(ft, "MAX_TILES", 0)  # too many tiles to name
    got = ft.stored_features_in_windows(spark, path, spark.read.parquet(str(tmp_path / "places")), ZOOM)
    assert any("dynamicpruning" in s for s in scans(got))
    assert sorted(map(tuple, got.select("location_id", "fid").collect())) == rows


def test_windows_meet_wide_features_in_many_tasks(spark, stored, monkeypatch):
    from tessera.operators import range_join as rj

    df, path = stored
    monkeypatch.setattr(rj, "PAIRS_PER_TASK", 500)
    places = [(k, 30.0 + k % 15, 130.0 + k % 14, 60_000.0) for k in range(60)]
    places = spark.createDataFrame(places, "location_id long, latitude double, longitude double, radius double")
    wide = ft.read_features(spark, path).filter(F.col("tile") == ft.WIDE).select("fid")
    got = ft.stored_features_in_windows(spark, path, places, ZOOM).withColumn("task", F.spark_partition_id())
    rows, inside = got.select("location_id", "fid", "task").collect(), {r.fid for r in wide.collect()}
    met = [r for r in rows if r.fid in inside]
    assert len({r.task for r in met}) > 3
    want = ft.features_in_windows(df.join(wide, "fid", "left_semi"), places, "ring", zoom=7)
    assert sorted((r.location_id, r.fid) for r in met) == sorted((r.location_id, r.fid) for r in want.collect())


def test_rectangles_over_stored_features(spark, stored):
    df, path = stored
    for box in ((135.0, 33.0, 137.2, 36.0), (140.0, 30.0, 140.0, 30.0), (100.0, 0.0, 170.0, 60.0)):
        found = ft.stored_filter_by_bounds(spark, path, "ring", *box, zoom=ZOOM)
        want = ft.filter_by_bounds(df, "ring", *box)
        assert sorted(r.fid for r in found.collect()) == sorted(r.fid for r in want.collect())
    (scan,) = scans(ft.stored_filter_by_bounds(spark, path, "ring", 135.0, 33.0, 137.2, 36.0, zoom=ZOOM))
    assert "GreaterThanOrEqual(x_max,135.0)" in scan and "PartitionFilters: [tile" in scan


def test_choice_of_cities(spark):
    cities = spark.createDataFrame([(1, 35.0, 139.0, 3), (2, 40.0, 141.0, 1), (3, 30.0, 130.0, 6)], "city_order long, latitude double, longitude double, weight int")
    wanted = spark.range(900).withColumnRenamed("id", "location_id")
    got = loc.sample_locations_choice(wanted, cities, picks=600).collect()
    assert len(got) == 900 and {r.location_id for r in got if r.city_order} == set(range(600))
    share = {k: sum(r.city_order == k for r in got) / 600 for k in (1, 2, 3)}
    assert abs(share[1] - 0.3) < 0.07 and abs(share[2] - 0.1) < 0.05 and abs(share[3] - 0.6) < 0.07
    again = loc.sample_locations_choice(wanted.repartition(5), cities, picks=600).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert loc.sample_locations_choice(wanted, cities).filter(F.col("city_order").isNotNull()).count() == 50
