"""The batch from ingested features to the written table, with both policies for empty locations."""

from tessera.plans.batch import features_of, run_batch
from tessera.plans.indicators import DEFAULT_ROW
from tessera.sources import features as ft

SCHEMA = "feature_id long, type string, width double, shape array<struct<x:double,y:double>>"


def block(x, y, first):
    """Twelve buildings and two crossing roads near a place, in degrees."""
    rows = []
    for k in range(12):
        a, b = x + (k % 4) * 4e-4, y + (k // 4) * 4e-4
        ring = [(a, b), (a + 2e-4, b), (a + 2e-4, b + 2e-4), (a, b + 2e-4), (a, b)]
        rows.append((first + k, "residential" if k % 2 else None, None, ring))
    roads = [(first + 50, None, 4.0, [(x - 1e-3, y - 1e-4), (x + 3e-3, y - 1e-4)])]
    roads += [(first + 51, "primary", None, [(x - 1e-4, y - 1e-3), (x - 1e-4, y + 3e-3)]), (first + 52, None, None, None)]
    return rows, roads


def test_batch(spark, tmp_path):
    tables = {"national": block(139.0, 35.0, 0), "open": tuple(a + b for a, b in zip(block(139.0, 35.0, 100), block(2.0, 48.0, 200)))}
    paths = {}
    for source, both in tables.items():
        paths[source] = {}
        for kind, rows in zip(("building", "road"), both):
            paths[source][kind] = str(tmp_path / f"{source}-{kind}")
            ft.write_features(spark.createDataFrame(rows, SCHEMA), paths[source][kind], "shape", 10)
    places = [(1, 35.0, 139.0, "national", 500), (2, 48.0, 2.0, "open map", 500), (3, -20.0, 10.0, "empty", 500)]
    places = spark.createDataFrame(places, "location_id long, latitude double, longitude double, name string, radius int")
    seen = {(r.location_id, r.kind, r.feature_id) for r in features_of(spark, paths["open"], places, 10).collect()}
    assert {p for p, _, _ in seen} == {1, 2} and len(seen) == 2 * 14
    run_batch(spark, paths["national"], paths["open"], places, str(tmp_path / "all"))
    rows = {r.location_id: r for r in spark.read.parquet(str(tmp_path / "all")).collect()}
    assert set(rows) == {1, 2, 3} and rows[3].name == "empty"
    assert all(rows[3][name] == value for name, value in DEFAULT_ROW.items())
    # The same block twice, read from either source: equal in all that does not depend on the latitude.
    assert rows[1].overlap == rows[2].overlap and rows[1].multi_nodality == rows[2].multi_nodality
    run_batch(spark, paths["national"], paths["open"], places, str(tmp_path / "some"), "drop", file_format="csv")
    assert spark.read.csv(str(tmp_path / "some"), header=True).count() == 2
