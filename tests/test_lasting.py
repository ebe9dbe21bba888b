"""Robustness from few links against the graph of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as gp
from tessera.operators import lasting
from tessera.operators import networks as nw
from tessera.operators import proximity as px

SCHEMA = "location_id long, building_id long, type string, area_m2 double, ring array<struct<x:double,y:double>>"


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        place = i % 4
        x, y = round(rng.uniform(0, 60 + 40 * place), 1), round(rng.uniform(0, 40), 1)
        w = 90.0 if i % 60 == 7 else float(rng.randint(1, 6))
        ring = [(x, y), (x + w, y), (x + w, y + 2), (x, y + 2), (x, y)]
        if i % 30 == 4:
            ring = [(x, y), (x + 9.0, y), (x, y + 4.0), (x, y)]
        rows.append((place, i, "a", 1.0, ring))
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("strategy, share", [("degree", 16_384), ("random", 20)])
def test_few_links_give_the_same_robustness(shapes, monkeypatch, strategy, share):
    monkeypatch.setattr(lasting, "SHARE_ROWS", share)
    network = nw.building_network(shapes, 16.0)
    want = gp.robustness(network, gp.removal_order(network, strategy)).orderBy("location_id").collect()
    got = lasting.building_robustness(shapes, 16.0, strategy).orderBy("location_id").collect()
    assert got == want
    assert any(r.critical_fraction > 0 for r in want)


def test_degrees_without_pairs(shapes):
    want = {r.node: r.degree for r in nw.degrees(nw.building_network(shapes, 16.0)).collect()}
    got = {f"b:{r.building_id}": r.degree for r in px.neighbour_degrees(shapes, 16.0).collect()}
    assert got == want


def test_links_do_not_grow_as_pairs(spark):
    """2,000 buildings within reach of one another are about 2,000,000 pairs."""
    x, y = F.col("id") % 50, F.floor(F.col("id") / 50)
    corners = [F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    crowd = spark.range(2000).select(
        F.lit(1).cast("long").alias("location_id"), F.col("id").alias("building_id"), F.lit("a").alias("type"),
        F.lit(1.0).alias("area_m2"), F.array(*corners).alias("ring"),
    )
    order = spark.range(2000).selectExpr("1L AS location_id", "concat('b:', id) AS node", "id AS gone")
    assert lasting.lasting_links(crowd, 100.0, order).count() == 1999
