"""Radius joins against brute force, over the poles, the date line and crowded spots."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.functions.sphere import VantageTree, distance, nearest_and_reach
from rookery.operators import nearby
from rookery.operators.nearby import near_counts, near_points

SCHEMA = "id long, lat double, lon double, point string, cell int"


def points(rng, n):
    """Clusters of a few hundred metres here and there, one crowd, some at the date line and the poles."""
    base = np.column_stack([rng.uniform(-80, 80, 40), rng.uniform(-180, 180, 40)])
    out = [base[rng.integers(40)] + rng.normal(0, 0.002, 2) for _ in range(n // 2)]
    out += [base[0] + rng.normal(0, 0.0005, 2) for _ in range(n // 3)]
    out += [(rng.uniform(-0.001, 0.001), rng.choice([-1, 1]) * rng.uniform(179.999, 180)) for _ in range(n // 12)]
    out += [(89.9999, rng.uniform(-180, 180)) for _ in range(n // 12)]
    return [(float(a), float(b)) for a, b in out]


def brute(rows, r):
    lat, lon = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    d = distance(lat[:, None], lon[:, None], lat[None], lon[None])
    return sorted({(min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])) for i, j in zip(*np.nonzero(d <= r), strict=True) if rows[i][0] != rows[j][0]})


@pytest.mark.parametrize(("cell_points", "fan_out"), [(4_000, 256), (60, 64), (25, 3)])
def test_complete(spark, monkeypatch, cell_points, fan_out):
    monkeypatch.setattr(nearby, "MEMBERS", 20)
    rows = points(np.random.default_rng(3), 600)
    rows = [(10**18 + i, *p, "x", 1) for i, p in enumerate([*rows, *rows[:50], *[rows[0]] * 60])]  # spots of many points; ids beyond 2**53
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_points(df, "id", "lat", "lon", 150.0, cell_points, fan_out)
    want = brute(rows, 150.0)
    assert sorted((r["point_a"], r["point_b"]) for r in got.collect()) == want
    n = Counter(x for pair in want for x in pair)
    counts = near_counts(df, "id", "lat", "lon", 150.0, cell_points, fan_out).collect()
    assert {r["point"]: r["n_near"] for r in counts} == {r[0]: n[r[0]] for r in rows}
    spots = {}
    for r in rows:
        spots.setdefault((r[1], r[2]), r[0])
    assert {r["point"]: r["place"] for r in counts} == {r[0]: spots[r[1], r[2]] for r in rows}


def test_unusable_positions(spark):
    bad = [(1, None, 1.0), (2, 1.0, None), (3, math.nan, 1.0), (4, 91.0, 0.0), (5, 0.0, -180.5), (6, 0.0, 0.0), (None, 1.0, 1.0), (7, 1.0, math.inf)]
    good = [(8, 1.0, 1.0), (9, 1.0, 1.0), (9, 1.0, 1.0), (10, 0.0, 1.0)]
    df = spark.createDataFrame([(*r, "x", 0) for r in bad + good], SCHEMA)
    assert [(r["point_a"], r["point_b"]) for r in near_points(df, "id", "lat", "lon").collect()] == [(8, 9)]


def test_one_crowded_place(spark, monkeypatch):
    df = spark.createDataFrame([(i, 10.0, 10.0, "x", 0) for i in range(90)], SCHEMA)
    monkeypatch.setattr(nearby, "MEMBERS", 7)
    assert near_points(df, "id", "lat", "lon", cell_points=10).count() == 90 * 89 // 2
    many = spark.range(20_000).select("id", F.lit(10.0).alias("lat"), F.lit(10.0).alias("lon"))
    assert near_counts(many, "id", "lat", "lon").groupBy("place", "n_near").count().collect() == [(0, 19_999, 20_000)]


def test_dense_cell_of_different_spots(spark):
    many = spark.range(3_000).select("id", (F.col("id") % 60 * 1e-6).alias("lat"), (10 + F.floor(F.col("id") / 60) * 1e-6).alias("lon"))
    got = near_points(many, "id", "lat", "lon", 150.0, cell_points=400, fan_out=4)
    assert got.count() == 3_000 * 2_999 // 2


def test_empty(spark):
    assert near_points(spark.createDataFrame([], SCHEMA), "id", "lat", "lon").count() == 0
    assert near_counts(spark.createDataFrame([], SCHEMA), "id", "lat", "lon").count() == 0


def test_tree():
    rng = np.random.default_rng(1)
    p = np.array(points(rng, 400))
    tree = VantageTree(p[:, 0], p[:, 1], leaf=5)
    parts = [*tree.within(p[:, 0], p[:, 1], 500.0, 100)]
    assert len(parts) > 5
    i, j = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    d = distance(p[:, 0][:, None], p[:, 1][:, None], p[:, 0][None], p[:, 1][None])
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(d <= 500.0)), strict=True))
    assert [*VantageTree([], []).within([1.0], [1.0], 10.0)] == []


def test_replication_covers_neighbours():
    rng = np.random.default_rng(2)
    lat, lon = rng.uniform(-1, 1, 500), rng.uniform(-1, 1, 500)
    home, i, j = nearest_and_reach(lat, lon, lat[:20], lon[:20], 2 * 5_000)
    cells = {(a, int(c)) for a, c in enumerate(home)} | set(zip(i.tolist(), j.tolist(), strict=True))
    d = distance(lat[:, None], lon[:, None], lat[None], lon[None])
    assert all((b, int(home[a])) in cells for a, b in zip(*np.nonzero(d <= 5_000), strict=True))
