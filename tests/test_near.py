import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import near

RING = "region_no long, ring_longitude_deg array<double>, ring_latitude_deg array<double>"


def brute_pairs(rows, radius):
    ok = [(i, (x + 180) % 360 - 180, y) for i, x, y in rows if x is not None and y is not None and math.isfinite(x) and math.isfinite(y) and -180 <= x <= 360 and -90 <= y <= 90]
    ok = [r for r in ok if (r[1], r[2]) != (0, 0)]
    out = set()
    for n, a in enumerate(ok):
        for b in ok[n + 1 :]:
            if float(near.haversine_m(a[1], a[2], b[1], b[2])) < radius and a[0] != b[0]:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def run(spark, rows, radius=100.0, regions=()):
    df = spark.createDataFrame(rows, "row_id long, longitude_deg double, latitude_deg double").withColumn("lon", F.lit(1)).withColumn("cell", F.lit("x"))
    found = near.near_and_within(df.withColumnRenamed("row_id", "solution_no"), "solution_no", radius, spark.createDataFrame(list(regions), RING)).collect()
    assert len(set(found)) == len(found)
    return {(a, b) for r, a, b in found if r == "near"}, {(a, b) for r, a, b in found if r == "within"}


def test_against_brute_force_everywhere(spark, monkeypatch):
    monkeypatch.setattr(near, "PLACES_PER_CELL", 20)
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for lon, lat in [(10.0, 50.0), (179.9999, 0.0), (-179.9999, 0.0), (0.0, 89.9999), (120.0, -89.9997), (359.9999, 20.0), (0.0, 20.0)]:
        for _ in range(40):
            dx, dy = rng.normal(0, 0.002, 2)
            y = min(90.0, max(-90.0, lat + dy))
            rows.append((n, lon + dx / max(0.05, math.cos(math.radians(y))) if abs(lat) < 80 else rng.uniform(-180, 180), y))
            n += 1
    rows = [(i, x if x <= 360 else x - 360, y) for i, x, y in rows]
    rows += [(n + 1, 10.0, 50.0), (n + 2, 10.0, 50.0), (n + 3, 10.0, 50.0), (n + 3, 10.0, 50.0)]
    rows += [(n + 10, None, 1.0), (n + 11, 1.0, None), (n + 12, float("nan"), 0.0), (n + 13, 0.0, 0.0), (n + 14, 361.0, 1.0), (n + 15, 10.0, 91.0), (n + 16, 0.0, 0.0), (n + 17, float("inf"), 3.0)]
    rows = [(i, None if x is None else float(x) if not -182 < x < -180 else float(x + 360), None if y is None else float(y)) for i, x, y in rows]
    got, _ = run(spark, rows)
    assert got == brute_pairs(rows, 100.0) and got


def test_empty_and_one(spark):
    assert run(spark, []) == (set(), set())
    assert run(spark, [(1, 5.0, 5.0)]) == (set(), set())


def test_hot_place_is_one_place(spark):
    rows = [(i, 7.0, 8.0) for i in range(60)] + [(100, 7.0005, 8.0)]
    df = near.located(spark.createDataFrame(rows, "row_id long, longitude_deg double, latitude_deg double"), "row_id")
    pairs, members = near.near_rows(df, 100.0)
    assert pairs.count() == 1 and members.count() == 61
    assert near.expand_pairs(pairs, members).count() == 60 * 59 // 2 + 60


def test_regions(spark):
    square = (1, [10.0, 20.0, 20.0, 10.0], [0.0, 0.0, 10.0, 10.0])
    closed = (2, [170.0, 170.0, -170.0, -170.0, 170.0], [0.0, 10.0, 10.0, 0.0, 0.0])
    polar = (3, [-150.0, -30.0, 90.0], [80.0, 80.0, 80.0])
    notch = (4, [40.0, 60.0, 60.0, 50.0, 40.0], [0.0, 0.0, 20.0, 5.0, 20.0])
    broken = [(5, None, [1.0]), (6, [1.0, 2.0], [1.0, 2.0]), (7, [1.0, 2.0, None], [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0], [1.0, 2.0]), (None, [10.0, 20.0, 20.0, 10.0], [0.0, 0.0, 10.0, 10.0])]
    rows = [(1, 15.0, 5.0), (2, 175.0, 5.0), (3, 185.0, 5.0), (4, -175.0, 5.0), (5, 0.0, 89.0), (6, 100.0, 85.0), (7, 50.0, 15.0), (8, 45.0, 5.0), (9, 25.0, 5.0), (10, 165.0, 5.0), (11, 375.0 - 360, 11.0)]
    _, got = run(spark, rows, 100.0, [square, closed, polar, notch, *broken])
    assert got == {(1, 1), (2, 2), (2, 3), (2, 4), (3, 5), (3, 6), (4, 8)}


def test_tree_equals_brute_force():
    rng = np.random.default_rng(1)
    p = near.unit_vectors(rng.uniform(-180, 180, 900), rng.uniform(-90, 90, 900))
    p = np.vstack([p, p[:100]])
    q = p[::7]
    got = {(int(a), int(b)) for x, y in near.VantageTree(p).within(q, 0.2) for a, b in zip(x, y, strict=True)}
    d = near.angles(q[:, None, :], p[None, :, :])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 0.2), strict=True)}


@pytest.mark.parametrize("radius", [0, -1, float("nan"), float("inf")])
def test_bad_radius(spark, radius):
    with pytest.raises(ValueError):
        near.near_rows(spark.createDataFrame([], "row_id long, lon double, lat double"), radius)
