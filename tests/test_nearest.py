"""Nearest sites by tree and adaptive covers, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import cover, nearest, spatial

POINTS = "id int, latitude double, longitude double"
PATH = "array<struct<x:double,y:double>>"


def miles(a, b):
    (y1, x1), (y2, x2) = [[math.radians(v) for v in p] for p in (a, b)]
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * geo.MILES * math.asin(min(1.0, math.sqrt(h)))


def on_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy) if (dx, dy) != (0, 0) else 0.0
    t = max(0.0, min(1.0, t))
    return a[0] + t * dx, a[1] + t * dy


def inside(p, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def gathered(seed, n, box=(-105.0, 30.0, -100.0, 35.0)):
    """Points of which half crowd in a small town."""
    rng = random.Random(seed)
    west, south, east, north = box
    return [(i, rng.gauss(31.1, 0.02), rng.gauss(-103.3, 0.02)) if i % 2 else (i, rng.uniform(south, north), rng.uniform(west, east)) for i in range(n)]


@pytest.fixture
def tight(monkeypatch):
    """Small leaves, groups, lots and chunks, so that small tables have many."""
    for name, value in (("LEAF_SITES", 7), ("POINT_ROWS", 20), ("_GROUP", 3), ("_CHUNK", 16)):
        monkeypatch.setattr(nearest, name, value)


@pytest.mark.parametrize("box", [(-105.0, 30.0, -100.0, 35.0), (-180.0, -90.0, 180.0, 90.0), (179.0, -1.0, 181.0, 1.0)])
def test_nearest_station_is_the_nearest(spark, tight, box):
    turned = lambda rows: [(i, y, (x + 180) % 360 - 180) for i, y, x in rows]
    points, stations = turned(gathered(1, 90, box)), turned(gathered(2, 120, box))
    got = spatial.nearest_station(spark.createDataFrame([*points, (999, None, 1.0)], POINTS), spark.createDataFrame([*stations, (998, 1.0, None)], "station int, latitude double, longitude double"))
    rows = {r["id"]: r for r in got.collect()}
    assert set(rows) == {p[0] for p in points}
    for i, y, x in points:
        want = min(miles((y, x), (b, a)) for _, b, a in stations)
        assert rows[i]["miles"] == pytest.approx(want, abs=1e-6)


def test_ties_go_to_the_smaller_station(spark, tight):
    stations = [(i, 10.0, 20.0) for i in (9, 4, 7, *range(20, 60))]
    got = spatial.nearest_station(spark.createDataFrame([(1, 10.0, 21.0)], POINTS), spark.createDataFrame(stations, "station int, latitude double, longitude double"))
    assert [r["station"] for r in got.collect()] == [4]
    none = spatial.nearest_station(spark.createDataFrame([(1, 10.0, 21.0)], POINTS), spark.createDataFrame([], "station int, latitude double, longitude double"))
    assert none.count() == 0


def outlines(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, kind = rng.uniform(-105, -100), rng.uniform(30, 35), ("a", "b")[i % 2]
        if i % 3 == 0:
            out.append((i, kind, y, x, None))
        else:
            turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 7)))
            ring = [{"x": x + 0.15 * math.cos(t), "y": y + 0.15 * math.sin(t)} for t in turns]
            out.append((i, kind, y, x, ring if i % 2 else [*ring, ring[0]]))
    return out


def test_nearest_outline_of_each_kind(spark, tight):
    sites, points = outlines(5, 80), gathered(6, 120)
    frame = spark.createDataFrame(sites, f"site int, kind string, latitude double, longitude double, outline {PATH}")
    rows = spatial.nearest_outline(spark.createDataFrame(points, POINTS), frame).collect()
    assert len(rows) == 2 * len(points)
    project = lambda x, y: (6378137.0 * math.radians(x), 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(y) / 2)))
    within = 0
    for r in rows:
        _, y, x = points[r["id"]]
        best = None
        for site, kind, sy, sx, ring in sites:
            if kind != r["kind"]:
                continue
            path = [(p["x"], p["y"]) for p in ring] if ring else [(sx, sy)]
            edges = list(zip(path, [*path[1:], path[0]], strict=True))
            if ring and inside((x, y), path):
                far, told = 0.0, 0.0
            else:
                flat = [(project(*a), project(*b)) for a, b in edges]
                far = min(math.dist(project(x, y), on_segment(project(x, y), a, b)) for a, b in flat)
                near = min((on_segment((x, y), a, b) for a, b in edges), key=lambda q: math.dist(q, (x, y)))
                told = miles((y, x), (near[1], near[0]))
            if best is None or (far, site) < best[:2]:
                best = far, site, told
        within += best[0] == 0
        assert (r["site"], r["miles"]) == (best[1], pytest.approx(best[2], abs=1e-6))
    assert within


def test_outlines_across_the_date_line(spark, tight):
    ring = [{"x": 179.5, "y": -1.0}, {"x": -179.5, "y": -1.0}, {"x": -179.5, "y": 1.0}, {"x": 179.5, "y": 1.0}]
    frame = spark.createDataFrame([(1, "a", 0.0, 180.0, ring), (2, "a", 0.0, 170.0, None)], f"site int, kind string, latitude double, longitude double, outline {PATH}")
    points = [(1, 0.0, 179.9), (2, 0.0, -179.9), (3, 0.0, -179.0), (4, 0.0, 179.0), (5, 0.0, 171.0)]
    rows = {r["id"]: (r["site"], r["miles"]) for r in spatial.nearest_outline(spark.createDataFrame(points, POINTS), frame).collect()}
    half = pytest.approx(miles((0, 0), (0, 0.5)), rel=1e-6)
    assert rows == {1: (1, 0.0), 2: (1, 0.0), 3: (1, half), 4: (1, half), 5: (2, pytest.approx(miles((0, 0), (0, 1)), rel=1e-6))}


def test_nearest_line_is_the_nearest(spark, tight):
    rng = random.Random(8)
    lines = [(i, [{"x": rng.uniform(-105, -100), "y": rng.uniform(30, 35)} for _ in range(rng.randint(1, 4))]) for i in range(60)]
    points = gathered(9, 60)
    rows = {r["id"]: r for r in spatial.nearest_line(spark.createDataFrame(points, POINTS), spark.createDataFrame(lines, f"line int, path {PATH}")).collect()}
    for i, y, x in points:
        k, kx = math.radians(1) * geo.MILES, math.cos(math.radians(y)) * math.radians(1) * geo.MILES
        far = lambda path: min(math.hypot(*on_segment((0, 0), a, b)) for a, b in zip(path, [*path[1:], path[-1]], strict=True))
        want = min((far([((p["x"] - x) * kx, (p["y"] - y) * k) for p in path]), n) for n, path in lines)
        assert (rows[i]["miles"], rows[i]["line"]) == (pytest.approx(want[0], abs=1e-6), want[1])


def test_no_plan_of_the_nearest_meets_all_pairs(spark, tight, capsys):
    stations = spark.createDataFrame(gathered(3, 40), "station int, latitude double, longitude double")
    with nearest.Scratch() as keep:
        tree = nearest.Tree(keep, nearest.point_paths(stations).withColumn("_kind", F.lit(0)).select("station", "_kind", "path", "area"), nearest.Sphere(), "station", "_kind")
        points = spark.createDataFrame(gathered(4, 40), POINTS).select("id", F.col("longitude").alias("_px"), F.col("latitude").alias("_py"))
        tree.answers(keep, tree.asked(points, "id", False), "id").explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_points_and_outlines_take_seconds(spark):
    rng = np.random.default_rng(1)
    points = spark.range(100_000).selectExpr("cast(id as int) id", "30 + 5 * rand(1) latitude", "-105 + 5 * rand(2) longitude")
    ring = "transform(sequence(0, 4), k -> named_struct('x', longitude + 0.01 * cos(k), 'y', latitude + 0.01 * sin(k)))"
    sites = spark.range(10_000).selectExpr("cast(id as int) site", "'a' kind", "30 + 5 * rand(3) latitude", "-105 + 5 * rand(4) longitude").selectExpr("*", f"{ring} outline")
    found = spatial.nearest_outline(points, sites)
    assert found.count() == 100_000
    assert rng is not None and found.where("miles > 20").count() == 0


# --- covers


def star(seed, n, x, y, reach):
    rng = random.Random(seed)
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t, r in ((2 * math.pi * k / n, reach * rng.uniform(0.3, 1)) for k in range(n))]


def closed(ring):
    return [{"x": float(a), "y": float(b)} for a, b in [*ring, ring[0]]]


@pytest.mark.parametrize("size", [0.05, 0.5, 7.0])
def test_points_in_shapes_are_those_of_every_shape(spark, size):
    big, hole, far = star(1, 60, -102.5, 32.5, 2.4), star(2, 20, -102.5, 32.5, 0.5), star(3, 30, -104.5, 34.0, 0.4)
    shapes = [("whole", [closed(big), closed(hole), closed(far)]), ("small", [closed(star(4, 9, -103.3, 31.1, 0.03))])]
    points = [*gathered(7, 400), (1001, None, -102.0), (1002, 32.0, None)]
    got = spatial.in_shapes(spark.createDataFrame(points, POINTS), spark.createDataFrame(shapes, f"shape string, rings array<{PATH}>"), size)
    want = sorted((i, n) for i, y, x in points if y and x for n, rings in shapes if sum(inside((x, y), [(p["x"], p["y"]) for p in r[:-1]]) for r in rings) % 2)
    assert sorted((r["id"], r["shape"]) for r in got.collect()) == want


def test_shapes_across_the_date_line(spark):
    outer = [(178.0, -2.0), (-178.0, -2.0), (-178.0, 2.0), (178.0, 2.0)]
    hole = [(-179.5, -0.5), (-179.0, -0.5), (-179.0, 0.5), (-179.5, 0.5)]
    shapes = [("over", [closed(outer), closed(hole)]), ("world", [closed([(-180.0, -60.0), (180.0, -60.0), (180.0, 60.0), (-180.0, 60.0)])])]
    points = [(1, 0.1, 179.0), (2, 0.1, -178.3), (3, 0.1, -179.2), (4, 0.1, 177.0), (5, 0.1, -177.0), (6, 0.1, 0.0), (7, 0.1, -180.0), (8, 0.1, 180.0)]
    got = spatial.in_shapes(spark.createDataFrame(points, POINTS), spark.createDataFrame(shapes, f"shape string, rings array<{PATH}>"), 0.25)
    found = sorted((r["id"], r["shape"]) for r in got.collect())
    assert [i for i, n in found if n == "over"] == [1, 2, 7, 8]
    assert [i for i, n in found if n == "world"] == [1, 2, 3, 4, 5, 6, 7]


def test_a_large_shape_has_a_cover_along_its_border():
    ring = np.array([*star(5, 2000, 10.0, 47.0, 6.0)])
    ring = np.concatenate([ring, ring[:1]])
    found = cover.cells([ring], 0.001)
    border = sum(not c[3] for c in found)
    assert border <= cover.MAX_BORDER * 2 and len(found) < 6 * cover.MAX_BORDER
    assert len({c[:3] for c in found}) == len(found)
    square = np.array([[0.0, 0.0], [3.0, 0.0], [3.0, 3.0], [0.0, 3.0], [0.0, 0.0]])
    area = sum(cover.levels(0.1)[lv] ** 2 for lv, _, _, inner in cover.cells([square], 0.1) if inner)
    assert 0.8 * 9 < area <= 9
