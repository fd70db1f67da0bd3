import itertools
import math
import random

import numpy as np
import pytest

from tidegrid import params
from tidegrid.functions import spatial
from tidegrid.operators import areas, grid, polygons, tiles


def scene(rng, rows=87, cols=103):
    power = rng.gamma(2, 0.0008, (rows, cols))
    hv = 10 * np.log10(power)
    hv[20, 28], hv[31:34, 31:34] = np.nan, -5
    mask = np.ones(hv.shape, bool)
    mask[20:29, 27:32] = False
    return hv, mask


@pytest.mark.parametrize("core", [1, 7, 32, 400])
def test_tiles_equal_the_whole_grid(spark, core):
    """The same training statistics for every tile size, two scenes, masked and invalid cells, a negative origin."""
    rows = 20 if core == 1 else 87
    hv, mask = scene(np.random.default_rng(16))
    cells = [(g, r - 30, c - 50, float(hv[r, c]) + g, bool(mask[r, c])) for g in (0, 1) for r in range(rows) for c in range(103) if (r, c) != (11, 13)]
    frame = spark.createDataFrame(cells, "g long, r int, c int, hv double, ok boolean")
    p = params.Window(guard=(2, 3), background=(9, 11), pfa=1e-5)
    got = {(x.g, x.r, x.c): x for x in tiles.training(frame, p, core, mask="ok").collect()}
    hidden = frame.selectExpr("g", "r", "c", "CASE WHEN ok THEN hv END AS hv")
    want = {(x.g, x.r, x.c): x for x in grid.training(hidden, p).collect() if (x.g, x.r, x.c) in got}
    assert len(got) == len(want) == len(cells)
    for k, x in want.items():
        assert got[k].n == x.n and (got[k].power is None) == (x.power is None)
        assert got[k].s == pytest.approx(x.s, abs=1e-12) and got[k].q == pytest.approx(x.q, abs=1e-12)


def test_tiles_hits_plan_and_refusals(spark):
    hv, _ = scene(np.random.default_rng(3), 40, 40)
    frame = spark.createDataFrame([(0, r, c, float(hv[r, c]), float(hv[r, c]) + 7) for r in range(40) for c in range(40)], "g long, r int, c int, hv double, hh double")
    p = params.Window(guard=(2, 3), background=(9, 11), pfa=1e-5)
    for f in (grid.cell_averaging, grid.gamma_threshold):
        one = {(x.r, x.c) for x in grid.veto(f(tiles.training(frame, p, 16), p)).where("hit").collect()}
        assert one == {(x.r, x.c) for x in grid.veto(f(grid.training(frame, p), p)).where("hit").collect()} and one
    plan = tiles.training(frame, p, 16)._jdf.queryExecution().toString()
    assert plan.split("Physical Plan")[1].count("Exchange") == 1
    assert tiles.training(frame.limit(0), p).collect() == []
    with pytest.raises(ValueError):
        tiles.exchanged(frame, 0, (1, 1))
    with pytest.raises(Exception, match="one row for each cell"):
        tiles.training(frame.union(frame), p, 16).collect()


def plain_inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 < y) != (y2 < y) and (cross > 0) == (y2 > y1):
                odd = not odd
    return odd


def plain_distance(rings, x, y):
    best = math.inf
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            dx, dy = x2 - x1, y2 - y1
            t = min(max(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
            best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


def star(rng, cx, cy, r, n):
    return [(round(cx + r * k * math.cos(2 * math.pi * i / n), 1), round(cy + r * k * math.sin(2 * math.pi * i / n), 1)) for i in range(n) for k in [rng.uniform(0.4, 1)]]


def shapes(rng):
    """Stars, a ring with a hole and an island in it, a square on whole numbers, a sliver, and far away a small one."""
    out = {k: [star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(1, 18), rng.randint(3, 40))] for k in range(12)}
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    out[20] = [square(-15.0, 15.0), square(-10.0, 10.0), square(-2.0, 2.0)]
    out[21] = [square(0.0, 8.0)]
    out[22] = [[(-25.0, 3.0), (25.0, 3.1), (25.0, 3.2)]]
    out[23] = [square(100.0, 100.5)]
    return out


def frame(spark, polys):
    return spark.createDataFrame([(k, i, s, float(x), float(y)) for k, rings in polys.items() for i, ring in enumerate(rings) for s, (x, y) in enumerate(ring)], "poly long, ring int, seq int, x double, y double")


@pytest.mark.parametrize("size", [0.7, 3.0, 11.0, 500.0])
def test_points_in_polygons(spark, size):
    """Every cell size gives what a plain parity gives, vertices, boundary points and points on cell borders included."""
    rng = random.Random(9)
    polys = shapes(rng)
    corners = [v for rings in polys.values() for ring in rings for v in ring]
    halves = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(corners, corners[1:], strict=False)]
    lines = [((k + polygons.OFFSET) * size, rng.uniform(-20, 20)) for k in range(-3, 4)] + [(rng.uniform(-20, 20), (k + polygons.OFFSET) * size) for k in range(-3, 4)]
    points = corners + halves + lines + [(round(rng.uniform(-26, 26), 1), round(rng.uniform(-26, 26), 1)) for _ in range(600)]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(-1, None, 0.0)]
    index = polygons.index(polygons.edges(frame(spark, polys)), size)
    got = {r.id: r.found for r in polygons.locate(spark.createDataFrame(rows, "id long, x double, y double"), index, size).collect()}
    for i, x, y in rows:
        assert got[i] == ([] if x is None else sorted(k for k, rings in polys.items() if plain_inside(rings, x, y))), (x, y)


@pytest.mark.parametrize(("size", "reach"), [(3.0, 1.5), (2.0, 4.0)])
def test_points_within_reach(spark, size, reach):
    rng = random.Random(10)
    polys = shapes(rng)
    rows = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(500)]
    index = polygons.index(polygons.edges(frame(spark, polys)), size, reach)
    got = {r.id: r.found for r in polygons.locate(spark.createDataFrame(rows, "id long, x double, y double"), index, size, reach=reach).collect()}
    for i, x, y in rows:
        assert got[i] == sorted(k for k, rings in polys.items() if plain_inside(rings, x, y) or plain_distance(rings, x, y) <= reach)


def test_meeting_polygons(spark):
    rng = random.Random(11)
    one, other = shapes(rng), {k: v for k, v in shapes(rng).items() if k < 12}
    other[50] = [[(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]]  # within the island of 20
    other[51] = [[(-9.0, -9.0), (-8.9, -9.0), (-8.9, -8.9), (-9.0, -8.9)]]  # in the hole of 20

    def cross(p, q, r, s):
        o = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        return o(p, q, r) * o(p, q, s) < 0 and o(r, s, p) * o(r, s, q) < 0

    sides = lambda rings: [e for ring in rings for e in zip(ring, ring[1:] + ring[:1], strict=True)]
    want = {(a, b) for a, x in one.items() for b, y in other.items() if any(plain_inside(y, *v) for ring in x for v in ring) or any(plain_inside(x, *v) for ring in y for v in ring) or any(cross(*e, *f) for e in sides(x) for f in sides(y))}
    got = {tuple(r) for r in polygons.meeting(polygons.edges(frame(spark, one)), polygons.edges(frame(spark, other)), 3.0).collect()}
    assert got == want and (20, 50) in got and (20, 51) not in got


def test_inverse_projection(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    rows = [(rng.uniform(-140, -40), rng.uniform(30, 85)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "lon double, lat double")
    x, y = spatial.conic(F.col("lon"), F.col("lat"))
    lon, lat = spatial.conic_inverse(F.col("x"), F.col("y"))
    for r in frame.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-9) and r.b == pytest.approx(r.lat, abs=1e-9)


def convex(rng, x, y, r):
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 7)))
    return [(x + r * math.cos(a), y + r * math.sin(a)) for a in at]


@pytest.mark.parametrize("cell", [2.0, 5.0, 300.0])
def test_areas_against_clipping(spark, cell):
    """Unions by inclusion and exclusion of clipped rings; polygons with holes as differences; copies count once."""
    rng = random.Random(15)
    polys = {k: v for k, v in shapes(rng).items() if k in (0, 1, 2, 20, 22)}
    prints = {g: [convex(rng, rng.uniform(-12, 12), rng.uniform(-12, 12), rng.uniform(1, 14)) for _ in range(rng.randint(1, 4))] for g in range(6)}
    prints[6] = [[(-30.0, -30.0), (30.0, -30.0), (30.0, 30.0), (-30.0, 30.0)]]
    prints[7] = [[(200.0, 200.0), (201.0, 200.0), (201.0, 201.0)]]

    def inside(ring, sets):
        for s in sets:
            ring = spatial.clip_convex(ring, s) if ring else []
        return spatial.shoelace(ring) if ring else 0.0

    want = {}
    for g, own in prints.items():
        for k, rings in polys.items():
            signs = (1, -1, 1) if k == 20 else (1,)
            area = sum((-1) ** (n + 1) * sum(sign * inside(ring, some) for sign, ring in zip(signs, rings, strict=True)) for n in range(1, len(own) + 1) for some in itertools.combinations(own, n))
            if area > 1e-9:
                want[g, k] = pytest.approx(area, rel=1e-6, abs=1e-6)
    rows = [(g, [{"x": float(x), "y": float(y)} for x, y in r]) for g, own in prints.items() for r in own for _ in range(2)]
    feet = spark.createDataFrame(rows, "id long, ring array<struct<x:double,y:double>>")
    got = {(r.id, r.poly): r.area for r in areas.covered(feet, polygons.index(polygons.edges(frame(spark, polys)), cell), cell).collect() if r.area > 1e-9}
    assert got == want and len(want) > 20


def test_many_footprints_in_one_cell():
    """More footprints than one sweep takes are halved; a footprint over the whole box makes the others needless."""
    rng = random.Random(16)
    rings = [np.array(convex(rng, rng.uniform(2, 8), rng.uniform(2, 8), rng.uniform(0.2, 1.5))) for _ in range(90)]
    none = np.zeros((0, 4))
    box = (0.0, 0.0, 10.0, 10.0)
    got = areas.swept(rings, none, True, (0.0, 0.0), box)
    at = np.random.default_rng(1).uniform(0, 10, (40_000, 2))
    hit = np.zeros(len(at), bool)
    for r in rings:
        d = np.roll(r, -1, 0) - r
        hit |= ((d[:, 0] * (at[:, None, 1] - r[:, 1]) - d[:, 1] * (at[:, None, 0] - r[:, 0])) >= 0).all(axis=1)
    assert got == pytest.approx(hit.mean() * 100, abs=1.0)
    assert areas.swept([*rings, np.array([(-1, -1), (20, -1), (20, 20), (-1, 20)])], none, True, (0.0, 0.0), box) == pytest.approx(100)
    assert areas.swept(rings, none, False, (0.0, 0.0), box) == 0
