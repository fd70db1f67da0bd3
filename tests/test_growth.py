"""Results against plain loops, and plans whose rows stay in proportion to the input."""

import math
import os
import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegrid.operators import areas, brackets, matching, polygons, records

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_up_to_a_time_against_a_loop(spark):
    """Ties, empty cells, times before all knots, repeated rows."""
    rng = random.Random(1)
    knots = [(rng.choice([rng.randint(-40, 40), 500]), i) for i in range(60)]
    asked = [(rng.choice([rng.randint(-60, 60), 900]), i) for i in range(80)] + [(3, 7), (3, 7), (None, 1)]
    for width in (1, 7, 1000):
        got = brackets.tallied(spark.createDataFrame(asked, "t long, q long"), spark.createDataFrame([*knots, (None, 3)], "t long, id long"), width)
        want = [(t, q, sum(u <= t for u, _ in knots), max((k for k in knots if k[0] <= t), default=None)) for t, q in asked if t is not None]
        assert sorted(map(repr, want)) == sorted(repr((r.t, r.q, r.n, r.last and tuple(r.last))) for r in got.collect())


def test_orbit_cover_makes_no_pairs(spark):
    from tidegrid.plans import evidence

    assert "Join" not in plan(evidence.orbit_cover(spark, D))


def test_nearest_makes_no_pairs_and_breaks_ties(spark):
    """The earlier of equals, then the smaller id; bounds included; no join on cells of time without a key of one row."""
    rng = random.Random(2)
    left, right = [(i, rng.randint(0, 400)) for i in range(90)] + [(99, None)], [(i, rng.choice([rng.randint(0, 300), 150])) for i in range(50)]
    found = matching.nearest(spark.createDataFrame(left, "a long, t long"), spark.createDataFrame(right, "b long, t long"), 20)
    best = lambda t: min(((abs(t - u), u, b) for b, u in right if abs(t - u) <= 20), default=(None, None, None)) if t is not None else (None,) * 3
    assert sorted(map(repr, found.collect())) == sorted(f"Row(a={a}, b={best(t)[2]}, dt={best(t)[0]})" for a, t in left)
    many = [(i, 0) for i in range(3000)]
    assert matching.nearest(spark.createDataFrame(many, "a long, t long"), spark.createDataFrame(many, "b long, t long"), 20).where("b = 0").count() == 3000
    assert "explode" not in plan(found)


def test_matches_by_places_against_edges(spark):
    """Copies of one place on either side, rows without a place; edges are not shuffled one by one."""
    rng = random.Random(3)
    rows = lambda n, copies: [(i, rng.randint(0, 4000), float(rng.randint(0, 40) * 500), 0.0) for i in range(n)] + [(n + i, 9, 9.0, 9.0) for i in range(copies)] + [(9000, None, 1.0, 1.0)]
    for n, copies in ((12, 0), (40, 3), (5, 2)):
        a, b = spark.createDataFrame(rows(n, copies), "a long, t long, x double, y double"), spark.createDataFrame(rows(n, 1), "b long, t long, x double, y double")
        got = matching.matched(a, b, 3600.0)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, matching.associations(a, matching.near(a, b, 3600.0)).collect()))


def test_ids_at_several_places_are_matched_once(spark, tmp_path):
    """Ids whose rows differ in place, repeated rows, rows without a place or an id: as by distinct edges, and the query as its SQL; a node of such an id has one unit a key."""
    rng = random.Random(8)
    place = lambda: (rng.randint(0, 4000), float(rng.randint(0, 12) * 500), 0.0)
    rows = lambda n: (r := [(rng.randint(0, n), *place()) for _ in range(n)] + [(100 + i, *place()) for i in range(n)]) + r[:3] + [(3, None, 0.0, 0.0), (100, None, 0.0, 0.0), (900, None, 1.0, 1.0), (None, *r[-1][1:]), (None, 9, 0.0, 0.0)]
    for n in (12,):
        a, b = spark.createDataFrame(rows(n), "a long, t long, x double, y double"), spark.createDataFrame(rows(n), "b long, t long, x double, y double")
        got = matching.matched(a, b, 3600.0).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, matching.associations(a, matching.near(a.where("a IS NOT NULL"), b.where("b IS NOT NULL"), 3600.0)).collect()))
        own = matching.places(a, "a").withColumn("a", F.struct("a.id", "a.n", F.expr("t div 2000").alias("day")))
        e = matching.near(own, matching.places(b, "b"), 3600.0).select("a.day", F.col("a.id").alias("a"), F.col("a.n").alias("na"), F.col("b.id").alias("b"), F.col("b.n").alias("nb"), "distance")
        found = matching.flows(e, "day")
        pairs = matching.dealt_out(found, a, b, "day").collect()
        assert len({(r.day, r.a) for r in pairs}) == len({(r.day, r.b) for r in pairs}) == len(pairs) == sum(r.n for r in found.collect()) > 0
    from tests.twins import TABLES, compare
    from tidegrid.plans import registry

    for t in TABLES:
        if t != "events":
            os.symlink(f"{D}/{t}.parquet", tmp_path / f"{t}.parquet")
    at = pd.Timestamp("2024-01-01")
    events = [(rng.randint(0, 60), at + pd.Timedelta(seconds=rng.randint(0, 40_000)), rng.choice(["error", "purchase"])) for _ in range(160)] + [(i, None, "error") for i in range(0, 60, 7)]
    pd.DataFrame(events, columns=["event_id", "ts", "event_type"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    compare(spark, "sighting_match", registry.QUERIES["sighting_match"], registry.ORACLE["sighting_match"], str(tmp_path))


def test_pairs_at_the_bound_meet(spark):
    """Places whose distance is the bound by rounding, on both sides of a cell; no time between."""
    a = spark.createDataFrame([(1, 0, -1e-17, 0.0), (2, 0, 0.0, -1e-17)], "a long, t long, x double, y double")
    b = spark.createDataFrame([(7, 10800, 5400.0, 0.0), (8, 10800, 0.0, 5400.0)], "b long, t long, x double, y double")
    assert {(r.a, r.b) for r in matching.near(a, b, 10800.0).collect()} == {(1, 7), (1, 8), (2, 7), (2, 8)}
    assert {(r.a, r.b) for r in matching.near(a, b.withColumn("t", F.lit(0).cast("long")), 0.0, 0.5, 5400.0).collect()} == {(1, 7), (1, 8), (2, 7), (2, 8)}


def test_transport_against_the_assignment_of_units():
    """Units along a few edges are what an assignment of all single units gives, in number and cost; a large sparse problem needs no matrix."""
    rng = random.Random(4)
    for _ in range(150):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        edges = {(i, j): rng.uniform(0, 9) if rng.random() < 0.7 else 0.0 for i in range(n) for j in range(m) if rng.random() < 0.6}
        na, nb = [rng.randint(1, 2) for _ in range(n)], [rng.randint(1, 2) for _ in range(m)]
        ends = [j for j in range(m) for _ in range(nb[j])]
        best = {0: (0, 0.0)}
        for i in [i for i in range(n) for _ in range(na[i])]:
            for used, (count, cost) in list(best.items()):
                for k, j in enumerate(ends):
                    if not used >> k & 1 and (i, j) in edges:
                        new = (count - 1, cost + edges[i, j])
                        best[used | 1 << k] = min(best.get(used | 1 << k, (1, 0.0)), new)
        got = matching.transport(edges, na, nb)
        assert all(sum(f for (i, _), f in got.items() if i == k) <= na[k] for k in range(n)) and all(sum(f for (_, j), f in got.items() if j == k) <= nb[k] for k in range(m))
        count, cost = min(best.values())
        assert -sum(got.values()) == count and abs(sum(edges[e] * f for e, f in got.items()) - cost) < 1e-9
    size = 30_000
    assert sum(matching.transport({(0, j): 1.0 for j in range(size)} | {(i, 0): 1.0 for i in range(200)}, [1] * 200, [1] * size).values()) == 2


def test_units_are_dealt_to_ids(spark):
    """Copies of places: one-to-one pairs of ids, as many and as near as by single edges."""
    rows = lambda n, s: [(s + i, (i % 3) * 600, float(i % 3) * 400, 0.0) for i in range(n)]
    a, b = spark.createDataFrame(rows(11, 0), "a long, t long, x double, y double"), spark.createDataFrame(rows(8, 50), "b long, t long, x double, y double")
    day = F.lit(0).cast("long").alias("day")
    e = matching.near(matching.places(a, "a"), matching.places(b, "b"), 3600.0).select(day, F.col("a.id").alias("a"), F.col("a.n").alias("na"), F.col("b.id").alias("b"), F.col("b.n").alias("nb"), "distance")
    got = matching.dealt_out(matching.flows(e, "day"), a, b, "day").collect()
    want = matching.assign(matching.near(a, b, 3600.0).select(day, "a", "b", "distance"), "day").collect()
    assert len(got) == len({r.a for r in got}) == len({r.b for r in got}) == len(want) == 8
    assert abs(sum(r.distance for r in got) - sum(r.distance for r in want)) < 1e-9


def crowd(seed, n, m, degree):
    """Edges between n and m points of a lattice of few distances, so that many want the same; the first point of m is everyone's last resort."""
    rng = np.random.default_rng(seed)
    i = np.repeat(np.arange(n), degree)
    j = (i * m // n + rng.integers(-2 * degree, 2 * degree, len(i))) % m
    edges = {(int(x), int(y)): 100.0 * math.sqrt(rng.integers(0, 30)) for x, y in zip(i, j, strict=True)}
    return edges | {(x, 0): 6000.0 for x in range(n)}


def shortest(edges, na, nb):
    """Units and cost by Bellman and Ford's shortest paths one after another, in a plain loop."""
    flow, have, take, total = dict.fromkeys(edges, 0), list(na), list(nb), [0, 0.0]
    while True:
        dist, before = {("a", i): 0.0 for i, n in enumerate(have) if n}, {}
        changed = True
        while changed:
            changed = False
            for (i, j), c in edges.items():
                for x, y, w, ok in ((("a", i), ("b", j), c, True), (("b", j), ("a", i), -c, flow[i, j] > 0)):
                    if ok and x in dist and dist[x] + w < dist.get(y, math.inf) - 1e-9:
                        dist[y], before[y], changed = dist[x] + w, x, True
        end = min((("b", j) for j, n in enumerate(take) if n and ("b", j) in dist), key=dist.get, default=None)
        if end is None:
            return total
        total = [total[0] + 1, total[1] + dist[end]]
        take[end[1]] -= 1
        while end in before:
            x = before[end]
            if x[0] == "a":
                flow[x[1], end[1]] += 1
            else:
                flow[end[1], x[1]] -= 1
            end = x
        have[end[1]] -= 1


def test_crowded_nodes_are_matched_by_short_searches():
    """Equal to a plain loop with several units a node and too few places; 5 000 nodes that link in one component are done in seconds."""
    rng = random.Random(7)
    for seed, n, m in ((0, 25, 25), (1, 40, 20), (2, 20, 40), (3, 30, 30)):
        edges = crowd(seed, n, m, 3)
        na, nb = [rng.randint(1, 3) for _ in range(n)], [rng.randint(1, 3) for _ in range(m)]
        got = matching.transport(edges, na, nb)
        assert all(sum(f for (i, _), f in got.items() if i == k) <= na[k] for k in range(n)) and all(sum(f for (_, j), f in got.items() if j == k) <= nb[k] for k in range(m))
        units, cost = shortest(edges, na, nb)
        assert sum(got.values()) == units and abs(sum(edges[e] * f for e, f in got.items()) - cost) < 1e-6
    began = time.monotonic()
    assert sum(matching.transport(crowd(4, 5000, 4800, 6), [1] * 5000, [1] * 4800).values()) > 4700
    assert time.monotonic() - began < 30


def test_days_are_assigned_in_few_jobs(spark):
    """A path of 120 nodes and 40 lone pairs on each of two days: no rounds of components unless a day has more edges than one task takes; ids of any type."""
    path = [(d, f"l{(i + 1) // 2:04}", f"r{i // 2:04}", float(i * 7919 % 30 + 1)) for d in (0, 1) for i in range(119)] + [(d, f"x{i}", f"y{i}", 2.0) for d in (0, 1) for i in range(40)]
    edges = spark.createDataFrame([(*r[:2], 1, r[2], 1, r[3]) for r in path + path[:3]], "day long, a string, na long, b string, nb long, distance double")
    lines = [{(int(a[1:]), int(b[1:])): c for d, a, b, c in path if d == 0 and a[0] == "l"}, {(i, i): 2.0 for i in range(40)}]
    units, cost = (2 * sum(v) for v in zip(*(shortest(e, [1] * 61, [1] * 61) for e in lines), strict=True))
    sc, jobs = spark.sparkContext, []
    for whole in (10_000, 160, 60):
        sc.setJobGroup(f"days-{whole}", "")
        got = matching.flows(edges, "day", whole).collect()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"days-{whole}")))
        assert len(got) == len({(r.day, r.a) for r in got}) == len({(r.day, r.b) for r in got}) == units and abs(sum(r.distance for r in got) - cost) < 1e-6
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] < 12 < jobs[2]


def test_points_meet_a_cells_edges_in_bundles(spark):
    """A comb of 400 teeth in one cell: points within by an even-odd loop; edges are joined to bundles of points, not to each."""
    xs = np.arange(801) / 1000.0
    ring = [(float(x), 0.9 if i % 2 else 0.1) for i, x in enumerate(xs)] + [(0.8, 0.0), (0.0, 0.0)]
    v = spark.createDataFrame([(7, 0, i, x, y) for i, (x, y) in enumerate(ring)], "poly long, ring int, seq int, x double, y double")
    rng = np.random.default_rng(6)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-0.1, 1.0, (3000, 2)))] + [(9000, None, 0.5), (9001, float("nan"), 0.05)]
    got = polygons.locate(spark.createDataFrame(pts, "id long, x double, y double"), polygons.index(polygons.edges(v), 4.0), 4.0)
    want = {i for i, x, y in pts if x is not None and x == x and sum((a[1] < y) != (b[1] < y) and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > x for a, b in zip(ring, ring[1:] + ring[:1])) % 2}
    assert {r.id for r in got.where("size(found) > 0").collect()} == want and got.count() == len(pts)
    assert "collect_list(_p" in plan(got)


def test_both_screens_are_one_pass(spark):
    from tidegrid.plans import records

    rows = records.additive_rescreen(spark, D)
    assert "Join" not in plan(rows) and plan(rows).count("Relation") == 1


def test_rings_that_hold_a_box():
    """Either direction, repeated vertices, rings of several lengths; many that hold the box cost no sweep."""
    box = (0.0, 0.0, 1.0, 1.0)
    square = lambda a, b: np.array([(a, a), (b, a), (b, b), (a, b)])
    rings = [square(-1.0, 2.0), square(-1.0, 2.0)[::-1], square(0.5, 2.0), np.array([(-9.0, -9.0), (9.0, -9.0), (0.0, 9.0)]), np.vstack([square(-1.0, 2.0), [(-1.0, 2.0)]])]
    assert areas.cover(rings, box).tolist() == [True, True, False, True, True]
    assert areas.swept([square(0.5, 2.0)], np.zeros((0, 4)), True, (0.0, 0.0), box) == 0.25


def test_support_is_counted_by_groups_of_places():
    """The counts of all pairs, with pairs compared that grow more slowly than all of them."""
    rng, shares = np.random.default_rng(3), []
    for k in (2000, 16_000):
        place = lambda n: (rng.uniform(0, 40_000, n).round(), rng.uniform(-60, -50, n), rng.uniform(45, 55, n))
        marks, seen, pairs = place(60), place(k), []
        n, nearest = records.tally(*marks, *seen, 21_600.0, 250_000.0, pairs)
        for i in range(60):
            lat, lat2 = np.radians(marks[2][i]), np.radians(seen[2])
            h = np.sin((lat2 - lat) / 2) ** 2 + np.cos(lat) * np.cos(lat2) * np.sin(np.radians(seen[1] - marks[1][i]) / 2) ** 2
            d = 2 * records.EARTH_M * np.arcsin(np.sqrt(h))
            d = d[(d <= 250_000) & (np.abs(seen[0] - marks[0][i]) <= 21_600)]
            assert n[i] == len(d) and abs(nearest[i] - d.min()) < 1e-4
        shares.append(sum(pairs) / (60 * k))
    assert shares[1] < 0.6 * shares[0] and shares[1] < 0.1
