import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import params
from tidegrid.functions import spatial
from tidegrid.operators import evaluate, graph, grid, ledgers, matching, records, screen
from tidegrid.sources import text


def test_gates_fail_closed_and_ledger_conserves(spark):
    rows = [(1, 10, 200.0, 150.0, -20.0, 8.0, -33.0), (2, 3, 200.0, 150.0, -20.0, 8.0, -33.0), (3, 10, 2000.0, 50.0, -20.0, 8.0, -33.0), (4, 10, 200.0, 150.0, -31.0, 8.0, -40.0), (5, 10, 200.0, 150.0, -20.0, None, -33.0), (6, 10, 200.0, 150.0, -20.0, 8.0, None), (7, 30000, 1.0, 1.0, -20.0, 8.0, -33.0), (8, None, 1.0, 1.0, -20.0, 8.0, -33.0)]
    frame = spark.createDataFrame(rows, "id int, pixel_area int, length_m double, width_m double, peak_hv double, ratio_db double, clutter_db double")
    judged = screen.first_rejection(frame)
    assert {r.id: r.first_rejection for r in judged.collect()} == {1: None, 2: "min_size", 3: "aspect_ratio", 4: "min_peak_hv", 5: "copol_dominance", 6: "clutter_contrast", 7: "max_size", 8: "min_size"}
    led = screen.ledger(judged).orderBy("stage_ord").collect()
    assert led[-1].remaining == 1 and sum(r.removed for r in led) == 7
    assert screen.ledger(judged.limit(0)).agg(F.sum("removed"), F.sum("remaining")).first()[0] == 0


@pytest.mark.parametrize("values,want", [([float(i) for i in range(9)], "lllmmmhhh"), ([1.0, 2.0], "uu"), ([3.0, 3.0, 3.0], "uuu"), ([1.0, None, 2.0, float("nan"), 3.0], "lumuh")])
def test_terciles(spark, values, want):
    got = screen.terciles(spark.createDataFrame(list(enumerate(values)), "i int, v double"), "v").orderBy("i").collect()
    assert "".join(r.regime[0] for r in got) == want


def test_parameters_refuse():
    for bad in (lambda: params.Gates(min_pixels=0), lambda: params.Gates(max_aspect=0.5), lambda: params.Window(guard=(5, 5)), lambda: params.Window(pfa=1.0), lambda: params.Quality(min_valid=0), lambda: params.Pairing(items=0), lambda: params.Sampling(edges_db=(1.0, 1.0))):
        with pytest.raises(ValueError):
            bad()


def test_training_statistics_against_plain_sums(spark):
    rng = np.random.default_rng(16)
    hv = 10 * np.log10(rng.gamma(2, 0.02, (23, 31)))
    hv[5:8, 7:9] = np.nan
    p = params.Window(guard=(2, 1), background=(5, 4), pfa=0.01)
    rows = [(0, r, c, float(hv[r, c])) for r in range(23) for c in range(31) if not (r == 11 and c == 13)]
    hv[11, 13] = np.nan
    got = {(r.r, r.c): r for r in grid.training(spark.createDataFrame(rows, "g long, r int, c int, hv double"), p).collect()}
    power = np.where(np.isfinite(hv), np.maximum(10 ** (hv / 10), 1e-6), np.nan)
    assert len(got) == 23 * 31
    for r, c in itertools.product(range(23), range(31)):
        bg, gd = power[max(0, r - 5) : r + 6, max(0, c - 4) : c + 5], power[max(0, r - 2) : r + 3, max(0, c - 1) : c + 2]
        x = got[r, c]
        assert x.n == np.isfinite(bg).sum() - np.isfinite(gd).sum()
        assert x.s == pytest.approx(np.nansum(bg) - np.nansum(gd), abs=1e-9) and x.q == pytest.approx(np.nansum(bg**2) - np.nansum(gd**2), abs=1e-9)


def test_planted_targets_are_found(spark):
    rng = np.random.default_rng(42)
    hv = 10 * np.log10(rng.exponential(10**-3.2, (60, 60)))
    hv[19:22, 29:32], hv[44:47, 14:17] = -16.0, -15.0
    rows = [(0, r, c, float(hv[r, c]), -12.0) for r in range(60) for c in range(60)]
    cells = spark.createDataFrame(rows, "g long, r int, c int, hv double, hh double")
    p = params.Window(guard=(2, 2), background=(10, 10), pfa=1e-4)
    trained = grid.training(cells, p).cache()
    for f in (grid.cell_averaging, grid.gamma_threshold):
        hits = grid.veto(f(trained, p)).where("hit")
        assert {(20, 30), (45, 15)} <= {(r.r, r.c) for r in hits.collect()} and hits.count() < 40
    labels = grid.label_components(grid.cell_averaging(trained, p).where("hit"))
    s = grid.component_stats(labels.join(cells, ["g", "r", "c"])).where("pixel_area >= 4").collect()
    assert sorted((x.r0, x.c0, x.r1, x.c1, x.pixel_area) for x in s) == [(19, 29, 22, 32, 9), (44, 14, 47, 17, 9)]


@pytest.mark.parametrize("tile", [4, 7, 16, 100])
def test_components_do_not_depend_on_tiles(spark, tile):
    rng = random.Random(7)
    cells = {(r, c) for r in range(20) for c in range(20) if rng.random() < 0.35}
    label = {x: x[0] * 2**20 + x[1] for x in cells}
    for _ in range(400):
        label = {(r, c): min(label[a, b] for a in (r - 1, r, r + 1) for b in (c - 1, c, c + 1) if (a, b) in cells) for r, c in cells}
    frame = spark.createDataFrame([(3, r, c) for r, c in cells], "g long, r int, c int")
    assert {(x.r, x.c): x.label for x in grid.label_components(frame, tile=tile).collect()} == label


def test_gamma_quantiles():
    assert grid.upper_gamma(1.0, 2.0) == pytest.approx(math.exp(-2)) and grid.upper_gamma(3.0, 5.0) == pytest.approx(math.exp(-5) * (1 + 5 + 12.5))
    t = grid.gamma_table(1e-3, 1.0, 4.0, 3)
    assert t[0] == pytest.approx(-math.log(1e-3)) and all(grid.upper_gamma(a, x) == pytest.approx(1e-3) for a, x in zip((1, 2, 4), t, strict=True))


def test_seams(spark):
    rng = random.Random(2)
    rows = [(0, r, c, -30 + (4.0 if c >= 20 else 0) + rng.random()) for r in range(15) for c in range(40)]
    got = grid.seam_columns(spark.createDataFrame(rows, "g long, r int, c int, hv double"), sigma=6.0, margin=2).where("excluded").collect()
    assert sorted(x.c for x in got) == [17, 18, 19, 20, 21, 22]


def test_study_area(spark):
    inside, outside = [(-52.0, 47.0), (-60.5, 58.0), (-44.0, 46.0), (-48.0, 52.0)], [(-44.0, 60.0), (-60.0, 45.0), (-43.9, 46.0), (-58.5, 51.5)]
    frame = spark.createDataFrame(inside + outside, "lon double, lat double")
    assert [r[0] for r in frame.select(spatial.covers(F.col("lon"), F.col("lat"))).collect()] == [True] * 4 + [False] * 4


def test_projection_and_distances(spark):
    frame = spark.createDataFrame([(-95.0, 49.0), (-52.0, 47.0)], "lon double, lat double")
    x, y = spatial.conic(F.col("lon"), F.col("lat"))
    a, b = frame.select(x.alias("x"), y.alias("y")).collect()
    assert abs(a.x) < 1e-6 and abs(a.y) < 1e-6 and b.x > 3_000_000
    d = spatial.geodesic(np.array([0.0, 10.0, 5.0]), np.array([0.0, 50.0, 5.0]), np.array([1.0, 10.0, 5.0]), np.array([0.0, 51.0, 5.0]))
    assert d[0] == pytest.approx(111319.49, abs=0.01) and d[1] == pytest.approx(111240.6, abs=5) and d[2] == 0
    got = frame.select(spatial.geodesic_m(F.lit(0.0), F.lit(0.0), F.col("lon"), F.col("lat")).alias("g"), spatial.haversine(F.lit(0.0), F.lit(0.0), F.col("lon"), F.col("lat")).alias("h")).collect()
    assert all(r.g == pytest.approx(r.h, rel=0.006) for r in got)
    assert spatial.shoelace(spatial.clip_convex([(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)])) == 1


def test_assignment_against_permutations(spark):
    rng = random.Random(3)
    edges = [(k, a, 100 + b, float(rng.randint(1, 30))) for k in range(3) for a in range(5) for b in range(5) if rng.random() < 0.45]
    got = matching.assign(spark.createDataFrame(edges, "k long, a long, b long, distance double"), "k").collect()
    for k in range(3):
        cost = {(a, b): c for x, a, b, c in edges if x == k}
        options = (list(zip(rows, cols, strict=True)) for n in range(6) for rows in itertools.combinations(range(5), n) for cols in itertools.permutations(range(100, 105), n))
        best = min((-len(u), sum(cost[p] for p in u)) for u in options if all(p in cost for p in u))
        mine = [r for r in got if r.k == k]
        assert (-len(mine), sum(r.distance for r in mine)) == best and len({r.a for r in mine}) == len({r.b for r in mine}) == len(mine)


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_suppression_against_a_loop(spark, rounds):
    """Ties, unknown scores, a chain along which scores climb, rows without links; by rounds, by components, and by both."""
    rng = random.Random(4)
    rows = [(i, rng.choice([None, float("nan"), *map(float, range(9))])) for i in range(60)] + [(100 + i, float(i)) for i in range(60)] + [(300, 1.0)]
    links = [(i, j) for i in range(60) for j in range(i) if rng.random() < 0.03] + [(100 + i, 101 + i) for i in range(59)] + [(5, 5), (101, 100)]
    near, kept = {i: {a + b - i for a, b in links if i in (a, b) and a != b} for i, _ in rows}, set()
    for i, _ in sorted(rows, key=lambda r: (math.inf if r[1] is None or math.isnan(r[1]) else -r[1], r[0])):
        if not near[i] & kept:
            kept.add(i)
    got = matching.suppress(spark.createDataFrame(rows, "id long, score double"), spark.createDataFrame(links, "a long, b long"), rounds)
    assert sorted(r.id for r in got.collect()) == sorted(kept)


def test_intervals():
    assert evaluate.interval(20, 20, 0) == (0, 0) and evaluate.interval(20, 20, 6) == (6, 6) and evaluate.interval(20, 4, 0)[1] > 0 and evaluate.interval(20, 4, 4)[1] == 20
    for n, s, k in ((12, 5, 2), (9, 3, 0), (10, 4, 4)):
        tail = lambda m, f: sum(math.comb(m, j) * math.comb(n - m, s - j) for j in range(s + 1) if f(j)) / math.comb(n, s)  # noqa: B023, E731
        fit = [m for m in range(k, n - s + k + 1) if tail(m, lambda j: j >= k) >= 0.025 and tail(m, lambda j: j <= k) >= 0.025]  # noqa: B023
        assert evaluate.interval(n, s, k) == (fit[0], fit[-1])
    with pytest.raises(ValueError):
        evaluate.interval(5, 6, 0)


def test_ledger_appends_and_refuses():
    e = ledgers.append([], [("mark", "a", {"x": 1}), ("mark", "b", {"y": 2.5})])
    assert ledgers.append(e, [("mark", "a", {"x": 1})]) == e
    with pytest.raises(ledgers.Refused):
        ledgers.append(e, [("mark", "c", {}), ("mark", "a", {"x": 2})])
    ledgers.verify(e)
    with pytest.raises(ledgers.Refused):
        ledgers.verify([e[0], ledgers.Event(2, "mark", "b", '{"y":3}', e[1].previous, e[1].sha)])
    with pytest.raises(ValueError):
        ledgers.canonical({"x": float("nan")})


def test_sealed_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, v string")
    ledgers.seal(rows, f"{tmp_path}/x", ["k"])
    assert ledgers.same(ledgers.load_sealed(spark, f"{tmp_path}/x", ["k"]), rows)
    with pytest.raises(Exception, match="exist"):
        ledgers.seal(rows, f"{tmp_path}/x", ["k"])
    rows.limit(1).write.mode("append").parquet(f"{tmp_path}/x")
    with pytest.raises(ledgers.Refused):
        ledgers.load_sealed(spark, f"{tmp_path}/x", ["k"])


def test_smallest_labels_of_a_long_chain(spark):
    links = spark.createDataFrame([(0, i, i + 1) for i in range(70)] + [(1, 5, 4)], "k long, a long, b long")
    got = {(r.k, r.node): r.label for r in graph.smallest_labels(links, "k").collect()}
    assert got == {(0, i): 0 for i in range(71)} | {(1, 4): 4, (1, 5): 4}


@pytest.mark.parametrize("ids", ["shuffled", "ascending"])
def test_components_of_long_chains_and_hubs(spark, ids):
    """A path of 5 000 nodes, a hub of 3 000 and a pair: few rounds, whatever the order of the ids."""
    n = list(range(5000))
    if ids == "shuffled":
        random.Random(7).shuffle(n)
    pairs = list(zip(n, n[1:])) + [(10_000, 10_000 + i) for i in range(1, 3000)] + [(20_001, 20_000), (20_001, 20_001), (5, None), (30_000, 30_000)]
    rounds = []
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), rounds).collect()}
    assert got == {i: 0 for i in n} | {10_000 + i: 10_000 for i in range(3000)} | {20_000: 20_000, 20_001: 20_000}
    assert len(rounds) <= 20 and rounds[-1] == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_supporting_observations_against_all_pairs(spark):
    """Poles, the date line and wide distances: the same counts as all with all."""
    rng = random.Random(8)
    place = lambda: (rng.choice([rng.uniform(-180, 180), rng.uniform(179, 181) - 360 * (rng.random() < 0.5), 180.0, -180.0]), rng.choice([rng.uniform(-90, 90), rng.uniform(84, 90), 90.0, -90.0]))
    marks = [(i, float(rng.randint(0, 50_000)), *place()) for i in range(150)]
    seen = [(i, float(rng.randint(0, 50_000)), *place()) for i in range(200)]
    m, o = spark.createDataFrame(marks, "mark long, t double, lon double, lat double"), spark.createDataFrame(seen, "obs long, t double, lon double, lat double")
    for metres in (50_000.0, 600_000.0, 3_000_000.0):
        got = {r.mark: (r.n, r.nearest_m) for r in records.supported(m, o, metres=metres).collect()}
        want = {}
        for i, t, lon, lat in marks:
            far = [d for _, t2, lon2, lat2 in seen if abs(t - t2) <= 21_600 and (d := sphere(lon, lat, lon2, lat2)) <= metres]
            if far:
                want[i] = (len(far), pytest.approx(min(far), abs=1e-3))
        assert got == want


def sphere(lon1, lat1, lon2, lat2):
    lon1, lat1, lon2, lat2 = map(math.radians, (lon1, lat1, lon2, lat2))
    a = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * spatial.EARTH_M * math.asin(math.sqrt(min(1.0, a)))


def test_sightings_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Sighting Date,SIGHTING_TIME,sighting_latitude,Sighting_Longitude,Source\n10/1/2020,21:33,48.5,52.1,AIR\n2020-10-02,45,47,-51,SHIP\nbad,1,47,-51,X\n2020-10-03,1200,10,-51,X\n")
    got = text.read_sightings(spark, f"{tmp_path}/a.csv").orderBy("day").collect()
    assert [(r.day, r.clock, r.lat, r.lon, r.source) for r in got] == [("2020-10-01", "2133", 48.5, -52.1, "AIR"), ("2020-10-02", "0045", 47.0, -51.0, "SHIP")]
    for body, match in (("date,sighting_date,lat,lon\n1,2,3,4\n", "2 columns"), ("date,lat,lon\nbad,1,2\n", "no row")):
        (tmp_path / "b.csv").write_text(body)
        with pytest.raises(ValueError, match=match):
            text.read_sightings(spark, f"{tmp_path}/b.csv")


def test_annotation_vectors_and_orbit_names(spark):
    xml = "<c><list><v><line>0</line><pixel count='3'>0 40 80</pixel><sigma>1.5 2 2.5</sigma></v><v><line>10</line><pixel>0 40</pixel><sigma>3 4</sigma></v></list></c>"
    f = {"line": "line", "pixel": "pixel", "value": "sigma"}
    got = text.vectors(spark.createDataFrame([("f", xml)], "file string, xml string"), "c/list/v", f).collect()
    assert sorted((r.line, r.pixel, r.value) for r in got) == [(0, 0, 1.5), (0, 40, 2.0), (0, 80, 2.5), (10, 0, 3.0), (10, 40, 4.0)]
    with pytest.raises(Exception, match="unequal length"):
        text.vectors(spark.createDataFrame([("f", xml.replace("3 4<", "3<"))], "file string, xml string"), "c/list/v", f).collect()
    names = spark.createDataFrame([("S1A_OPER_AUX_POEORB_OPOD_20200520T120000_V20200429T225942_20200501T005942.EOF",), ("other",)], "name string")
    a, b = text.orbit_names(names).collect()
    assert (a.platform, a.kind, a.begins.day) == ("S1A", "POEORB", 29) and b.platform is None and b.ends is None


def test_match_of_sightings_against_a_loop(spark):
    rng = random.Random(8)
    make = lambda n: [(i, rng.randint(0, 40000), rng.uniform(-20000, 20000), rng.uniform(-20000, 20000)) for i in range(n)]
    a, b = make(60), make(60)
    got = matching.near(spark.createDataFrame(a, "a long, t long, x double, y double"), spark.createDataFrame(b, "b long, t long, x double, y double"), 7200.0)
    want = {(i, j) for i, t, x, y in a for j, u, v, w in b if abs(t - u) <= 7200 and math.hypot(x - v, y - w) <= max(500, 0.5 * abs(t - u))}
    assert {(r.a, r.b) for r in got.collect()} == want and got.count() == len(want)
