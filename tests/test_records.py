import math
import random

"""Small cases of the operators on records, by plain rules."""

from pyspark.sql import functions as F

from tidegrid.operators import records as rec


def test_score_bound_and_unknown(spark):
    rows = spark.createDataFrame([(1, None), (2, 0.2), (3, 0.9)], "id int, score double")
    ids = lambda least: sorted(r.id for r in rows.where(rec.at_least(F.col("score"), least)).collect())
    assert ids(0.0) == [1, 2, 3]
    assert ids(0.5) == [3]


def test_groups_by_any_link(spark):
    day = 86400.0
    rows = [
        (1, "a", "h1", 0.0, 0.0, 0.0),
        (2, "a", "h2", 900 * day, 9e6, 0.0),  # the acquisition of 1
        (3, None, "h2", 500 * day, 5e6, 0.0),  # the content of 2
        (4, None, "h4", 500 * day + 7 * day, 5e6 + 1e4, 0.0),  # at both bounds of 3
        (5, None, "h5", 500 * day + 15 * day, 5e6, 0.0),  # too late for 3 and 4
        (6, None, None, 0.0, 3e6, 0.0),
        (7, None, None, 0.0, 7e6, 0.0),  # unknown hashes are not alike
    ]
    r = spark.createDataFrame(rows, "id long, acquisition string, hash string, t double, x double, y double")
    got = {x.id: x.group_id for x in rec.grouped(r, rec.record_links(r)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}


def test_amendments_extend_the_active_answer(spark):
    rows = [
        ("p", 1, 0, "response", "k0", None), ("p", 1, 1, "amendment", "k1", "k0"), ("p", 1, 2, "amendment", "k2", "k1"),
        ("p", 2, 0, "response", "m0", None), ("p", 2, 1, "amendment", "m1", "m0"), ("p", 2, 2, "amendment", "m2", "m0"),
        ("q", 1, 0, "amendment", "n0", "k0"),
    ]
    got = rec.amended(spark.createDataFrame(rows, "reviewer string, task int, seq int, kind string, key string, previous string")).collect()
    assert {(r.reviewer, r.task): (r.active, r.amendments, r.sound) for r in got} == {("p", 1): ("k2", 2, True), ("p", 2): ("m2", 2, False), ("q", 1): ("n0", 1, False)}


def test_kappa_is_unknown_for_one_label(spark):
    rows = spark.createDataFrame([("x", "t", "t"), ("x", "t", "t"), ("y", "t", "u"), ("y", "u", "t")], "g string, a string, b string")
    got = {r.g: (r.observed, r.kappa) for r in rec.agreement(rows, "a", "b", "g").collect()}
    assert got == {"x": (1.0, None), "y": (0.0, -1.0)}


def test_paths_times_zones(spark):
    one = spark.createDataFrame([("a/../../b", "2024-01-01T00:00:00", 41.02), ("..", "2024-01-01T01:00:00+01:00", -0.005), ("a//./b:c", "2024-01-01T00:00:00Z", None)], "p string, s string, z double")
    got = one.select(rec.inside_root(F.col("p")), rec.item_name(F.col("p")), rec.utc(F.col("s")), rec.zones(F.col("z"))).collect()
    at = 1704067200 * 10**6
    assert [tuple(r) for r in got] == [(False, "a_.._.._b", None, None), (False, None, at, 0), (True, "a__._b_c", at, -1)]


def test_pilot_tells_of_more_rows(spark):
    rows = spark.range(5)
    assert [(r.id, r.truncated) for r in rec.pilot(rows, 3, F.desc("id")).orderBy("id").collect()] == [(2, True), (3, True), (4, True)]
    assert {r.truncated for r in rec.pilot(rows, 5, F.col("id")).collect()} == {False}


def test_receipts_keep_what_stood_there(spark):
    stored = spark.createDataFrame([("a", "read", ["x"])], "product string, failed_stage string, reasons array<string>")
    new = spark.createDataFrame([("a", 2, "warp", "y"), ("a", 1, "read", "x"), ("b", 1, "read", "z")], "product string, seq int, stage string, reason string")
    got = {r["product"]: (r.failed_stage, r.reasons) for r in rec.receipts(stored, new).collect()}
    assert got == {"a": ("warp", ["x", "y"]), "b": ("read", ["z"])}


def test_links_of_places_against_all_pairs(spark):
    """The groups are those of all pairs within the bounds, with few links where a place has many records."""
    rng = random.Random(19)
    places = [(rng.uniform(0, 60_000), rng.uniform(0, 60_000)) for _ in range(25)]
    rows = [(i, None, None, rng.uniform(0, 60) * 86_400, *rng.choice(places)) for i in range(120)] + [(1000 + i, None, None, 200 * 86_400.0 + i * 400, 5.0, 5.0) for i in range(1500)]
    label = {r[0]: r[0] for r in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(rows[:121]):
        for b in rows[:k]:
            if abs(a[3] - b[3]) <= 7 * 86_400 and math.hypot(a[4] - b[4], a[5] - b[5]) <= 10_000:
                x, y = root(a[0]), root(b[0])
                label[max(x, y)] = min(x, y)
    r = spark.createDataFrame(rows, "id long, acquisition string, hash string, t double, x double, y double")
    links = rec.record_links(r)
    assert links.count() < 5000
    got = {x.id: x.group_id for x in rec.grouped(r, links).collect()}
    assert got == {i: root(i) if i < 1000 else 1000 for i in label}
