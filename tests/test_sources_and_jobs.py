import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import jobs, refusals
from tidegrid.operators import calibration, review
from tidegrid.operators.ledgers import Refused
from tidegrid.params import Window
from tidegrid.sources import rasters


def write_scene(folder, hv, **more):
    folder.mkdir(parents=True)
    n = {"hv": hv, "hh": hv + 8, "incidence": np.full(hv.shape, 35.0), "zone": np.full(hv.shape, 9)} | more
    for k, v in n.items():
        np.save(folder / f"{k}.npy", v)


def test_scene_source(spark, tmp_path):
    rng = np.random.default_rng(1)
    hv = rng.normal(-30, 1, (20, 33))
    hv[3, 4], hv[5, 6] = -9999, np.nan
    write_scene(tmp_path / "a", hv, lat=np.full(hv.shape, 48.0), lon=np.full(hv.shape, -50.0))
    write_scene(tmp_path / "b", hv + 1, lat=np.full(hv.shape, 70.0), lon=np.full(hv.shape, -50.0))
    (tmp_path / "c").mkdir()
    spark.dataSource.register(rasters.SceneSource)
    with pytest.raises(Exception, match="hv.npy"):
        spark.read.format("scene_tiles").option("tile", 8).load(str(tmp_path)).count()
    tiles = spark.read.format("scene_tiles").option("tile", 8).option("skipCorrupt", "true").load(str(tmp_path))
    assert tiles.count() == 2 * 3 * 5
    cells = rasters.eligible(rasters.pixels(tiles))
    got = {(r.r, r.c): r for r in cells.where("scene_id = 'a'").collect()}
    assert len(got) == 20 * 33 and got[0, 32].hv == hv[0, 32] and got[19, 0].hv == hv[19, 0] and got[3, 4].hv is None and not got[5, 6].valid and got[1, 1].valid
    index = rasters.extents(cells)
    assert {r.scene_id for r in rasters.pruned(cells, index, -60, 42, -44, 60).select("scene_id").distinct().collect()} == {"a"}
    stack = cells.withColumn("ratio", F.col("hh") - F.col("hv"))
    rasters.write_stack(stack.where("valid"), f"{tmp_path}/out")
    with pytest.raises(ValueError, match="ratio_off"):
        rasters.write_stack(stack.where("valid").withColumn("ratio", F.col("ratio") + 1), f"{tmp_path}/out2")


def test_detect_job(spark):
    rng = np.random.default_rng(42)
    hv = 10 * np.log10(rng.exponential(10**-3.2, (50, 50)))
    hv[19:22, 29:32] = -16.0
    cells = spark.createDataFrame([(0, r, c, float(hv[r, c]), float(min(hv[r, c] + 8, -8))) for r in range(50) for c in range(50)], "g long, r int, c int, hv double, hh double")
    got = jobs.detect(cells, Window(guard=(2, 2), background=(10, 10), pfa=1e-4)).where("first_rejection IS NULL").collect()
    assert [(x.r0, x.c0, x.pixel_area) for x in got] == [(19, 29, 9)]
    with pytest.raises(ValueError):
        jobs.detect(cells, kind="other")


def test_batch_job(spark):
    def one(scene):
        if scene == "b":
            raise OSError("gone")

    got = jobs.batch(spark, ["a", "b", "c"], one, spark.createDataFrame([("c",)], "scene string")).collect()
    assert [(r.scene, r.status) for r in got] == [("a", "done"), ("b", "failed"), ("c", "stored")] and "gone" in got[1].reason


def test_lookup_tables():
    lines, pixels = np.repeat([0, 10], 3), np.tile([0, 20, 40], 2)
    values = lines * 2.0 + pixels * 0.5
    got = calibration.lut(lines[1:], pixels[1:], values[1:], np.array([0, 5, 10, 20]), np.array([30, 40, 60]))
    assert np.allclose(got[:3, :2], np.array([[15, 20], [25, 30], [35, 40]])) and np.allclose(got[3], got[2]) and np.allclose(got[:, 2], got[:, 1])
    assert np.allclose(calibration.lut(lines, pixels, values, np.array([20]), np.array([60]), True), 70)


def test_noise_blocks():
    vectors = {0: (np.array([0, 9]), np.array([2.0, 2.0])), 8: (np.array([0, 9]), np.array([4.0, 0.0]))}
    blocks = [{"line0": 0, "line1": 4, "pixel0": 0, "pixel1": 9, "line": [0, 4], "factor": [1.0, 3.0]}, {"line0": 5, "line1": 6, "pixel0": 0, "pixel1": 4, "line": [5], "factor": [1.0]}]
    got = calibration.noise_power(blocks, vectors, (7, 10))
    assert np.allclose(got[0], 2) and np.allclose(got[4], 6) and np.allclose(got[5, :5], 4) and np.isnan(got[5, 5:]).all()


def test_geometry_on_a_circular_orbit(spark):
    radius, rate = 7_070_000.0, 1.05e-3
    times = np.linspace(-60, 60, 13)
    a = rate * times
    pos = radius * np.stack([np.cos(a), np.zeros_like(a), np.sin(a)], -1)
    vel = radius * rate * np.stack([-np.sin(a), np.zeros_like(a), np.cos(a)], -1)
    x, v = calibration.hermite(times, pos, vel, np.array([3.3]))
    assert np.allclose(np.linalg.norm(x), radius, rtol=1e-9) and np.isnan(calibration.hermite(times, pos, vel, np.array([100.0]))[0]).all()
    t, r = calibration.zero_doppler(np.array([3.0, 3.0]), np.array([0.0, 1.0]), times, pos, vel)
    assert abs(t[0]) < 1e-6 and t[1] > 10 and 690_000 < r[0] < 800_000
    got = calibration.geocoded(spark.createDataFrame([(3.0, 0.0)], "lon double, lat double"), (times, pos, vel)).first()
    assert abs(got.time) < 1e-6


def test_registration(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(32, 40))
    assert calibration.shift(a, np.roll(a, (3, -5), (0, 1))) == (3, -5)
    got = calibration.shifts(spark.createDataFrame([(1, 32, 40, a.ravel().tolist(), np.roll(a, (-2, 4), (0, 1)).ravel().tolist())], "k long, h int, w int, reference array<double>, moving array<double>"), "k").first()
    assert (got.rows, got.cols) == (-2, 4)
    assert len(calibration.fixed_windows(1000, 900, 100)) == 9
    with pytest.raises(ValueError):
        calibration.fixed_windows(100, 100, 100)


RESPONSE = "task_id string, phase string, reviewer string, status string, begun timestamp, ended timestamp, marks array<struct<r:int,c:int,label:string>>"


def test_review_workflow(spark):
    now = dt.datetime(2020, 5, 1)
    tasks = spark.createDataFrame([("t1", "p", "x", "candidate", 0, 0, 10, 10), ("t2", "p", "x", "candidate", 0, 0, 10, 10)], "task_id string, phase string, reviewer string, mode string, r0 int, c0 int, r1 int, c1 int")
    row = lambda task, marks, status="complete", ended=now: (task, "p", "x", status, now, ended, marks)
    frame = lambda *rows: spark.createDataFrame(list(rows), RESPONSE)
    good, none = frame(row("t1", [(1, 1, "target")])), spark.createDataFrame([], RESPONSE)
    assert review.imported(none, good, tasks).count() == 1 and review.imported(good, good, tasks).count() == 0
    with pytest.raises(Refused):
        review.imported(good, frame(row("t1", [(1, 1, "uncertain")])), tasks)
    bad = frame(row("t9", [(1, 1, "target")]), row("t1", [(1, 10, "other")]), row("t2", [], ended=now - dt.timedelta(1)))
    reasons = {r.task_id: set(r.reasons) for r in review.faults(bad, tasks).collect()}
    assert reasons == {"t9": {"not issued"}, "t1": {"unknown label", "mark outside the core"}, "t2": {"times out of order", "a candidate needs one mark"}}
    with pytest.raises(Refused):
        review.imported(none, bad, tasks)
    with pytest.raises(Refused):
        review.frozen(tasks, good, spark.createDataFrame([], "task_id string, label string"))
    assert {r.task_id: r.label for r in review.frozen(tasks, good, spark.createDataFrame([("t2", "non_target")], "task_id string, label string")).collect()} == {"t1": "target", "t2": "non_target"}
    held = spark.createDataFrame([("t1", "d1"), ("t2", "d2")], "task_id string, digest string")
    assert dict(map(tuple, review.adopted(held, spark.createDataFrame([("t1", "d1", "d3")], "task_id string, of string, digest string")).collect())) == {"t1": "d3", "t2": "d2"}
    with pytest.raises(Refused):
        review.adopted(held, spark.createDataFrame([("t1", "d2", "d3")], "task_id string, of string, digest string"))
    assert review.repeats(good, "x", 0.1, 3).count() == 1
    assert review.due(good, 7).first().not_before == now + dt.timedelta(7)


def test_page_envelope(spark):
    p = review.page_of(spark.range(10), lambda r: r.id % 2 == 0, 4, 2, "id")
    assert [r.id for r in p.items] == [2, 4] and p.next_offset == 6
    assert review.page_of(spark.range(10), lambda r: True, 4, 8, "id").next_offset is None


@pytest.mark.parametrize("name", sorted(refusals.REASONS))
def test_refusals(name):
    with pytest.raises(refusals.Unavailable, match=name):
        refusals.unavailable(name, 1, x=2)
