import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import brackets, cuts


@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_bracket_against_plain(spark, width):
    """Ties, empty cells between knots, samples outside, keys without knots, repeated knots and samples, null times."""
    rng = random.Random(13)
    knots = [(k, float(rng.randint(-200, 200) if k else rng.randint(-9, 9)), rng.random()) for k in (0, 1, 2) for _ in range(40 if k < 2 else 1)]
    samples = [(k, i, float(rng.randint(-220, 220))) for k in (0, 1, 2, 3) for i in range(60)] + [(0, 0, 3.0), (0, 0, 3.0), (1, 99, None), (None, 98, 1.0)]
    k, s = spark.createDataFrame([*knots, (None, 1.0, 1.0), (0, None, 2.0)], "k long, t double, p double"), spark.createDataFrame(samples, "k long, i long, t double")
    got = sorted((r.k is None, r.k or 0, r.i, r.t is None, r.t or 0, r.before and tuple(r.before), r.after and tuple(r.after)) for r in brackets.bracket(s, k, "k", width).collect())
    want = []
    for key, i, t in samples:
        own = [x[1:] for x in knots if x[0] == key]
        before = max((x for x in own if t is not None and x[0] <= t), default=None)
        after = [x for x in own if t is not None and x[0] > t]
        after = max(x for x in after if x[0] == min(after)[0]) if after else None
        want.append((key is None, key or 0, i, t is None, t or 0, before, after))
    assert got == sorted(want)


def test_hermite_is_exact_on_cubics(spark):
    f, g = lambda x: 2 - x + 0.5 * x**2 - 0.25 * x**3, lambda x: -1 + x - 0.75 * x**2
    at = [-3.0, -1.0, 0.5, 2.0, 4.0]
    knots = spark.createDataFrame([(0, x, f(x), g(x)) for x in at], "k long, t double, p double, v double")
    samples = spark.createDataFrame([(0, float(x)) for x in np.linspace(-4, 5, 91)] + [(0, 4.0)], "k long, t double")
    p, v = brackets.hermite(F.col("t"), F.col("before"), F.col("after"), "p", "v")
    for r in brackets.bracket(samples, knots, "k", 1.0).select("t", p.alias("p"), v.alias("v")).collect():
        if -3 <= r.t <= 4:
            assert r.p == pytest.approx(f(r.t), abs=1e-9) and r.v == pytest.approx(g(r.t), abs=1e-9)
        else:
            assert r.p is None and r.v is None


@pytest.mark.parametrize("tile", [1, 4, 64])
@pytest.mark.parametrize("size", [1, 4, 5])
def test_chips_against_slices(spark, tile, size):
    """Only whole chips, in row order, across up to four tiles and more; negative rows too."""
    rng = np.random.default_rng(14)
    v = rng.normal(size=(17, 19))
    rows = [(0, r - 6, c, float(v[r, c])) for r in range(17) for c in range(19) if (r, c) != (9, 9)]
    px = spark.createDataFrame(rows, "g long, r int, c int, v double")
    centres = spark.createDataFrame([(0, i, r, c) for i, (r, c) in enumerate([(-6, 0), (-3, 3), (0, 8), (2, 9), (5, 12), (10, 18), (8, 16), (50, 50), (-3, 3)])], "g long, id long, r int, c int")
    got = {x.id: x for x in cuts.cut(px, cuts.centred(centres, size), {"v": F.col("v"), "w": F.col("v") * 2}, tile=tile).collect()}
    v[9, 9] = np.nan
    for x in centres.collect():
        r0, c0 = x.r + 6 - size // 2, x.c - size // 2
        whole = r0 >= 0 and c0 >= 0 and r0 + size <= 17 and c0 + size <= 19 and not np.isnan(v[r0 : r0 + size, c0 : c0 + size]).any()
        assert (x.id in got) == whole
        if whole:
            assert got[x.id].v == v[r0 : r0 + size, c0 : c0 + size].ravel().tolist() and got[x.id].w == [2 * y for y in got[x.id].v]


def test_clipped_windows(spark):
    extent = spark.createDataFrame([(0, 10, 8)], "g long, rows int, cols int")
    w = spark.createDataFrame([(0, 1, -2.5, 1.2, 3.1, 4.0), (0, 2, 8.9, 7.0, 30.0, 7.5), (0, 3, 10.0, 0.0, 12.0, 3.0), (0, 4, 0.0, 0.0, 10.0, 8.0)], "g long, id long, r0 double, c0 double, r1 double, c1 double")
    got = {r.id: (r.r0, r.c0, r.r1, r.c1, r.too_large) for r in cuts.clipped(w, extent, most=40).collect()}
    assert got == {1: (0, 1, 4, 4, False), 2: (8, 7, 10, 8, False), 4: (0, 0, 10, 8, True)}
    with pytest.raises(ValueError):
        cuts.centred(w, 0)


def test_bracket_joins_no_samples(spark):
    """What the cells around hold comes as a row, not by a join that sorts the samples once more."""
    s, k = spark.range(50).selectExpr("id % 3 AS k", "id * 1.0D AS t", "id AS i"), spark.range(20).selectExpr("id % 3 AS k", "id * 2.5D AS t", "id AS v")
    plan = brackets.bracket(s, k, "k", 5.0)._jdf.queryExecution().optimizedPlan().toString()
    assert [x.split("Join ")[1].split(",")[0] for x in plan.split("\n") if "Join " in x] == ["FullOuter"]
