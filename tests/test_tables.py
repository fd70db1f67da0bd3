import random

import numpy as np
import pytest

from tidegrid.operators import calibration, tables
from tidegrid.sources import text


def knots_of(rng, name):
    lines, pixels = sorted(rng.sample(range(-20, 60), rng.randint(1, 6))), sorted(rng.sample(range(-5, 40), rng.randint(1, 6)))
    rows = [(name, a, b, rng.uniform(-3, 9)) for a in lines for b in pixels if rng.random() < 0.7]
    have = {r[1] for r in rows}
    return rows + [(name, a, pixels[0], rng.uniform(-3, 9)) for a in lines if a not in have]


@pytest.mark.parametrize("extrapolate", [False, True])
def test_tables_against_the_kernel(spark, extrapolate):
    """Holes, single lines and pixels, cells far outside, several files; a file without cells, cells without a file."""
    rng = random.Random(17)
    knots = [r for k in range(6) for r in knots_of(rng, f"f{k}")]
    cells = [(f"f{k}", r, c) for k in range(7) for r in range(-30, 70, 7) for c in range(-9, 45, 4)]
    got = {(r.file, r.line, r.pixel): r.value for r in tables.interpolated(spark.createDataFrame(cells, "file string, line int, pixel int"), spark.createDataFrame(knots, "file string, line int, pixel int, value double"), extrapolate_lines=extrapolate, extrapolate_pixels=extrapolate).collect()}
    assert {k[0] for k in got} == {f"f{k}" for k in range(6)}
    for k in range(6):
        own = [r for r in knots if r[0] == f"f{k}"]
        r, c = sorted({x[1] for x in cells}), sorted({x[2] for x in cells})
        want = calibration.lut(*(np.array([x[i] for x in own]) for i in (1, 2, 3)), np.array(r), np.array(c), extrapolate)
        for i, a in enumerate(r):
            for j, b in enumerate(c):
                assert got[f"f{k}", a, b] == pytest.approx(want[i, j], abs=1e-9)


def test_tables_refuse(spark):
    cells = spark.createDataFrame([("f", 0, 0)], "file string, line int, pixel int")
    schema = "file string, line int, pixel int, value double"
    for rows, words in (([("f", 0, 0, None)], "without values"), ([("f", 0, 0, 1.0), ("f", 0, 0, 2.0)], "two values")):
        with pytest.raises(Exception, match=words):
            tables.interpolated(cells, spark.createDataFrame(rows, schema)).collect()


def line(at, xs, ys):
    if len(xs) == 1:
        return ys[0]
    k = min(max(np.searchsorted(xs, at, "right") - 1, 0), len(xs) - 2)
    return ys[k] + (at - xs[k]) * (ys[k + 1] - ys[k]) / (xs[k + 1] - xs[k])


def test_noise_power_of_blocks(spark):
    """Blocks go by their own vectors; a short one by the nearest qualified vector of its swath; the later of two blocks holds."""
    vec = {0: [(0, 4.0), (10, 6.0), (20, 5.0)], 8: [(0, 5.0), (20, 9.0)], 30: [(2, 3.0), (12, 5.0), (20, 8.0)], 60: [(0, 0.0), (20, 0.0)]}
    knots = [("f", a, b, v) for a, own in vec.items() for b, v in own]
    blocks = [("f", 1, "w1", 0, 10, 0, 12), ("f", 2, "w1", 10, 14, 0, 12), ("f", 3, "w2", 0, 40, 12, 20), ("f", 4, "w1", 5, 8, 0, 11)]
    factors = [("f", 1, 0, 1.0), ("f", 1, 6, 1.6), ("f", 2, 11, 2.0), ("f", 3, 0, 1.0), ("f", 3, 39, 2.0), ("f", 4, 6, 3.0)]
    cells = [("f", r, c) for r in range(0, 45) for c in range(0, 22)]
    make = spark.createDataFrame
    args = make(blocks, "file string, block int, swath string, r0 int, r1 int, c0 int, c1 int"), make(knots, "file string, line int, pixel int, value double"), make(factors, "file string, block int, line int, value double")
    got = {(r.line, r.pixel): (r.block, r.noise) for r in tables.noise_power(make(cells, "file string, line int, pixel int"), *args, tile=7).collect()}
    want = {}
    for _, b, _, r0, r1, c0, c1 in blocks:
        own = [a for a in vec if r0 <= a < r1] or [0]  # line 8 has one value in the columns, lines beyond 14 are out of the swath
        use = {a: vec[a] for a in own}
        fell = not [a for a in vec if r0 <= a < r1]
        pixels = sorted({p for v in use.values() for p, _ in v})
        grid = {a: [np.interp(p, *zip(*v, strict=True)) for p in pixels] for a, v in use.items()}
        scale = [(a, v) for _, k, a, v in factors if k == b]
        for r in range(r0, r1):
            for c in range(c0, c1):
                at = [line(c, pixels, grid[a]) if fell else np.interp(c, pixels, grid[a]) for a in sorted(use)]
                want[r, c] = (b, pytest.approx(line(r, sorted(use), at) * line(r, *zip(*scale, strict=True)), abs=1e-9))
    assert got == want
    with pytest.raises(Exception, match="no qualified"):
        lone = make([("f", 9, "w9", 50, 52, 0, 20)], args[0].schema)
        tables.noise_power(make([("f", 50, 1)], "file string, line int, pixel int"), lone, args[1], args[2]).collect()


def test_vectors_by_newer_and_legacy_names(spark):
    body = lambda item, tag, v: f"<{item}><line>3</line><pixel>1 2</pixel><{tag}>{v}</{tag}></{item}>"
    files = [("new", f"<a>{body('noiseRangeVector', 'noiseRangeLut', '5 6')}{body('noiseVector', 'noiseLut', '7 8')}</a>"), ("old", f"<a>{body('noiseVector', 'noiseLut', '7 8')}</a>"), ("none", "<a/>")]
    got = sorted(map(tuple, text.first_vectors(spark.createDataFrame(files, "file string, xml string"), text.NOISE).collect()))
    assert got == [("new", 3, 1, 5.0), ("new", 3, 2, 6.0), ("old", 3, 1, 7.0), ("old", 3, 2, 8.0)]
