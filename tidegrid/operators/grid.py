"""Dense-grid operators on (r, c) cells: box sums, thresholds, seams, dilation, interpolation.

A grid's key column `g` (one scene or tile) leads every partitioning, so scenes are independent and spread over the
cluster; within a scene rows and then columns are windows of bounded frames.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.params import Window as Half


def densify(cells: DataFrame, keys: tuple[str, ...] = ("g",)) -> DataFrame:
    """All cells of each grid's bounding box; missing ones have nulls. The box is made by two sequences, not by a join of data."""
    box = cells.groupBy(*keys).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    full = box.select(*keys, F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1").select(*keys, "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    return full.join(cells, [*keys, "r", "c"], "left")


def box_sums(dense: DataFrame, values: Iterable[str], name: str, h: int, w: int, keys: tuple[str, ...] = ("g",)) -> DataFrame:
    """Adds {name}_{value}: sums over the (2h+1) x (2w+1) box around each cell, clipped to the grid; nulls count as 0."""
    across = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-w, w)
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-h, h)
    values = list(values)
    rows = dense.withColumns({f"_{name}_{v}": F.sum(F.coalesce(F.col(v), F.lit(0.0))).over(across) for v in values})
    return rows.withColumns({f"{name}_{v}": F.sum(f"_{name}_{v}").over(down) for v in values}).drop(*(f"_{name}_{v}" for v in values))


def prepared(cells: DataFrame, p: Half) -> DataFrame:
    """Cells with valid (1.0 or null) and power (floored, null where invalid)."""
    hv = F.col("hv")
    ok = hv.isNotNull() & ~F.isnan(hv) & (hv > -90.0) & (hv < 1540.0)
    return cells.withColumn("power", F.when(ok, F.greatest(F.pow(F.lit(10.0), hv / 10), F.lit(p.floor)))).withColumn("one", F.when(ok, F.lit(1.0))).withColumn("square", F.col("power") * F.col("power"))


def training(cells: DataFrame, p: Half, keys: tuple[str, ...] = ("g",)) -> DataFrame:
    """Dense cells with n, s and q: count, sum and sum of squares of valid power in the background without the guard."""
    rows = prepared(densify(cells, keys), p)
    rows = box_sums(rows, ("one", "power", "square"), "bg", *p.background, keys)
    rows = box_sums(rows, ("one", "power", "square"), "gd", *p.guard, keys)
    out = {n: F.col(f"bg_{v}") - F.col(f"gd_{v}") for n, v in (("n", "one"), ("s", "power"), ("q", "square"))}
    return rows.withColumns(out).drop(*(f"{b}_{v}" for b in ("bg", "gd") for v in ("one", "power", "square")))


def analysed(p: Half, least: int) -> Column:
    """Valid cells with enough training cells; the need is that of an unclipped window, so borders are not analysed."""
    return F.col("power").isNotNull() & (F.col("n") >= p.needed(least))


def cell_averaging(rows: DataFrame, p: Half) -> DataFrame:
    """rows of training() with mean, threshold, analysed and hit."""
    n = F.greatest(F.col("n"), F.lit(8.0))
    alpha = n * F.expm1(F.lit(-math.log(p.pfa)) / n)
    rows = rows.withColumn("mean", F.col("s") / n).withColumn("threshold", alpha * F.col("s") / n).withColumn("analysed", analysed(p, 8))
    return rows.withColumn("hit", F.col("analysed") & (F.col("power") > F.col("threshold")))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series below a + 1 and a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - scale * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / max(abs(an * d + b), tiny) * (1 if an * d + b >= 0 else -1)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def gamma_table(pfa: float, low: float = 0.1, high: float = 50.0, points: int = 1024) -> np.ndarray:
    """Quantiles x with upper_gamma(nu, x) = pfa on a logarithmic grid of shapes, by bisection."""
    out = []
    for nu in np.exp(np.linspace(math.log(low), math.log(high), points)):
        a, b = 0.0, 10.0 + 2 * nu
        while upper_gamma(nu, b) > pfa:
            b *= 2
        for _ in range(100):
            m = (a + b) / 2
            a, b = (m, b) if upper_gamma(nu, m) > pfa else (a, m)
        out.append((a + b) / 2)
    return np.array(out)


def gamma_threshold(rows: DataFrame, p: Half, points: int = 1024) -> DataFrame:
    """rows of training() with shape, threshold, analysed and hit; quantiles from a table of `points` numbers, interpolated in the shape's logarithm."""
    table = gamma_table(p.pfa, points=points)
    step = (math.log(50.0) - math.log(0.1)) / (points - 1)
    n = F.greatest(F.col("n"), F.lit(12.0))
    mean = F.col("s") / n
    spread = F.greatest(n / (n - 1) * (F.col("q") / n - mean * mean), F.lit(2.2250738585072014e-308))
    rows = rows.withColumn("mean", mean).withColumn("shape", F.greatest(F.lit(0.1), F.least(F.lit(50.0), mean * mean / spread)))
    at = (F.log("shape") - math.log(0.1)) / step
    values = F.array(*(F.lit(float(x)) for x in table))
    k = F.greatest(F.lit(0), F.least(F.lit(points - 2), F.floor(at).cast("int")))
    lower, upper = F.get(values, k), F.get(values, k + 1)
    rows = rows.withColumn("threshold", F.col("mean") / F.col("shape") * (lower + (upper - lower) * (at - k))).withColumn("analysed", analysed(p, 12))
    return rows.withColumn("hit", F.col("analysed") & (F.col("power") > F.col("threshold")))


def veto(rows: DataFrame, most_db: float = 20.0) -> DataFrame:
    """Hits only where HH is known and not more than `most_db` above HV."""
    return rows.withColumn("hit", F.col("hit") & F.coalesce((F.col("hh") > -90.0) & (F.col("hh") - F.col("hv") <= most_db), F.lit(False)))


def seam_columns(cells: DataFrame, sigma: float = 6.0, groups: int = 6, margin: int = 8, keys: tuple[str, ...] = ("g",)) -> DataFrame:
    """(keys, c, z, seam, excluded): columns whose step in the median profile stands out, the strongest runs, widened."""
    order = Window.partitionBy(*keys).orderBy("c")
    span = F.when(F.lead("c").over(order).isNull() | F.lag("c").over(order).isNull(), 1).otherwise(2)
    profile = cells.groupBy(*keys, "c").agg(F.median("hv").alias("m"))
    step = (F.coalesce(F.lead("m").over(order), F.col("m")) - F.coalesce(F.lag("m").over(order), F.col("m"))) / span
    steps = profile.withColumn("step", step)
    middle = steps.groupBy(*keys).agg(F.median("step").alias("mid"))
    spread = steps.join(middle, list(keys)).groupBy(*keys).agg(F.first("mid").alias("mid"), F.median(F.abs(F.col("step") - F.col("mid"))).alias("mad"))
    mad = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.lit(2.220446049250313e-16) * F.greatest(F.lit(1.0), F.abs("mid")))
    rows = steps.join(spread, list(keys)).withColumn("z", F.abs((F.col("step") - F.col("mid")) / (1.4826 * mad))).withColumn("flag", F.coalesce(F.col("z") > sigma, F.lit(False)))
    rows = islands(rows, "flag", keys, "c")
    strength = rows.where("flag").groupBy(*keys, "run").agg(F.max("z").alias("peak"))
    strength = strength.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("peak"), F.desc("run")))).where(F.col("k") <= groups)
    rows = rows.join(strength.select(*keys, "run", "k"), [*keys, "run"], "left").withColumn("seam", F.col("flag") & F.col("k").isNotNull())
    wide = order.rowsBetween(-margin, margin)
    return rows.withColumn("excluded", F.max("seam").over(wide)).select(*keys, "c", "z", "seam", "excluded")


def islands(rows: DataFrame, flag: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """Adds `run`: numbers of maximal runs of equal flags along `order`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_turn", F.when(F.col(flag) != F.lag(flag).over(w), 1).otherwise(0)).withColumn("run", F.sum("_turn").over(w)).drop("_turn")


def label_components(hits: DataFrame, key: str = "g", tile: int = 256) -> DataFrame:
    """(key, r, c, label) of cells by 8-connectivity; label is the component's first cell in scan order, r * 2**20 + c.

    Tiles are labelled on their own; labels that meet across tiles are links, whose components are found by rounds of
    smallest labels. Results do not depend on the tiles.
    """
    schema = f"{key} long, r int, c int, own long"

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame.r.to_numpy(np.int64), frame.c.to_numpy(np.int64)
        code = r * (1 << 20) + c
        order = np.argsort(code)
        code, parent = code[order], np.arange(len(code))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for shift in (1, (1 << 20) - 1, 1 << 20, (1 << 20) + 1):
            at = np.searchsorted(code, code + shift)
            for i in np.flatnonzero(code[np.minimum(at, len(code) - 1)] == code + shift).tolist():
                a, b = find(i), find(int(at[i]))
                parent[max(a, b)] = min(a, b)
        out = np.array([code[find(i)] for i in range(len(code))], np.int64)
        return pd.DataFrame({key: frame[key].iloc[0], "r": (code >> 20).astype(np.int32), "c": (code & ((1 << 20) - 1)).astype(np.int32), "own": out})

    tiled = hits.select(F.col(key).cast("long").alias(key), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).withColumn("_tr", F.floor(F.col("r") / tile)).withColumn("_tc", F.floor(F.col("c") / tile))
    own = tiled.groupBy(key, "_tr", "_tc").applyInPandas(lambda f: local(f), schema)
    border = own.where((F.pmod("r", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("c", F.lit(tile)).isin(0, tile - 1)))
    near = border.select(key, F.col("own").alias("a"), F.explode(F.array(*(F.struct((F.col("r") + x).alias("r"), (F.col("c") + y).alias("c")) for x in (-1, 0, 1) for y in (-1, 0, 1)))).alias("p")).select(key, "a", "p.r", "p.c")
    pairs = near.join(border.withColumnRenamed("own", "b"), [key, "r", "c"]).where("a <> b").select(key, "a", "b").distinct()
    from tidegrid.operators.graph import smallest_labels

    merged = smallest_labels(pairs, key)
    return own.join(merged.withColumnRenamed("node", "own"), [key, "own"], "left").select(key, "r", "c", F.coalesce("label", "own").alias("label"))


def component_stats(cells: DataFrame, keys: tuple[str, ...] = ("g", "label")) -> DataFrame:
    """Of each component: size, bounding box, centroid, brightest and mean HV (mean in power), paired ratio, axes by moments."""
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    pv, ph = F.pow(F.lit(10.0), F.col("hv") / 10), F.pow(F.lit(10.0), F.col("hh") / 10)
    both = F.col("hv").isNotNull() & F.col("hh").isNotNull()
    s = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixel_area"), F.min("r").alias("r0"), F.min("c").alias("c0"), (F.max("r") + 1).alias("r1"), (F.max("c") + 1).alias("c1"), F.avg(r).alias("rc"), F.avg(c).alias("cc"),
        F.max("hv").alias("peak_hv"), (10 * F.log10(F.avg(pv))).alias("mean_hv"), (10 * F.log10(F.avg(F.when(both, ph)) / F.avg(F.when(both, pv)))).alias("ratio_db"),
        F.var_pop(r).alias("vr"), F.var_pop(c).alias("vc"), F.covar_pop(r, c).alias("cov"),
    )
    root = F.sqrt(F.pow((F.col("vr") - F.col("vc")) / 2, 2) + F.pow("cov", 2))
    mid = (F.col("vr") + F.col("vc")) / 2 + 1 / 12
    return s.withColumn("major", 4 * F.sqrt(mid + root)).withColumn("minor", 4 * F.sqrt(F.greatest(mid - root, F.lit(0.0)))).drop("vr", "vc", "cov")


def bilinear(targets: DataFrame, cells: DataFrame, key: str = "g") -> DataFrame:
    """targets (y, x) with `value`: bilinear in power from the four cells around, null unless all four are valid."""
    near = targets.withColumn("_r", F.floor("y").cast("int")).withColumn("_c", F.floor("x").cast("int"))
    four = near.withColumn("_p", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))))
    four = four.withColumn("r", F.col("_r") + F.col("_p.a")).withColumn("c", F.col("_c") + F.col("_p.b"))
    fy, fx = F.col("y") - F.col("_r"), F.col("x") - F.col("_c")
    weight = F.when(F.col("_p.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("_p.b") == 1, fx).otherwise(1 - fx)
    got = four.join(cells.select(key, "r", "c", "power"), [key, "r", "c"], "left").groupBy(*targets.columns)
    return got.agg(F.sum(weight * F.col("power")).alias("_v"), F.count("power").alias("_n")).withColumn("value", F.when(F.col("_n") == 4, F.col("_v"))).drop("_v", "_n")
