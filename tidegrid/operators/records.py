"""Predicates on stored records, links between them, and audits of reviewers' answers."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.spatial import EARTH_M
from tidegrid.operators.graph import components

DAY = 86400
#: Pairs of a mark with an observation or a group of them that are compared at a time.
AT_ONCE = 1_000_000
#: Radians by which bounds of groups are widened against rounding (6 m).
SLACK = 1e-6


def at_least(score: Column, least: float) -> Column:
    """Rows of that score or more. Without a bound (0) unknown scores stay; with one they go."""
    return score >= least if least > 0 else F.lit(True)


def record_links(records: DataFrame, seconds: float = 7 * DAY, metres: float = 10_000.0) -> DataFrame:
    """(a, b): what joins records (id, acquisition, hash, t, x, y) in one group, in the smallest set of links that does so.

    Equal acquisitions or hashes link each record to the smallest of its kind, not all with all. In time and space records of
    one small cell, whose corners are within the bounds, are linked to its smallest. Across small cells only each place's
    first and last record there are compared, since no other is nearer in time to another cell's; both sides meet in cells
    as wide as the bounds. So a place with many records costs a link each.
    """
    def alike(key: str) -> DataFrame:
        first = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("a"))
        return records.join(first, key).where(F.col("a") < F.col("id")).select("a", F.col("id").alias("b"))

    cell = lambda c, w, k=0: (F.floor(F.col(c) / w) + k).cast("long")
    wide = (("t", seconds), ("x", metres), ("y", metres))
    placed = records.where("t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select("id", "t", "x", "y", *(cell(c, w / k).alias(f"s{c}") for (c, w), k in zip(wide, (2, 3, 3), strict=True)))
    small = ["st", "sx", "sy"]
    first = placed.groupBy(*small).agg(F.min("id").alias("a"))
    within = placed.join(first, small).where(F.col("a") < F.col("id")).select("a", F.col("id").alias("b"))
    ends = placed.groupBy(*small, "x", "y").agg(*(f(F.struct("t", "id")).alias(n) for n, f in (("low", F.min), ("high", F.max))))
    ends = ends.select("x", "y", F.explode(F.array_distinct(F.array("low", "high"))).alias("e")).select("e.id", "e.t", "x", "y")
    left = ends.select(F.col("id").alias("a"), *(F.col(c).alias(f"{c}0") for c, _ in wide), *(cell(c, w).alias(f"k{c}") for c, w in wide))
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    around = F.array(*(F.struct(*(cell(c, w, s).alias(f"k{c}") for (c, w), s in zip(wide, step, strict=True))) for step in steps))
    right = ends.select(F.col("id").alias("b"), "t", "x", "y", F.explode(around).alias("k")).select("b", "t", "x", "y", "k.*")
    close = (F.abs(F.col("t") - F.col("t0")) <= seconds) & (F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")) <= metres)
    pairs = left.join(right, ["kt", "kx", "ky"]).where((F.col("a") < F.col("b")) & close).select("a", "b")
    return reduce(DataFrame.union, [alike("acquisition"), alike("hash"), within, pairs]).distinct()


def grouped(records: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group_id): the smallest id that links reach."""
    labels = components(links)
    return records.select("id").join(labels, F.col("id") == F.col("node"), "left").select("id", F.coalesce("label", "id").alias("group_id"))


def _sphere(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def _pairs(marks: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """(segments, mark of each pair, observation of each pair, first pair of each segment) of segments of observations, AT_ONCE pairs at a time."""
    size = end - begin
    if not len(size):
        return
    cut = np.searchsorted(np.cumsum(size), np.arange(AT_ONCE, size.sum() + AT_ONCE, AT_ONCE), "left") + 1
    for i, j in zip(np.r_[0, cut[:-1]], cut, strict=True):
        n = size[i:j]
        if len(n):
            first = np.r_[0, np.cumsum(n)[:-1]]
            yield slice(i, j), np.repeat(marks[i:j], n), np.arange(n.sum()) + np.repeat(begin[i:j] - first, n), first


def tally(mt: np.ndarray, mlon: np.ndarray, mlat: np.ndarray, ot: np.ndarray, olon: np.ndarray, olat: np.ndarray, seconds: float, metres: float, pairs: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n, nearest): of each mark how many observations are within the time and distance, and how far the nearest of them is.

    Observations are grouped by place, sorted by time in a group. A group that lies within the distance as a whole is counted
    by two searches of its times; only those on the distance's edge, and those that can hold the nearest one, are compared
    one by one. There are as many groups as the number of observations to the power of 2/3, so a mark costs about that
    many steps, not one for each observation. `pairs` takes the numbers of compared pairs.
    """
    n, nearest = np.zeros(len(mt), np.int64), np.full(len(mt), np.inf)
    if not len(mt) or not len(ot):
        return n, nearest
    side = max(1, round(len(ot) ** (1 / 3)))
    part = lambda v: np.minimum((v - v.min()) / max(float(v.max() - v.min()), 1e-9) * side, side - 1).astype(np.int64)
    group = np.unique(part(olon) * side + part(olat), return_inverse=True)[1]
    times, rank = np.unique(ot, return_inverse=True)
    key = group * (len(times) + 1) + rank
    order = np.argsort(key)
    key, group, olon, olat = key[order], group[order], olon[order], olat[order]
    place, starts = _sphere(olon, olat), np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    centre = np.add.reduceat(place, starts)
    centre /= np.maximum(np.linalg.norm(centre, axis=1), 1e-12)[:, None]
    angle = lambda dot: np.arccos(np.clip(dot, -1, 1))
    radius = np.maximum.reduceat(angle((place * centre[group]).sum(axis=1)), starts) + SLACK
    low, high = np.searchsorted(times, mt - seconds, "left"), np.searchsorted(times, mt + seconds, "right")
    reach, at, width = metres / EARTH_M, _sphere(mlon, mlat), max(1, AT_ONCE // len(starts))
    for i in range(0, len(mt), width):
        far = angle(at[i : i + width] @ centre.T)
        m, g = np.nonzero(far - radius <= reach)
        least, most = (far - radius)[m, g], (far + radius)[m, g]
        m += i
        begin, end = (np.searchsorted(key, g * (len(times) + 1) + edge[m], "left") for edge in (low, high))
        some = end > begin
        m, least, most, begin, end = m[some], least[some], most[some], begin[some], end[some]
        whole = most <= reach
        np.add.at(n, m[whole], (end - begin)[whole])
        bound = np.full(len(mt), np.inf)
        np.minimum.at(bound, m, most)
        close = ~whole | (least <= bound[m])
        m, begin, end, whole = m[close], begin[close], end[close], whole[close]
        for part_, x, y, first in _pairs(m, begin, end):
            lat1, lat2 = np.radians(mlat[x]), np.radians(olat[y])
            h = np.sin((np.radians(olat[y] - mlat[x])) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(np.radians(olon[y] - mlon[x]) / 2) ** 2
            d = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
            ok = d <= metres
            np.add.at(n, m[part_], np.where(whole[part_], 0, np.add.reduceat(ok.astype(np.int64), first)))
            np.minimum.at(nearest, m[part_], np.minimum.reduceat(np.where(ok, d, np.inf), first))
            if pairs is not None:
                pairs.append(len(x))
    return n, nearest


def supported(marks: DataFrame, seen: DataFrame, seconds: float = 6 * 3600, metres: float = 50_000.0) -> DataFrame:
    """(mark, n, nearest_m) of marks (mark, t, lon, lat) with observations (obs, t, lon, lat) within that time and distance.

    They meet in cells of time, latitude and longitude. A degree of latitude has at least 110 km everywhere; a band's
    cells of longitude are as wide as the distance is at the end of the bands next to it that is nearer to a pole,
    and their numbers wrap at 180 degrees. A band within reach of a pole is one cell.
    """
    tall = metres / 110_000.0
    band = lambda lat: F.floor(lat / tall)

    def cells(ky: Column) -> Column:
        """How many cells of longitude a band has: equal for a mark's band, whatever band an observation is in."""
        outer = (F.greatest(F.abs(ky - 1), F.abs(ky + 2)) * tall).cast("double")
        wide = 2 * F.asin(F.least(math.sin(math.radians(tall / 2)) / F.cos(F.radians(outer)), F.lit(1.0)))
        return F.when(outer >= 89.0, F.lit(1)).otherwise(F.floor(2 * math.pi / wide)).cast("long")

    place = lambda lon, n: F.least(F.floor((F.pmod(lon + 180.0, F.lit(360.0))) / 360.0 * n), n - 1)
    o = seen.select(F.col("t").alias("to"), F.col("lon").alias("lon_o"), F.col("lat").alias("lat_o"))
    steps = F.array(*(F.struct((F.floor(F.col("to") / seconds) + i).alias("kt"), (band(F.col("lat_o")) + j).alias("ky")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    o = o.select("*", F.explode(steps).alias("k")).select("to", "lon_o", "lat_o", "k.*").withColumn("n_cells", cells(F.col("ky")))
    own = place(F.col("lon_o"), F.col("n_cells"))
    o = o.withColumn("kx", F.explode(F.array_distinct(F.array(*(F.pmod(own + i, F.col("n_cells")) for i in (-1, 0, 1)))))).drop("n_cells")
    m = marks.withColumn("kt", F.floor(F.col("t") / seconds)).withColumn("ky", band(F.col("lat")))
    m = m.withColumn("kx", place(F.col("lon"), cells(F.col("ky"))))
    cell = ["kt", "ky", "kx"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        own = [left.column(c).to_numpy() for c in ("t", "lon", "lat")]
        n, nearest = tally(*own, *(right.column(c).to_numpy() for c in ("to", "lon_o", "lat_o")), seconds, metres)
        out = pa.table({"mark": left.column("mark"), "n": pa.array(n), "nearest_m": pa.array(nearest)})
        return out.filter(pa.array(n > 0))

    # a null time or place is near nothing
    known = m.select("mark", *(F.col(c).cast("double").alias(c) for c in ("t", "lon", "lat")), *cell).dropna(subset=["t", "lon", "lat"])
    o = o.select(*(F.col(c).cast("double").alias(c) for c in ("to", "lon_o", "lat_o")), *cell).dropna()
    rows = known.groupBy(*cell).cogroup(o.groupBy(*cell)).applyInArrow(compare, f"mark {marks.schema['mark'].dataType.simpleString()}, n long, nearest_m double")
    return rows.groupBy("mark").agg(F.sum("n").alias("n"), F.min("nearest_m").alias("nearest_m"))


def agreement(pairs: DataFrame, first: str, second: str, *by: str) -> DataFrame:
    """by, n, observed, expected, kappa (null where expected is 1) of labels of any number; from one matrix of counts."""
    cells = pairs.groupBy(*by, F.col(first).alias("_a"), F.col(second).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    whole = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(*by, F.col("_a").alias("_l")).agg(F.sum("_n").alias("na"))
    columns = cells.groupBy(*by, F.col("_b").alias("_l")).agg(F.sum("_n").alias("nb"))
    chance = rows.join(columns, [*by, "_l"]).groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("by_chance"))
    out = whole.join(chance, [*by], "left")
    out = out.withColumn("observed", F.col("same") / F.col("n")).withColumn("expected", F.coalesce("by_chance", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n")))
    return out.select(*by, "n", "observed", "expected", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def amended(events: DataFrame) -> DataFrame:
    """(reviewer, task, active, amendments, sound) of events (reviewer, task, seq, kind, key, previous).

    A `response` begins a chain, each `amendment` replaces what was active and must name it; an amendment without
    anything before it, or that names another key, makes its chain unsound.
    """
    w = Window.partitionBy("reviewer", "task").orderBy("seq")
    wrong = (F.col("kind") == "amendment") & ~F.coalesce(F.col("previous") == F.lag("key").over(w), F.lit(False))
    own = events.withColumn("wrong", wrong).groupBy("reviewer", "task")
    return own.agg(F.max_by("key", "seq").alias("active"), F.count_if(F.col("kind") == "amendment").alias("amendments"), (~F.bool_or("wrong")).alias("sound"))


def half_steps(points: DataFrame) -> DataFrame:
    """(r, c, half_lon, half_lat) of grid points (r, c, lon, lat): the half of the steps to the next column and row (the ones before at the edges), 1e-6 at least."""
    near = {}
    for axis, other in (("c", "r"), ("r", "c")):
        w = Window.partitionBy(other).orderBy(axis)
        for v in ("lon", "lat"):
            near[axis, v] = F.abs(F.coalesce(F.lead(v).over(w), F.lag(v).over(w), F.col(v)) - F.col(v))
    half = lambda v: F.greatest(near["c", v] + near["r", v], F.lit(1e-6)) / 2
    return points.select("r", "c", half("lon").alias("half_lon"), half("lat").alias("half_lat"))


def display(value: Column, low: float, high: float) -> Column:
    """0 to 255 between the limits, truncated; unknown values as the low limit."""
    known = F.when(value.isNull() | F.isnan(value), low).otherwise(value)
    return F.floor(F.least(F.greatest((known - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def utc(text: Column) -> Column:
    """Microseconds since 1970 of an ISO time with Z or an offset; null for a time without one."""
    aware = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(aware, F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))))


def item_name(key: Column) -> Column:
    """A key as one file name, its separators as underscores; null for what names no item."""
    name = F.regexp_replace(key, r"[/\\:]", "_")
    return F.when(~name.isin("", ".", ".."), name)


def inside_root(path: Column) -> Column:
    """Whether a relative path stays under its root: no absolute path, no step above the root at any place."""
    step = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda s, p: F.struct(
            (s["depth"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("depth"),
            F.least(s["least"], s["depth"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("least"),
        ),
    )
    return ~path.startswith("/") & (step["least"] >= 0)


def zones(value: Column) -> Column:
    """Zones from floats within 0.01 of a whole number between 0 and 41; -1 for unknown values, null for what fits none."""
    whole = F.rint(value)
    good = (F.abs(value - whole) <= 0.01) & value.between(-0.01, 41.01)
    return F.when(value.isNull() | F.isnan(value), -1).when(good, whole.cast("int"))


def pilot(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows, each with `truncated`: whether there are more. n + 1 rows are fetched, and no count is made."""
    some = rows.orderBy(*order).limit(n + 1).withColumn("_k", F.row_number().over(Window.orderBy(*order)))
    return some.withColumn("truncated", F.max("_k").over(Window.partitionBy(F.lit(1))) > n).where(F.col("_k") <= n).drop("_k")


def only(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns of the one row that a lookup by a unique key finds, or none; two rows are refused, not hidden."""
    some = rows.limit(2).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*columns)).alias("_row")).where("_n > 0")
    one = F.when(F.col("_n") > 1, F.raise_error(F.lit("a unique key has several rows")).cast(some.schema["_row"].dataType)).otherwise(F.col("_row"))
    return some.select(one.alias("_row")).select("_row.*")


def receipts(stored: DataFrame, failures: DataFrame) -> DataFrame:
    """(product, failed_stage, reasons): stored receipts with new failures (product, seq, stage, reason); unseen reasons are appended in order, the last stage stays."""
    new = failures.groupBy("product").agg(F.max_by("stage", "seq").alias("stage"), F.array_sort(F.collect_set(F.struct("seq", "reason"))).alias("found"))
    both = stored.join(new, "product", "full")
    told = F.coalesce(F.transform("found", lambda f: f["reason"]), F.array().cast("array<string>"))
    return both.select("product", F.coalesce("stage", "failed_stage").alias("failed_stage"), F.array_union(F.coalesce("reasons", F.array().cast("array<string>")), told).alias("reasons"))
