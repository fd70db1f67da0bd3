"""Areas of footprints inside polygons, one by one and united, by a sweep over cut lines in each cell of the polygons' index.

Coordinates are planar, from an equal-area projection. Footprints are convex; polygons may have any shape, holes and islands. A cell's
part of a group is cut into strips at every vertex and crossing in it; inside a strip all sides are straight and none cross, so
the covered length at its middle times its width is its area, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import polygons

#: Footprints that one sweep takes; a cell with more is halved each way first, since few sides cross a small box.
SWEPT = 24


def ring_area(ring: Column) -> Column:
    """Planar area of a ring of (x, y), closed or not, by the shoelace sum around its first point."""
    n = F.size(ring)
    x0, y0 = ring[0]["x"], ring[0]["y"]
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.get(ring, i)["x"] - x0) * (F.get(ring, (i + 1) % n)["y"] - y0) - (F.get(ring, (i + 1) % n)["x"] - x0) * (F.get(ring, i)["y"] - y0))
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(0.0)


def halfplane(ring: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """The part of a convex ring with a x + b y >= c."""
    if not len(ring):
        return ring
    d = ring @ (a, b) - c
    out = []
    for p, q, dp, dq in zip(ring, np.roll(ring, -1, 0), d, np.roll(d, -1), strict=True):
        if dp >= 0:
            out.append(p)
        if (dp > 0 > dq) or (dp < 0 < dq):
            out.append(p + (q - p) * (dp / (dp - dq)))
    return np.array(out).reshape(-1, 2)


def boxed(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    x0, y0, x1, y1 = box
    for a, b, c in ((1, 0, x0), (-1, 0, -x1), (0, 1, y0), (0, -1, -y1)):
        ring = halfplane(ring, a, b, c)
    return ring


def size(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    p = ring - ring[0]
    return abs(float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum())) / 2


def crossings(e: np.ndarray) -> np.ndarray:
    """x of all points where two of the sides (x1, y1, x2, y2) cross."""
    d = e[:, 2:] - e[:, :2]
    i, j = np.triu_indices(len(e), 1)
    turn = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    ok = turn != 0
    i, j, turn = i[ok], j[ok], turn[ok]
    w = e[j, :2] - e[i, :2]
    s, t = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / turn, (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / turn
    hit = (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    return e[i[hit], 0] + s[hit] * d[i[hit], 0]


def cover(rings: list[np.ndarray], box: tuple[float, float, float, float]) -> np.ndarray:
    """Of convex rings, whether each holds all corners of the box, and so the box; rings of one number of vertices are one array."""
    x0, y0, x1, y1 = box
    out, many = np.zeros(len(rings), bool), np.array([len(r) for r in rings])
    for n in np.unique(many):
        r = np.stack([rings[k] for k in np.flatnonzero(many == n)])
        d = np.roll(r, -1, 1) - r
        side = np.stack([d[..., 0] * (y - r[..., 1]) - d[..., 1] * (x - r[..., 0]) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
        moves = np.abs(d).sum(axis=2) > 0
        out[many == n] = ((side > 0) | ~moves).all(axis=(0, 2)) | ((side < 0) | ~moves).all(axis=(0, 2))
    return out & (many >= 3)


def swept(rings: list[np.ndarray], edges: np.ndarray, odd: bool, corner: tuple[float, float], box: tuple[float, float, float, float]) -> float:
    """Area of the union of convex rings, inside a polygon of which `edges` are known and whether its `corner` is in it, within a box."""
    x0, y0, x1, y1 = box
    own = [r for r in (boxed(r, box) for r in rings) if size(r) > 0]
    if not own:
        return 0.0
    whole = (x1 - x0) * (y1 - y0)
    if any(size(r) >= whole * (1 - 1e-12) for r in own):
        own = [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]
    if len(own) > SWEPT:
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        return sum(swept(own, edges, odd, corner, b) for b in ((x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1)))
    if not len(edges) and len(own) == 1:
        return size(own[0]) if odd else 0.0
    sides = np.concatenate([np.c_[r, np.roll(r, -1, 0)] for r in own])
    near = edges[(np.minimum(edges[:, 0], edges[:, 2]) <= x1) & (np.maximum(edges[:, 0], edges[:, 2]) >= x0)] if len(edges) else edges
    every = np.concatenate([sides, near]) if len(near) else sides
    level = np.array([(x0, y0, x1, y0), (x0, y1, x1, y1)])
    cuts = np.concatenate([every[:, 0], every[:, 2], crossings(np.concatenate([every, level]))])
    cuts = np.unique(np.r_[x0, cuts[(cuts > x0) & (cuts < x1)], x1])
    total = 0.0
    for a, b in zip(cuts, cuts[1:], strict=False):
        m = (a + b) / 2
        low, high = [], []
        for r in own:
            s = np.c_[r, np.roll(r, -1, 0)]
            s = s[(s[:, 0] < m) != (s[:, 2] < m)]
            if len(s):
                y = s[:, 1] + (m - s[:, 0]) * (s[:, 3] - s[:, 1]) / (s[:, 2] - s[:, 0])
                low.append(y.min())
                high.append(y.max())
        if low:
            total += (b - a) * overlap(*merged(np.array(low), np.array(high)), *column(edges, odd, corner, m, y0, y1))
    return total


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals united, ascending."""
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order])
    first = np.r_[True, low[1:] > high[:-1]]
    return low[first], high[np.r_[np.flatnonzero(first)[1:] - 1, len(low) - 1]]


def column(edges: np.ndarray, odd: bool, corner: tuple[float, float], x: float, y0: float, y1: float) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the vertical line at x, from y0 to y1, that are in the polygon."""
    cx, cy = corner
    if len(edges):
        flat = edges[(edges[:, 1] < cy) != (edges[:, 3] < cy)]
        at = flat[:, 0] + (cy - flat[:, 1]) * (flat[:, 2] - flat[:, 0]) / (flat[:, 3] - flat[:, 1])
        odd = odd != bool(((at > cx) & (at <= x)).sum() % 2)
        up = edges[(edges[:, 0] < x) != (edges[:, 2] < x)]
        y = np.sort(up[:, 1] + (x - up[:, 0]) * (up[:, 3] - up[:, 1]) / (up[:, 2] - up[:, 0]))
        odd = odd != bool(((y > cy) & (y <= y0)).sum() % 2)
        y = y[(y > y0) & (y < y1)]
    else:
        y = np.zeros(0)
    turns = np.r_[[y0] if odd else [], y]
    turns = np.r_[turns, [y1]] if len(turns) % 2 else turns
    return turns[::2], turns[1::2]


def overlap(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> float:
    """Length that two lists of disjoint intervals share."""
    if not len(a0) or not len(b0):
        return 0.0
    return float(np.maximum(0.0, np.minimum(a1[:, None], b1[None]) - np.maximum(a0[:, None], b0[None])).sum())


def covered(footprints: DataFrame, index: DataFrame, cell: float, key: str = "id") -> DataFrame:
    """(key, poly, area) of footprints (key, ring: array of x, y; convex): the area of each key's footprints, united, in each polygon of the index.

    Footprints of a key meet the polygons cell by cell, and equal ones count once, so copies of one acquisition add nothing.
    Keys and polygons that share no area are not in the result. What one task sweeps is a key's footprints in one cell.
    """
    low = lambda c: F.array_min(F.col(f"ring.{c}"))
    high = lambda c: F.array_max(F.col(f"ring.{c}"))
    rows = footprints.select(key, "ring").where(F.size("ring") >= 3).distinct()
    rows = rows.withColumn("i", F.explode(F.sequence(polygons.cell(low("x"), cell), polygons.cell(high("x"), cell)))).withColumn("j", F.explode(F.sequence(polygons.cell(low("y"), cell), polygons.cell(high("y"), cell))))
    met = rows.join(index.select("i", "j", F.explode("polys").alias("_p")), ["i", "j"]).select(key, "i", "j", "ring", F.col("_p.poly").alias("poly"), F.col("_p.odd").alias("_odd"), F.col("_p.edges").alias("_edges"))

    def run(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        place = lambda k: k * cell + polygons.OFFSET * cell
        box = (place(i), place(j), place(i + 1), place(j + 1))
        column = t["ring"].combine_chunks()
        points, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy())
        rings = np.split(np.c_[points.field("x").to_numpy(), points.field("y").to_numpy()], ends[:-1])
        whole = np.flatnonzero(cover(rings, box))
        rings = [rings[whole[0]]] if len(whole) else rings
        edges = np.array([(e["x1"], e["y1"], e["x2"], e["y2"]) for e in t["_edges"][0].as_py()]).reshape(-1, 4)
        area = swept(rings, edges, t["_odd"][0].as_py(), box[:2], box)
        return pa.table([t[key].slice(0, 1), t["poly"].slice(0, 1), pa.array([area])], [key, "poly", "area"])

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    parts = met.groupBy(key, "poly", "i", "j").applyInArrow(run, f"`{key}` {kinds[key]}, poly {kinds['poly']}, area double")
    return parts.groupBy(key, "poly").agg(F.sum("area").alias("area")).where("area > 0")


def first_seen(pages: DataFrame, key: str, *order: str) -> DataFrame:
    """pages with one row of each key: the first by `order`, as a reader of the pages meets it."""
    names = [c for c in pages.columns if c != key]
    first = pages.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return first.select(key, "_row.*").select(*pages.columns)
