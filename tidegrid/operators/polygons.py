"""Polygons as tables of edges dealt to grid cells: points, rasters and other polygons meet them by equi-joins.

A cell of the index holds, of each polygon that touches it, the edges in it and whether its lower left corner is inside. A
point is compared with its own cell's edges alone: the parity of crossings on the way from the corner up the cell's left
side and across to the point decides. Every crossing on that way is read from one signed area for each edge and corner,
so what one side says of a corner is what the other says, and no rounding makes a polygon leak. Cells that lie wholly
inside have no edges. No polygon is ever broadcast, or in one row or task as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

#: Cell borders are off whole numbers, where coordinates often are.
OFFSET = 0.3819660112501051
#: Rows of a scan whose points of one cell are a bundle (a power of two), and pairs of points and edges that are compared at once.
BUNDLE_BITS, COMPARED = 17, 1_000_000
EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"


def edges(vertices: DataFrame, poly: str = "poly", ring: str = "ring", order: str = "seq") -> DataFrame:
    """(poly, x1, y1, x2, y2) of rings (poly, ring, seq, x, y), which are closed if they aren't. A polygon may have several rings: holes, islands."""
    w = Window.partitionBy(poly, ring).orderBy(order)
    place = F.struct("x", "y")
    after = F.coalesce(F.lead(place).over(w), F.first(place).over(w))
    rows = vertices.where("x IS NOT NULL AND y IS NOT NULL").select(F.col(poly).alias("poly"), F.col("x").alias("x1"), F.col("y").alias("y1"), after.alias("to"))
    rows = rows.select("poly", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1")), F.col("to.x").cast("double").alias("x2"), F.col("to.y").cast("double").alias("y2"))
    return rows.where("x1 <> x2 OR y1 <> y2")


def cell(v: Column, size: float) -> Column:
    return F.floor((v - OFFSET * size) / size).cast("long")


def border(k: Column, size: float) -> Column:
    return k * size + OFFSET * size


def signed(e: dict[str, Column] | Column, x: Column, y: Column) -> Column:
    """Twice the signed area of an edge and a point: its sign tells the edge's side."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def right(e: dict[str, Column] | Column, x: Column, y: Column) -> Column:
    """Whether an edge crosses the ray from a point to the right."""
    return ((e["y1"] < y) != (e["y2"] < y)) & ((signed(e, x, y) > 0) == (e["y2"] > e["y1"]))


def below(e: dict[str, Column] | Column, x: Column, y: Column) -> Column:
    """Whether an edge crosses the ray from a point down."""
    return ((e["x1"] < x) != (e["x2"] < x)) & ((signed(e, x, y) > 0) == (e["x2"] > e["x1"]))


def dealt(rows: DataFrame, size: float, reach: float = 0.0) -> DataFrame:
    """edges with (i, j), a row for every cell of that size which an edge touches, or comes within reach of."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    slack = 1e-9 * size
    out = rows.withColumn("j", F.explode(F.sequence(cell(low - reach - slack, size), cell(high + reach + slack, size))))
    at = lambda y: F.when(y1 == y2, x1).otherwise(x1 + (F.least(F.greatest(y, low), high) - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)))
    bottom, top = at(border(F.col("j"), size) - reach - slack), at(border(F.col("j") + 1, size) + reach + slack)
    flat = y1 == y2
    left, far = F.when(flat, F.least(x1, x2)).otherwise(F.least(bottom, top)), F.when(flat, F.greatest(x1, x2)).otherwise(F.greatest(bottom, top))
    return out.withColumn("i", F.explode(F.sequence(cell(left - reach - slack, size), cell(far + reach + slack, size))))


def index(rows: DataFrame, size: float, reach: float = 0.0) -> DataFrame:
    """(i, j, polys) of edges (poly, x1 ...): of each cell that a polygon touches or covers its (poly, odd, edges).

    A cell's row grows with the edges in it, so `size` should leave few; within `reach` edges of other cells are held too, and `size`
    should not be much below it. A polygon's rows grow with its area in cells.
    """
    e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    parts = dealt(rows, size, reach)
    y0 = border(F.col("j"), size)
    crosses = right(e, border(F.col("i"), size), y0) & ~right(e, border(F.col("i") + 1, size), y0)
    held = parts.groupBy("poly", "j", "i").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"), F.count_if(crosses).alias("n"))
    w = Window.partitionBy("poly", "j").orderBy(F.desc("i"))
    held = held.withColumn("odd", F.sum("n").over(w) % 2 == 1).withColumn("next", F.lag("i").over(w)).withColumn("inner", F.lag("odd").over(w))
    own = held.select("poly", "j", "i", "odd", "edges")
    gaps = held.where(F.col("inner") & (F.col("next") > F.col("i") + 1))
    full = gaps.select("poly", "j", F.explode(F.sequence(F.col("i") + 1, F.col("next") - 1)).alias("i"), F.lit(True).alias("odd"), F.array().cast(f"array<{EDGE}>").alias("edges"))
    return own.unionByName(full).groupBy("i", "j").agg(F.collect_list(F.struct("poly", "odd", "edges")).alias("polys"))


def inside(edges: np.ndarray, odd: bool, x: np.ndarray, y: np.ndarray, corner: tuple[float, float]) -> np.ndarray:
    """Whether points of a cell are in a polygon of which the cell holds these edges and whether its corner is in it; boundaries are inside."""
    if not len(edges):
        return np.full(len(x), odd)
    cx, y0 = corner
    x, y = x[:, None], y[:, None]
    e = dict(zip(("x1", "y1", "x2", "y2"), edges.T, strict=True))
    rises, runs = e["y2"] > e["y1"], e["x2"] > e["x1"]
    area = signed(e, x, y)
    left = signed(e, cx, y) > 0
    spans = (e["x1"] < cx) != (e["x2"] < cx)
    up = (spans & (left == runs)) != (spans & ((signed(e, cx, y0) > 0) == runs))
    level = (e["y1"] < y) != (e["y2"] < y)
    across = (level & (left == rises)) != (level & ((area > 0) == rises))
    on = (area == 0) & (x >= np.minimum(e["x1"], e["x2"])) & (x <= np.maximum(e["x1"], e["x2"])) & (y >= np.minimum(e["y1"], e["y2"])) & (y <= np.maximum(e["y1"], e["y2"]))
    return (((up != across).sum(axis=1) % 2 == 1) != odd) | on.any(axis=1)


def distance2(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The square of each point's distance to the nearest of the edges; infinite where there are none."""
    x1, y1, x2, y2 = edges.T
    x, y, dx, dy = x[:, None], y[:, None], x2 - x1, y2 - y1
    t = np.minimum(np.maximum(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0.0), 1.0)
    return np.min((x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2, axis=1, initial=np.inf)


def locate(points: DataFrame, polys: DataFrame, size: float, x: str = "x", y: str = "y", reach: float = 0.0) -> DataFrame:
    """points with `found`, the polygons that hold each, or have an edge within `reach`, ascending; one shuffle, on the cell.

    polys is the index of the same size, and of the same reach or more. Points without coordinates are in none. Points go to
    their cell in bundles, so that a cell's edges are sent once for each bundle and arrays compare them; a cell with many points is dealt by bundle.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    names = points.columns
    kind = polys.schema["polys"].dataType.elementType["poly"].dataType
    own = F.struct(F.struct(*names).alias("row"), px.alias("x"), py.alias("y"))
    rows = points.select(cell(px, size).alias("_i"), cell(py, size).alias("_j"), F.shiftright(F.monotonically_increasing_id(), BUNDLE_BITS).alias("_part"), own.alias("_p"))
    bundles = rows.groupBy("_i", "_j", "_part").agg(F.collect_list("_p").alias("_points")).drop("_part")
    cells = polys.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("polys").alias("_polys"))
    met = bundles.join(cells, ["_i", "_j"], "left").select("_i", "_j", "_points", "_polys")

    def found_in(i: int, j: int, near: list[dict], x: np.ndarray, y: np.ndarray) -> list[list]:
        corner, out = (i * size + OFFSET * size, j * size + OFFSET * size), [[] for _ in x]
        for p in sorted(near, key=lambda p: p["poly"]):
            edges = np.array([(e["x1"], e["y1"], e["x2"], e["y2"]) for e in p["edges"]]).reshape(-1, 4)
            step = max(1, COMPARED // max(1, len(edges)))
            for at in range(0, len(x), step):
                u, v = x[at : at + step], y[at : at + step]
                held = inside(edges, p["odd"], u, v, corner)
                if reach:
                    held |= distance2(edges, u, v) <= reach * reach
                for k in np.flatnonzero(held & ~np.isnan(u) & ~np.isnan(v)).tolist():
                    out[at + k].append(p["poly"])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                points, near = batch.column(2)[k].values, batch.column(3)[k].as_py()
                i, j = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if near is None or i is None or j is None:
                    found = [[]] * len(points)
                else:
                    found = found_in(i, j, near, *(points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")))
                own = points.field("row")
                yield pa.record_batch([*(own.field(c) for c in range(len(names))), pa.array(found, pa.list_(to_arrow_type(kind)))], [*names, "found"])

    return met.mapInArrow(run, StructType([*points.schema.fields, StructField("found", ArrayType(kind))]))


def meeting(one: DataFrame, other: DataFrame, size: float) -> DataFrame:
    """(a, b) of polygons of two tables of edges that have a point in common: edges that cross, or a vertex of one inside the other.

    Edges meet in cells, vertices meet the other's index.
    """
    first, second = index(one, size), index(other, size)
    cut = F.exists("p.edges", lambda e: F.exists("q.edges", lambda f: _cross(e, f)))
    pairs = first.select("i", "j", F.explode("polys").alias("p")).join(second.select("i", "j", F.explode("polys").alias("q")), ["i", "j"])
    crossing = pairs.where(cut).select(F.col("p.poly").alias("a"), F.col("q.poly").alias("b"))
    corner = lambda rows: rows.select("poly", F.col("x1").alias("x"), F.col("y1").alias("y")).distinct()
    within = locate(corner(one), second, size).select(F.col("poly").alias("a"), F.explode("found").alias("b"))
    around = locate(corner(other), first, size).select(F.explode("found").alias("a"), F.col("poly").alias("b"))
    return crossing.union(within).union(around.select("a", "b")).distinct()


def _cross(e: Column, f: Column) -> Column:
    side = lambda k, x, y: F.signum(signed(k, x, y))
    a, b = side(e, f["x1"], f["y1"]), side(e, f["x2"], f["y2"])
    c, d = side(f, e["x1"], e["y1"]), side(f, e["x2"], e["y2"])
    return (a * b < 0) & (c * d < 0)
