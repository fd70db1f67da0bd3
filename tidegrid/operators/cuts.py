"""Windows cut out of grids: cells and windows meet by tile keys, and only whole windows count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centred(points: DataFrame, size: int) -> DataFrame:
    """points (r, c) with r0, c0, r1, c1: the window of size x size cells around each; an even size has its centre below and right of the middle."""
    if size < 1:
        raise ValueError("a window has one cell or more")
    return points.withColumn("r0", F.col("r") - size // 2).withColumn("c0", F.col("c") - size // 2).withColumn("r1", F.col("r0") + size).withColumn("c1", F.col("c0") + size)


def clipped(windows: DataFrame, extent: DataFrame, key: str = "g", most: int = 4_000_000) -> DataFrame:
    """windows (key, r0, c0, r1, c1 as doubles, ends open) rounded outward and clipped to their grid (key, rows, cols).

    Empty ones go; a window of more than `most` cells is refused by `too_large`, and must not be cut.
    """
    rows = windows.join(extent, key)
    low = lambda c: F.greatest(F.floor(c), F.lit(0)).cast("int")
    rows = rows.withColumn("r0", low("r0")).withColumn("c0", low("c0"))
    rows = rows.withColumn("r1", F.least(F.ceil("r1"), F.col("rows")).cast("int")).withColumn("c1", F.least(F.ceil("c1"), F.col("cols")).cast("int"))
    area = (F.col("r1") - F.col("r0")).cast("long") * (F.col("c1") - F.col("c0"))
    return rows.where("r1 > r0 AND c1 > c0").withColumn("too_large", area > most).drop("rows", "cols")


def cut(cells: DataFrame, windows: DataFrame, values: dict[str, Column], ident: str = "id", key: str = "g", tile: int = 64, whole: bool = True) -> DataFrame:
    """(key, ident, r0, c0, r1, c1, n, complete, one array for each of values in row order) of windows (key, ident, r0 ...).

    A window is sent to the tiles it touches and meets the cells there; `tile` should be near the windows' size. It is
    complete if every cell has all values known. With `whole` incomplete windows go; without it they stay, with nulls for unknown
    values and with nothing for cells that aren't there. A window lies in one row at the end, so its size must be bounded.
    """
    names = [key, ident, "r0", "c0", "r1", "c1"]
    to = lambda a, b: F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor((F.col(b) - 1) / tile).cast("int"))
    sent = windows.where("r1 > r0 AND c1 > c0").select(*names, F.explode(to("r0", "r1")).alias("_tr"), "r1", "c1").select(*names, "_tr", F.explode(to("c0", "c1")).alias("_tc"))
    own = cells.select(key, F.col("r").alias("_r"), F.col("c").alias("_c"), *(v.alias(f"_{n}") for n, v in values.items()))
    own = own.withColumn("_tr", F.floor(F.col("_r") / tile).cast("int")).withColumn("_tc", F.floor(F.col("_c") / tile).cast("int"))
    met = sent.join(own, [key, "_tr", "_tc"]).where("_r >= r0 AND _r < r1 AND _c >= c0 AND _c < c1")
    known = F.lit(True)
    for n in values:
        known = known & F.col(f"_{n}").isNotNull()
    got = met.groupBy(*names).agg(F.count_if(known).alias("n"), F.array_sort(F.collect_list(F.struct("_r", "_c", *(f"_{n}" for n in values)))).alias("_cells"))
    area = (F.col("r1") - F.col("r0")).cast("long") * (F.col("c1") - F.col("c0"))
    rows = got.withColumn("complete", F.col("n") == area)
    rows = rows.where("complete") if whole else rows
    return rows.select(*names, "n", "complete", *(F.col(f"_cells._{n}").alias(n) for n in values))
