"""Coarse annotation tables spread over grids: separable linear interpolation and azimuth blocks, as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.brackets import bracket
from tidegrid.operators.graph import kept


def filled(knots: DataFrame, key: str = "file") -> DataFrame:
    """(key, line, pixel, value) of every line at every pixel that any line of its key has: missing values lie on the line between the neighbours, or are the end's.

    A line without any known value, and two values of one knot that differ, are refused.
    """
    once = knots.groupBy(key, "line", "pixel").agg(F.min("value").alias("value"), F.max("value").alias("_most"))
    clash = F.coalesce(F.col("value") != F.col("_most"), F.lit(False))
    own = once.select(key, "line", "pixel", F.when(clash, F.raise_error(F.lit("two values of one knot"))).otherwise(F.col("value")).alias("value"))
    own = own.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    full = own.select(key, "line").distinct().join(own.select(key, "pixel").distinct(), key)
    group = F.struct(F.col(key), F.col("line"))
    asked = full.select(group.alias("_g"), F.col("pixel").cast("double").alias("t"))
    known = own.where("value IS NOT NULL").select(group.alias("_g"), F.col("pixel").cast("double").alias("t"), "value")
    rows = bracket(asked, known, "_g", 1 << 30)
    a, b = F.col("before"), F.col("after")
    between = F.when(a["t"] == F.col("t"), a["value"]).otherwise(a["value"] + (F.col("t") - a["t"]) * (b["value"] - a["value"]) / (b["t"] - a["t"]))
    value = F.coalesce(between, a["value"], b["value"], F.raise_error(F.lit("a line without values")).cast("double"))
    return rows.select(F.col(f"_g.{key}").alias(key), F.col("_g.line").alias("line"), F.col("t").cast("int").alias("pixel"), value.alias("value"))


def segments(asked: DataFrame, knots: DataFrame, key: str, at: str, extrapolate: Column) -> DataFrame:
    """asked (key, at) with _{at}0 and _{at}1, the knots of the segment for it, and _{at}w, the second's weight: within 0 and 1, or beyond them where `extrapolate`."""
    order = Window.partitionBy(key).orderBy("t")
    own = knots.select(key, F.col(at).cast("double").alias("t")).distinct()
    ends = own.withColumn("next", F.lead("t").over(order)).withColumn("last", F.lag("t").over(order))
    rows = bracket(asked.select(key, F.col(at).cast("double").alias("t")).distinct(), ends, key, 1 << 20)
    b, a = F.col("before"), F.col("after")
    # the last knot has no next: its segment is the one before it; before the first knot it is the first one
    low = F.when(b.isNull(), a["t"]).when(b["next"].isNull(), F.coalesce(b["last"], b["t"])).otherwise(b["t"])
    high = F.when(b.isNull(), F.coalesce(a["next"], a["t"])).when(b["next"].isNull(), b["t"]).otherwise(b["next"])
    rows = rows.where(b.isNotNull() | a.isNotNull()).select(key, F.col("t").cast("int").alias(at), low.alias("_l"), high.alias("_h"), "t")
    w = F.when(F.col("_h") > F.col("_l"), (F.col("t") - F.col("_l")) / (F.col("_h") - F.col("_l"))).otherwise(0.0)
    w = F.when(extrapolate, w).otherwise(F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)))
    return rows.select(key, at, F.col("_l").cast("int").alias(f"_{at}0"), F.col("_h").cast("int").alias(f"_{at}1"), w.alias(f"_{at}w"))


def interpolated(cells: DataFrame, knots: DataFrame, key: str = "file", extrapolate_lines: bool = False, extrapolate_pixels: bool | Column = False) -> DataFrame:
    """cells (key, line, pixel) with `value` from knots (key, line, pixel, value): along pixels, then along lines.

    Lines and pixels of the cells find their segments by themselves; a cell then meets the four corners of its patch as one
    row. So cells join three small tables by equal keys, whatever their number. Beyond the knots values are the end's, or on
    the end's line where extrapolated. Cells of a key without knots go.
    """
    pixels = F.lit(extrapolate_pixels) if isinstance(extrapolate_pixels, bool) else extrapolate_pixels
    # small tables that many joins read are written once
    table = kept(filled(knots, key))
    lines = kept(segments(cells.select(key, "line"), table, key, "line", F.lit(extrapolate_lines)))
    columns = kept(segments(cells.select(key, "pixel"), table, key, "pixel", pixels))
    sides = lines.select(key, "_line0", "_line1").distinct().join(columns.select(key, "_pixel0", "_pixel1").distinct(), key)
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
        corner = table.select(key, F.col("line").alias(f"_line{i}"), F.col("pixel").alias(f"_pixel{j}"), F.col("value").alias(f"_v{i}{j}"))
        sides = sides.join(corner, [key, f"_line{i}", f"_pixel{j}"])
    rows = cells.join(lines, [key, "line"]).join(columns, [key, "pixel"]).join(sides, [key, "_line0", "_line1", "_pixel0", "_pixel1"])
    u, v = F.col("_linew"), F.col("_pixelw")
    along = lambda i: F.col(f"_v{i}0") * (1 - v) + F.col(f"_v{i}1") * v
    return rows.select(*cells.columns, (along(0) * (1 - u) + along(1) * u).alias("value"))


def block_vectors(blocks: DataFrame, knots: DataFrame) -> DataFrame:
    """(file, block, line, pixel, value, fallback) of blocks (file, block, swath, r0, r1, c0, c1; ends open): the range vectors that each block goes by.

    Those with a line in the block; where there is none, the vector nearest to its middle among those within its swath's
    lines that have two positive values or more, and no negative one, in the block's columns. A block with neither is refused.
    """
    b = blocks.select("file", "block", "swath", "r0", "r1", "c0", "c1")
    extent = b.groupBy("file", "swath").agg(F.min("r0").alias("_first"), F.max("r1").alias("_end"))
    lines = knots.select("file", "line").distinct()
    inside = b.join(lines, "file").where("line >= r0 AND line < r1").select("file", "block", "line")
    lone = b.join(inside.select("file", "block").distinct(), ["file", "block"], "left_anti").join(extent, ["file", "swath"])
    near = lone.join(knots, "file").where("line >= _first AND line < _end AND pixel >= c0 AND pixel < c1")
    near = near.groupBy("file", "block", "line", "r0", "r1").agg(F.count_if(F.col("value") > 0).alias("up"), F.count_if(F.col("value") < 0).alias("down")).where("up >= 2 AND down = 0")
    best = near.groupBy("file", "block").agg(F.min(F.struct(F.abs(F.col("line") - (F.col("r0") + F.col("r1") - 1) / 2).alias("far"), "line")).alias("m"))
    chosen = lone.select("file", "block").join(best, ["file", "block"], "left")
    refused = F.when(F.col("m").isNull(), F.raise_error(F.lit("a block has no qualified range vectors")).cast("int")).otherwise(F.col("m.line"))
    every = inside.withColumn("fallback", F.lit(False)).unionByName(chosen.select("file", "block", refused.alias("line"), F.lit(True).alias("fallback")))
    return every.join(knots, ["file", "line"]).select("file", "block", "line", "pixel", "value", "fallback")


def noise_power(cells: DataFrame, blocks: DataFrame, knots: DataFrame, factors: DataFrame, tile: int = 256) -> DataFrame:
    """cells (file, line, pixel) in a block with `noise`: range noise of its block's vectors times the block's azimuth factor.

    blocks as in `block_vectors`; where they overlap the larger block number holds. factors (file, block, line, value) are knots along
    lines. Cells and blocks meet by tiles. Range and azimuth go on beyond their last knots along the end's line; range
    only for blocks that fell back on a neighbour's vector. A negative result is refused.
    """
    to = lambda a, b: F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor((F.col(b) - 1) / tile).cast("int"))
    dealt = blocks.where("r1 > r0 AND c1 > c0").select("file", "block", "r0", "r1", "c0", "c1", F.explode(to("r0", "r1")).alias("_tr"))
    dealt = dealt.select("*", F.explode(to("c0", "c1")).alias("_tc"))
    names = cells.columns
    place = cells.withColumn("_tr", F.floor(F.col("line") / tile).cast("int")).withColumn("_tc", F.floor(F.col("pixel") / tile).cast("int"))
    met = place.join(dealt, ["file", "_tr", "_tc"]).where("line >= r0 AND line < r1 AND pixel >= c0 AND pixel < c1")
    own = kept(met.groupBy(*names).agg(F.max("block").alias("block")).withColumn("_key", F.struct("file", "block")))
    vectors = kept(block_vectors(blocks, knots).withColumn("_key", F.struct("file", "block")))
    kinds = vectors.select("_key", "fallback").distinct()
    parts = []
    for fell in (False, True):
        these = kinds.where(F.col("fallback") == fell).select("_key")
        parts.append(interpolated(own.join(these, "_key", "left_semi"), vectors.join(these, "_key", "left_semi").select("_key", "line", "pixel", "value"), "_key", True, fell))
    power = kept(parts[0].unionByName(parts[1]))
    line = factors.select(F.struct("file", "block").alias("_key"), "line", F.lit(0).alias("pixel"), "value")
    scale = interpolated(power.select("_key", "line", F.lit(0).alias("pixel")).distinct(), line, "_key", True).select("_key", "line", F.col("value").alias("_factor"))
    noise = F.col("value") * F.col("_factor")
    bad = (F.col("value") < 0) | (F.col("_factor") < 0)
    return power.join(scale, ["_key", "line"]).select(*names, "block", F.when(bad, F.raise_error(F.lit("negative noise")).cast("double")).otherwise(noise).alias("noise"))
