"""As-of joins in cells of time: the knots around each sample, cubic interpolation between them, and counts up to a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(samples: DataFrame, knots: DataFrame, key: str, width: float, t: str = "t") -> DataFrame:
    """samples with `before`, the last knot of their key at or before t, and `after`, the first one later; null where there is none.

    Knots (key, t and more) become structs with t first, and know the next of their cell. Both tables meet in cells of `width`, so no key is
    sorted as a whole: in a cell one running frame over one sort finds the knot before, whose next is the one after, and what a cell lacks comes
    from the ends of the cells around it, however many of those are empty. These are a row for each key and cell, ahead of the cell's others, so
    nothing is joined. Of knots of one key and time the one with the largest other values counts, before and after alike.
    """
    more = [c for c in knots.columns if c not in (key, t)]
    knot = F.struct(F.col(t).alias(t), *more)
    cell = F.floor(F.col(t) / width).cast("long").alias("_cell")
    held = knots.where(F.col(t).isNotNull() & F.col(key).isNotNull()).select(key, cell, knot.alias("_knot"))
    held = held.groupBy(key, "_cell", F.col(f"_knot.{t}").alias("_t")).agg(F.max("_knot").alias("_knot"))
    known = F.col(t).isNotNull() & F.col(key).isNotNull()
    asked = samples.where(known).select(key, cell, F.col(t).alias("_t"), F.struct(*samples.columns).alias("_row"))
    ends = held.groupBy(key, "_cell").agg(F.min("_knot").alias("_first"), F.max("_knot").alias("_last"))
    cells = ends.join(asked.select(key, "_cell").distinct(), [key, "_cell"], "full")
    order = Window.partitionBy(key)
    past = order.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    later = order.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    around = F.struct(F.last("_last", True).over(past).alias("past"), F.col("_first").alias("first"), F.last("_first", True).over(later).alias("later"))
    own = Window.partitionBy(key, "_cell")
    step = F.struct(F.col("_knot").alias("at"), F.lead("_knot").over(own.orderBy("_t")).alias("next"))
    rows = cells.select(key, "_cell", around.alias("_around")).unionByName(held.select(key, "_cell", "_t", step.alias("_step")), True).unionByName(asked, True)
    upto = own.orderBy(F.col("_t").asc_nulls_first(), F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_step", F.last("_step", True).over(upto)).withColumn("_around", F.last("_around", True).over(upto)).where(F.col("_row").isNotNull())
    after = F.when(F.col("_step").isNull(), F.coalesce("_around.first", "_around.later")).otherwise(F.coalesce("_step.next", "_around.later"))
    found = rows.select("_row.*", F.coalesce("_step.at", "_around.past").alias("before"), after.alias("after"))
    lost = samples.where(F.col(t).isNull() | F.col(key).isNull())  # they have no cell
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("before", "after")]
    return found.unionByName(lost.select("*", *none))


def tallied(asked: DataFrame, knots: DataFrame, width: float, t: str = "t") -> DataFrame:
    """asked (t and more) with `n`, how many rows of knots (t, id) are at or before t, and `last`, (t, id) of the latest of them, of equals the largest id.

    Both meet in cells of `width` with a row for each cell that carries the sums of all cells before it, so a row costs the same however many knots
    are before it. Only the cells' own sums are one task's. Asked rows without a time are not in the result.
    """
    cell = F.floor(F.col(t) / width).cast("long").alias("_cell")
    held = knots.where(F.col(t).isNotNull()).groupBy(cell, F.col(t).alias("_t")).agg(F.count(F.lit(1)).alias("_n"), F.max("id").alias("_id"))
    held = held.select("_cell", "_t", "_n", F.struct(F.col("_t").alias(t), F.col("_id").alias("id")).alias("_last"))
    rows = asked.where(F.col(t).isNotNull()).select(cell, F.col(t).alias("_t"), F.struct(*asked.columns).alias("_row"))
    none = F.lit(None).cast(held.schema["_last"].dataType)
    sums = held.groupBy("_cell").agg(F.sum("_n").alias("_n"), F.max("_last").alias("_last"))
    empty = rows.select("_cell").distinct().select("_cell", F.lit(0).cast("long").alias("_n"), none.alias("_last"))
    cells = sums.unionByName(empty).groupBy("_cell").agg(F.sum("_n").alias("_n"), F.max("_last").alias("_last"))
    past = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("_cell", F.lit(None).cast(held.schema["_t"].dataType).alias("_t"), F.sum("_n").over(past).alias("_n"), F.max("_last").over(past).alias("_last"))
    no_row = F.lit(None).cast(rows.schema["_row"].dataType)
    every = carried.unionByName(held).withColumn("_row", no_row).unionByName(rows.withColumn("_n", F.lit(0).cast("long")).withColumn("_last", none))
    upto = Window.partitionBy("_cell").orderBy(F.col("_t").asc_nulls_first(), F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("_n", F.sum("_n").over(upto)).withColumn("_last", F.last("_last", True).over(upto))
    return every.where("_row IS NOT NULL").select("_row.*", F.coalesce("_n", F.lit(0)).alias("n"), F.col("_last").alias("last"))


def hermite(t: Column, before: Column, after: Column, value: str, slope: str, time: str = "t") -> tuple[Column, Column]:
    """Value and slope at t of the cubic that has both knots' values and slopes; at the last knot itself that knot's; null outside."""
    h = after[time] - before[time]
    s = (t - before[time]) / h
    a, b, da, db = before[value], after[value], before[slope] * h, after[slope] * h
    at = a * (1 + 2 * s) * (1 - s) * (1 - s) + da * s * (1 - s) * (1 - s) + b * s * s * (3 - 2 * s) + db * s * s * (s - 1)
    rate = ((a - b) * 6 * s * (s - 1) + da * (1 - s) * (1 - 3 * s) + db * s * (3 * s - 2)) / h
    last = after.isNull() & (before[time] == t)
    return F.when(last, a).otherwise(at), F.when(last, before[slope]).otherwise(rate)
