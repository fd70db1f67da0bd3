"""Gates in sequence, their ledger, and rollups by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalars import closed, per
from tidegrid.params import Gates


def gates(p: Gates | None = None) -> list[tuple[str, Column]]:
    """Named predicates in their order; unknown values fail."""
    p = p or Gates()
    c = F.col
    return [
        ("min_size", closed(c("pixel_area") >= p.min_pixels)),
        ("max_size", closed(c("pixel_area") <= p.max_pixels)),
        ("aspect_ratio", closed(c("length_m") / F.greatest(c("width_m"), F.lit(1e-6)) <= p.max_aspect)),
        ("min_peak_hv", closed(c("peak_hv") >= p.min_peak_db)),
        ("copol_dominance", closed(c("ratio_db") <= p.max_ratio_db)),
        ("clutter_contrast", closed(c("peak_hv") - c("clutter_db") >= p.min_contrast_db)),
    ]


def first_rejection(rows: DataFrame, p: Gates | None = None) -> DataFrame:
    """rows with first_rejection (null if kept) and n_passed, by one expression: no stage is a pass over the data."""
    chain = gates(p)
    stage, passed = F.lit(None).cast("string"), F.lit(len(chain))
    for k in range(len(chain) - 1, -1, -1):
        stage = F.when(chain[k][1], stage).otherwise(F.lit(chain[k][0]))
        passed = F.when(chain[k][1], passed).otherwise(F.lit(k))
    return rows.withColumn("first_rejection", stage).withColumn("n_passed", passed)


def ledger(judged: DataFrame, p: Gates | None = None) -> DataFrame:
    """(stage_ord, stage, removed, remaining, pct_of_raw): one row a gate, also of those that remove nothing."""
    names = [n for n, _ in gates(p)]
    counts = judged.agg(F.count(F.lit(1)).alias("raw"), *(F.count_if(F.col("first_rejection") == n).alias(n) for n in names))
    # one row, so the running sum is over an array and needs no window
    rows = F.array(*(F.struct(F.lit(k).alias("stage_ord"), F.lit(n).alias("stage"), F.col(n).alias("removed"), (F.col("raw") - sum((F.col(m) for m in names[1 : k + 1]), F.col(names[0]))).alias("remaining")) for k, n in enumerate(names)))
    return counts.select("raw", F.inline(rows)).select("stage_ord", "stage", "removed", "remaining", F.round(100.0 * F.col("removed") / F.greatest(F.col("raw"), F.lit(1)), 2).alias("pct_of_raw"))


def scene_results(judged: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row a scene: its attributes, raw candidates and targets kept; scenes without candidates have zeros."""
    n = judged.groupBy("scene_id").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("first_rejection").isNull()).alias("targets"))
    return scenes.join(n, "scene_id", "left").fillna(0, ["raw", "targets"])


def rollup(results: DataFrame, by: str) -> DataFrame:
    """Strata by a column's text, and the grand total 'all'; ratios of sums, guarded."""
    sums = (F.count(F.lit(1)).alias("n_scenes"), F.sum("area_km2").alias("area"), F.sum("targets").alias("targets"), F.sum("raw").alias("raw_candidates"))
    parts = results.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias("stratum")).agg(*sums)
    total = parts.agg(F.lit("all").alias("stratum"), F.sum("n_scenes").alias("n_scenes"), F.sum("area").alias("area"), F.sum("targets").alias("targets"), F.sum("raw_candidates").alias("raw_candidates"))
    return parts.unionByName(total).select(
        "stratum", "n_scenes", F.round("area", 1).alias("area_km2"), "targets", "raw_candidates",
        F.round(per(F.col("targets"), F.col("area"), 1000.0), 3).alias("density"), F.round(per(F.col("raw_candidates"), F.col("area"), 1000.0), 3).alias("raw_density"),
        F.round(F.col("raw_candidates") / F.greatest(F.col("targets"), F.lit(1)), 2).alias("suppression"),
    )


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row that is last by `order` (ties by the next column), as a partial aggregation: no sort of a group."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_last"))
    return last.select("_last.*")


def terciles(rows: DataFrame, value: str, low: float = 1 / 3, high: float = 2 / 3) -> DataFrame:
    """rows with a regime by the cohort's interpolated quantiles; under three known values or equal bounds: unknown."""
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    bounds = rows.agg(F.percentile(v, F.lit(low)).alias("_lo"), F.percentile(v, F.lit(high)).alias("_hi"), F.count(v).alias("_n"))
    regime = F.when(v.isNull() | (F.col("_n") < 3) | (F.col("_lo") == F.col("_hi")), "unknown").when(v <= F.col("_lo"), "low").when(v >= F.col("_hi"), "high").otherwise("moderate")
    return rows.crossJoin(F.broadcast(bounds)).withColumn("regime", regime).drop("_lo", "_hi", "_n")


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """A page of rows in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def running(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    return rows.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(*order)))
