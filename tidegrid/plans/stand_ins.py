"""The engine's relations, made from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each candidate of a scene, with the metrics that gates test."""
    q, price, tax, disc = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scene_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("target_id"), q.cast("int").alias("pixel_area"),
        (q * 40.0).alias("length_m"), (40.0 + disc * 2000.0).alias("width_m"), (price / 5000.0 - 38.0).alias("peak_hv"),
        F.when((F.col("l_linestatus") == "F") & (tax == 0.0), F.lit(None)).otherwise(tax * 300.0).alias("ratio_db"),
        F.when(F.col("l_linenumber") < 7, disc * 100.0 - 38.0).alias("clutter_db"), F.col("l_suppkey").alias("supp"), F.col("l_shipdate").alias("seen_at"),
    )


CANDIDATES = """
SELECT l_orderkey AS scene_id, l_orderkey * 10 + l_linenumber AS target_id, CAST(l_quantity AS INTEGER) AS pixel_area,
  l_quantity * 40.0::DOUBLE AS length_m, 40.0::DOUBLE + l_discount * 2000.0::DOUBLE AS width_m, l_extendedprice / 5000.0::DOUBLE - 38.0::DOUBLE AS peak_hv,
  CASE WHEN l_linestatus = 'F' AND l_tax = 0.0 THEN NULL ELSE l_tax * 300.0::DOUBLE END AS ratio_db,
  CASE WHEN l_linenumber < 7 THEN l_discount * 100.0::DOUBLE - 38.0::DOUBLE END AS clutter_db, l_suppkey AS supp, l_shipdate AS seen_at FROM lineitem
"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("scene_id"), F.col("o_custkey").alias("site"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") / 100.0).alias("area_km2"), F.col("o_orderdate").alias("acquired"), F.col("o_orderpriority").alias("mode"))


SCENES = "SELECT o_orderkey AS scene_id, o_custkey AS site, o_orderstatus AS status, o_totalprice / 100.0::DOUBLE AS area_km2, o_orderdate AS acquired, o_orderpriority AS mode FROM orders"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of cells (r, c) with HV and HH in dB; absent cells are nodata."""
    power = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.datediff("l_shipdate", F.lit("1995-01-01")) / 7).cast("int").alias("r"), (F.col("l_quantity").cast("int") - 1).alias("c"), power.alias("p"), (power * (1 + F.col("l_tax"))).alias("h"))
    return li.groupBy("r", "c").agg((10 * F.log10(F.avg("p") / 1e6)).alias("hv"), (10 * F.log10(F.avg("h") / 1e6)).alias("hh"))


PIXELS = """
SELECT CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) AS r, CAST(l_quantity AS INTEGER) - 1 AS c,
  10 * log10(avg(l_extendedprice * (1 - l_discount)) / 1e6) AS hv, 10 * log10(avg(l_extendedprice * (1 - l_discount) * (1 + l_tax)) / 1e6) AS hh
FROM lineitem GROUP BY 1, 2
"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points spread over the study area's box by their keys."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("site"), (-60.5 + (k * 7919 % 1651) / 100.0).alias("lon"), (42.5 + (k * 104729 % 1801) / 100.0).alias("lat"), F.col("s_acctbal").alias("score"), F.col("s_nationkey").alias("nation"))


SITES = "SELECT s_suppkey AS site, -60.5::DOUBLE + (s_suppkey * 7919 % 1651) / 100.0::DOUBLE AS lon, 42.5::DOUBLE + (s_suppkey * 104729 % 1801) / 100.0::DOUBLE AS lat, s_acctbal AS score, s_nationkey AS nation FROM supplier"
