"""Queries on annotation documents and the tables in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import tables
from tidegrid.sources import text

from . import stand_ins as t
from .catalogue import query
from .grids import cells

#: A type's vectors: one for each size, of its first part; a part whose key 3 divides lacks one of few pixels.
VECTORS = """v AS (SELECT p_type AS file, p_size * 7 - 170 AS line, min(p_partkey) AS k FROM part GROUP BY 1, 2),
kn AS (SELECT file, line, [0, 9, 20, 33, 49][i + 1] AS pixel, (3000 + k % 997 + i * (15 + k % 7)) / 10.0::DOUBLE AS value FROM v, (SELECT unnest(range(5)) AS i) WHERE NOT (k % 3 = 0 AND i = k % 5))"""
#: The table without holes: values between a line's own knots, or its end's.
FILLED = """fu AS (SELECT l.file, line, pixel, value FROM (SELECT DISTINCT file, line FROM kn) l JOIN (SELECT DISTINCT file, pixel FROM kn) USING (file) LEFT JOIN kn USING (file, line, pixel)),
fw AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pixel END IGNORE NULLS) OVER a AS p0, last_value(value IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN value IS NOT NULL THEN pixel END IGNORE NULLS) OVER b AS p1, first_value(value IGNORE NULLS) OVER b AS v1 FROM fu
  WINDOW a AS (PARTITION BY file, line ORDER BY pixel ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY file, line ORDER BY pixel ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fi AS (SELECT file, line, pixel, CASE WHEN p0 = p1 THEN v0 WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 ELSE v0 + (pixel - p0) * (v1 - v0) / (p1 - p0) END AS value FROM fw)"""


def documents(spark: SparkSession, d: str, item: Column, value: str) -> DataFrame:
    """(file, xml): an annotation document for each type, with its vectors as elements."""
    v = t.table(spark, d, "part").groupBy(F.col("p_type").alias("file"), (F.col("p_size") * 7 - 170).alias("line")).agg(F.min("p_partkey").alias("k"))
    steps = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: ~((F.col("k") % 3 == 0) & (i == F.col("k") % 5)))
    pixel = F.array_join(F.transform(steps, lambda i: F.get(F.array(*map(F.lit, (0, 9, 20, 33, 49))), i).cast("string")), " ")
    values = F.array_join(F.transform(steps, lambda i: ((3000 + F.col("k") % 997 + i * (15 + F.col("k") % 7)) / 10.0).cast("decimal(12,1)").cast("string")), " ")
    tag = lambda name, body: F.concat(F.lit("<"), name, F.lit(">"), body, F.lit("</"), name, F.lit(">"))
    one = tag(item, F.concat(tag(F.lit("line"), F.col("line").cast("string")), tag(F.lit("pixel"), pixel), tag(F.when(item == "noiseVector", "noiseLut").otherwise(value), values)))
    return v.groupBy("file").agg(F.concat(F.lit("<product>"), F.array_join(F.array_sort(F.collect_list(one)), ""), F.lit("</product>")).alias("xml"))


@query(f"WITH {VECTORS} SELECT file, line, pixel, round(value, 1) AS value FROM kn")
def calibration_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Annotation documents parsed into knots."""
    docs = documents(spark, d, F.lit("calibrationVector"), "sigmaNought")
    return text.vectors(docs, *text.CALIBRATION).select("file", "line", "pixel", F.round("value", 1).alias("value"))


@query(f"WITH {VECTORS} SELECT file, count(*) AS n, count(DISTINCT line) AS n_lines, round(sum(value), 3) AS total FROM kn GROUP BY 1")
def noise_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Range noise by the newer element names, or by the legacy ones of documents that have only those."""
    legacy = F.col("file").isin("SMALL", "PROMO")
    docs = documents(spark, d, F.lit("noiseRangeVector"), "noiseRangeLut").where(~legacy).unionByName(documents(spark, d, F.lit("noiseVector"), "noiseLut").where(legacy))
    return text.first_vectors(docs, text.NOISE).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line").alias("n_lines"), F.round(F.sum("value"), 3).alias("total"))


@query(f"""WITH px AS ({t.PIXELS}), {VECTORS}, {FILLED}, e AS (SELECT file, min(line) AS l0, max(line) AS l1, min(pixel) AS q0, max(pixel) AS q1 FROM fi GROUP BY 1),
rr AS (SELECT file, r, least(greatest(r, l0), l1) AS z FROM (SELECT DISTINCT r FROM px), e), cc AS (SELECT file, c, least(greatest(c, q0), q1) AS z FROM (SELECT DISTINCT c FROM px), e),
rs AS (SELECT rr.file, r, any_value(z) AS z, max(line) FILTER (WHERE line <= z) AS a, min(line) FILTER (WHERE line >= z) AS b FROM rr JOIN fi USING (file) GROUP BY 1, 2),
cs AS (SELECT cc.file, c, any_value(z) AS z, max(pixel) FILTER (WHERE pixel <= z) AS a, min(pixel) FILTER (WHERE pixel >= z) AS b FROM cc JOIN fi USING (file) GROUP BY 1, 2),
g AS (SELECT rs.file, px.r, px.c, CASE WHEN rs.b > rs.a THEN (rs.z - rs.a)::DOUBLE / (rs.b - rs.a) ELSE 0 END AS u, CASE WHEN cs.b > cs.a THEN (cs.z - cs.a)::DOUBLE / (cs.b - cs.a) ELSE 0 END AS w, rs.a AS la, rs.b AS lb, cs.a AS pa, cs.b AS pb FROM px JOIN rs ON rs.r = px.r JOIN cs ON cs.file = rs.file AND cs.c = px.c)
SELECT g.file, g.r, g.c, round((1 - u) * ((1 - w) * f1.value + w * f2.value) + u * ((1 - w) * f3.value + w * f4.value), 5) AS gain FROM g JOIN fi f1 ON f1.file = g.file AND f1.line = la AND f1.pixel = pa JOIN fi f2 ON f2.file = g.file AND f2.line = la AND f2.pixel = pb
JOIN fi f3 ON f3.file = g.file AND f3.line = lb AND f3.pixel = pa JOIN fi f4 ON f4.file = g.file AND f4.line = lb AND f4.pixel = pb""")
def calibration_surface(spark: SparkSession, d: str) -> DataFrame:
    """Every document's table over every cell of the grid: holes filled along lines, then pixels, then lines, ends held."""
    docs = documents(spark, d, F.lit("calibrationVector"), "sigmaNought")
    knots = text.vectors(docs, *text.CALIBRATION)
    px = cells(spark, d).select(F.col("r").alias("line"), F.col("c").alias("pixel"))
    asked = px.crossJoin(F.broadcast(docs.select("file")))  # a document for each type: few
    return tables.interpolated(asked, knots).select("file", F.col("line").alias("r"), F.col("pixel").alias("c"), F.round("value", 5).alias("gain"))
