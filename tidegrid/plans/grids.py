"""Raster queries on the pixel grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import grid, tiles
from tidegrid.params import Window

from . import stand_ins as t
from .catalogue import query

#: The stand-in's clutter is light-tailed, so the design rate is high enough to leave hits.
P = Window(guard=(1, 1), background=(5, 5), pfa=0.25)
DENSE = f"""
px AS ({t.PIXELS}), box AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM px),
dense AS (SELECT r, c, hv, hh, CASE WHEN hv > -90 THEN greatest(pow(10.0::DOUBLE, hv / 10), 1e-6) END AS power, CASE WHEN hv > -90 THEN 1.0::DOUBLE END AS one
  FROM (SELECT r, unnest(range(c0, c1 + 1))::INTEGER AS c FROM (SELECT unnest(range(r0, r1 + 1))::INTEGER AS r, c0, c1 FROM box)) LEFT JOIN px USING (r, c))"""


def _box(name: str, k: int) -> str:
    cols = (("one", "one"), ("power", "power"), ("square", "power * power"))
    across = ", ".join(f"sum(coalesce({e}, 0)) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS {n}" for n, e in cols)
    down = ", ".join(f"sum({n}) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS {n}" for n, _ in cols)
    return f"{name}0 AS (SELECT r, c, {across} FROM dense), {name} AS (SELECT r, c, {down} FROM {name}0)"


TRAINED = f"{DENSE}, {_box('bg', 5)}, {_box('gd', 1)}, tr AS (SELECT dense.*, bg.one - gd.one AS n, bg.power - gd.power AS s, bg.square - gd.square AS q FROM dense JOIN bg USING (r, c) JOIN gd USING (r, c))"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return t.pixels(spark, d).withColumn("g", F.lit(0).cast("long"))


@query(f"WITH {DENSE} SELECT r, c, round(hv, 6) AS hv, round(hh - hv, 6) AS ratio_db, one IS NOT NULL AS valid FROM dense")
def pixel_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = grid.prepared(grid.densify(cells(spark, d)), P)
    return rows.select("r", "c", F.round("hv", 6).alias("hv"), F.round(F.col("hh") - F.col("hv"), 6).alias("ratio_db"), F.col("one").isNotNull().alias("valid"))


@query(f"WITH {DENSE}, {_box('bg', 5)} SELECT r, c, one::BIGINT AS n, round(power, 6) AS s FROM bg")
def box_sums(spark: SparkSession, d: str) -> DataFrame:
    rows = grid.box_sums(grid.prepared(grid.densify(cells(spark, d)), P), ("one", "power"), "bg", 5, 5)
    return rows.select("r", "c", F.col("bg_one").cast("long").alias("n"), F.round("bg_power", 6).alias("s"))


@query(f"WITH {TRAINED} SELECT r, c, n::BIGINT AS n, power IS NOT NULL AND n >= {P.needed(8)} AS analysed FROM tr")
def training_support(spark: SparkSession, d: str) -> DataFrame:
    return grid.training(cells(spark, d), P).select("r", "c", F.col("n").cast("long").alias("n"), grid.analysed(P, 8).alias("analysed"))


@query(f"""WITH {TRAINED}, th AS (SELECT *, greatest(n, 8) * (pow(0.25::DOUBLE, -1.0 / greatest(n, 8)) - 1) * s / greatest(n, 8) AS threshold FROM tr)
SELECT r, c, round(10 * log10(greatest(threshold, 1e-12)), 5) AS threshold_db, round(CASE WHEN threshold > 0 THEN power / threshold ELSE 0 END, 5) AS snr FROM th
WHERE power > threshold AND power IS NOT NULL AND n >= {P.needed(8)} AND coalesce(hh > -90 AND hh - hv <= 20, false)""")
def ca_cfar_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = grid.veto(grid.cell_averaging(tiles.training(cells(spark, d), P), P)).where("hit")
    return rows.select("r", "c", F.round(10 * F.log10(F.greatest("threshold", F.lit(1e-12))), 5).alias("threshold_db"), F.round(F.when(F.col("threshold") > 0, F.col("power") / F.col("threshold")).otherwise(0.0), 5).alias("snr"))


@query(f"""WITH {TRAINED}, k AS (SELECT unnest([0.3, 0.25, 0.2, 0.1])::DOUBLE AS pfa), h AS (SELECT pfa, n >= {P.needed(8)} AND power IS NOT NULL AS analysed, power > greatest(n, 8) * (pow(pfa, -1.0 / greatest(n, 8)) - 1) * s / greatest(n, 8) AND coalesce(hh > -90 AND hh - hv <= 20, false) AS hit FROM (SELECT * FROM tr WHERE power IS NOT NULL), k)
SELECT pfa, count(*) FILTER (WHERE analysed) AS pixels, count(*) FILTER (WHERE analysed AND hit) AS hits, round(count(*) FILTER (WHERE analysed AND hit) / count(*) FILTER (WHERE analysed)::DOUBLE, 6) AS rate FROM h GROUP BY 1""")
def pfa_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The detector at each operating point over the same cells: training statistics once, then a threshold for each of four rates."""
    rows = tiles.training(cells(spark, d), P).where("power IS NOT NULL").withColumn("pfa", F.explode(F.array(*map(F.lit, (0.3, 0.25, 0.2, 0.1)))))
    n = F.greatest(F.col("n"), F.lit(8.0))
    rows = rows.withColumn("analysed", grid.analysed(P, 8)).withColumn("hit", F.col("analysed") & (F.col("power") > n * F.expm1(-F.log("pfa") / n) * F.col("s") / n))
    s = grid.veto(rows).groupBy("pfa").agg(F.count_if("analysed").alias("pixels"), F.count_if("hit").alias("hits"))
    return s.select("pfa", "pixels", "hits", F.round(F.col("hits") / F.col("pixels"), 6).alias("rate"))


_TABLE = grid.gamma_table(P.pfa)


@query(f"""WITH {TRAINED}, k AS (SELECT [{", ".join(f"{x!r}::DOUBLE" for x in _TABLE.tolist())}] AS q, ln(0.1::DOUBLE) AS l0, (ln(50.0::DOUBLE) - ln(0.1::DOUBLE)) / 1023 AS step),
m AS (SELECT *, s / greatest(n, 12) AS mean, greatest(n, 12) AS nn FROM tr), v AS (SELECT m.*, greatest(0.1::DOUBLE, least(50.0::DOUBLE, mean * mean / greatest(nn / (nn - 1) * (m.q / nn - mean * mean), 2.2250738585072014e-308))) AS shape FROM m),
a AS (SELECT v.*, k.q AS tab, (ln(shape) - l0) / step AS pos, greatest(0, least(1022, CAST(floor((ln(shape) - l0) / step) AS INTEGER))) AS i FROM v, k),
th AS (SELECT *, mean / shape * (tab[i + 1] + (tab[i + 2] - tab[i + 1]) * (pos - i)) AS threshold FROM a)
SELECT r, c, round(shape, 4) AS shape, round(threshold, 6) AS threshold FROM th WHERE power > threshold AND n >= {P.needed(12)}""")
def gamma_cfar_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = grid.gamma_threshold(tiles.training(cells(spark, d), P), P).where("hit")
    return rows.select("r", "c", F.round("shape", 4).alias("shape"), F.round("threshold", 6).alias("threshold"))


SEAMS = """prof AS (SELECT c, median(hv) AS m FROM px GROUP BY 1), st AS (SELECT c, (coalesce(lead(m) OVER w, m) - coalesce(lag(m) OVER w, m)) / CASE WHEN lead(c) OVER w IS NULL OR lag(c) OVER w IS NULL THEN 1 ELSE 2 END AS step FROM prof WINDOW w AS (ORDER BY c)),
md AS (SELECT median(step) AS mid FROM st), ma AS (SELECT any_value(mid) AS mid, median(abs(step - mid)) AS mad FROM st, md),
fl AS (SELECT c, abs(step - mid) / (1.4826::DOUBLE * CASE WHEN mad > 0 THEN mad ELSE 2.220446049250313e-16 * greatest(1.0, abs(mid)) END) AS z FROM st, ma),
tu AS (SELECT *, z > 1.5 AS flag, CASE WHEN (z > 1.5) <> lag(z > 1.5) OVER (ORDER BY c) THEN 1 ELSE 0 END AS turn FROM fl), ru AS (SELECT *, sum(turn) OVER (ORDER BY c) AS run FROM tu),
pk AS (SELECT run, row_number() OVER (ORDER BY max(z) DESC, run DESC) AS k FROM ru WHERE flag GROUP BY run), se AS (SELECT ru.*, flag AND coalesce(k <= 3, false) AS seam FROM ru LEFT JOIN pk USING (run)),
ex AS (SELECT c, z, seam, max(seam) OVER (ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS excluded FROM se)"""


@query(f"WITH {DENSE}, {SEAMS} SELECT c, round(z, 5) AS z, seam, excluded FROM ex")
def seams(spark: SparkSession, d: str) -> DataFrame:
    return grid.seam_columns(cells(spark, d), sigma=1.5, groups=3, margin=1).select("c", F.round("z", 5).alias("z"), "seam", "excluded")


@query(f"""WITH {DENSE}, {SEAMS}, f AS (SELECT CASE WHEN power IS NULL THEN 'invalid_or_nodata' WHEN (r * 7 + dense.c * 3) % 41 <= 2 THEN 'land_and_coastal_buffer' WHEN r < r0 + 4 OR r > r1 - 4 OR dense.c < c0 + 4 OR dense.c > c1 - 4 THEN 'swath_border'
  WHEN excluded THEN 'subswath_seams' WHEN NOT ((r + dense.c) % 13 <= 1) AND (r + dense.c) % 5 = 0 THEN 'sea_ice_or_unknown' ELSE 'analysed' END AS stage FROM dense JOIN ex ON dense.c = ex.c, box)
SELECT stage, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM f), 6) AS fraction FROM f GROUP BY 1""")
def mask_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Fractions of all cells that each mask removes first."""
    px = cells(spark, d)
    dense = grid.prepared(grid.densify(px), P)
    box = px.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    rows = dense.join(F.broadcast(grid.seam_columns(px, 1.5, 3, 1).select("g", "c", "excluded")), ["g", "c"]).crossJoin(F.broadcast(box))
    r, c = F.col("r"), F.col("c")
    stage = (
        F.when(F.col("power").isNull(), "invalid_or_nodata").when((r * 7 + c * 3) % 41 <= 2, "land_and_coastal_buffer")
        .when((r < F.col("r0") + 4) | (r > F.col("r1") - 4) | (c < F.col("c0") + 4) | (c > F.col("c1") - 4), "swath_border").when(F.col("excluded"), "subswath_seams")
        .when(~((r + c) % 13 <= 1) & ((r + c) % 5 == 0), "sea_ice_or_unknown").otherwise("analysed")
    )
    n = rows.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("stage", "n", F.round(F.col("n") / F.col("total"), 6).alias("fraction"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    px = cells(spark, d)
    bright = px.where("hv > -10.9")
    return grid.label_components(bright).join(bright, ["g", "r", "c"])


LABELLED = f"""
px AS ({t.PIXELS}), b AS (SELECT r, c, hv, hh, r::BIGINT * 1048576 + c AS code FROM px WHERE hv > -10.9),
e AS (SELECT x.code AS a, y.code AS z FROM b x JOIN b y ON abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1),
w(code, label) AS (SELECT code, code FROM b UNION SELECT e.z, w.label FROM w JOIN e ON e.a = w.code WHERE w.label < e.z), lab AS (SELECT code, min(label) AS label FROM w GROUP BY 1)"""


@query(f"WITH RECURSIVE {LABELLED} SELECT r, c, label FROM b JOIN lab USING (code)")
def components(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("r", "c", "label")


@query(f"""WITH RECURSIVE {LABELLED}, s AS (SELECT label, count(*) AS pixel_area, min(r) AS r0, min(c) AS c0, max(r) + 1 AS r1, max(c) + 1 AS c1, avg(r) AS rc, avg(c) AS cc, max(hv) AS peak_hv, 10 * log10(avg(pow(10.0::DOUBLE, hv / 10))) AS mean_hv,
  10 * log10(avg(pow(10.0::DOUBLE, hh / 10)) / avg(pow(10.0::DOUBLE, hv / 10))) AS ratio_db, var_pop(r) AS vr, var_pop(c) AS vc, covar_pop(r, c) AS cov FROM b JOIN lab USING (code) GROUP BY 1)
SELECT label, pixel_area, r0, c0, r1, c1, round(rc, 5) AS rc, round(cc, 5) AS cc, round(peak_hv, 5) AS peak_hv, round(mean_hv, 5) AS mean_hv, round(ratio_db, 5) AS ratio_db,
  round(4 * sqrt((vr + vc) / 2 + 1.0::DOUBLE / 12 + sqrt(pow((vr - vc) / 2, 2) + cov * cov)), 4) AS major, round(4 * sqrt(greatest((vr + vc) / 2 + 1.0::DOUBLE / 12 - sqrt(pow((vr - vc) / 2, 2) + cov * cov), 0)), 4) AS minor FROM s""")
def component_stats(spark: SparkSession, d: str) -> DataFrame:
    s = grid.component_stats(_labelled(spark, d))
    return s.select("label", "pixel_area", "r0", "c0", "r1", "c1", *(F.round(x, 5).alias(x) for x in ("rc", "cc", "peak_hv", "mean_hv", "ratio_db")), *(F.round(x, 4).alias(x) for x in ("major", "minor")))


@query(f"""WITH RECURSIVE {LABELLED}, s AS (SELECT label, min(r) AS r0, min(c) AS c0, max(r) AS r1, max(c) AS c1, max(hv) AS peak FROM b JOIN lab USING (code) GROUP BY 1)
SELECT label, round(any_value(peak) - median(hv), 5) AS contrast, coalesce(any_value(peak) - median(hv) >= 3, false) AS passed FROM s JOIN px ON px.r BETWEEN r0 AND r1 AND px.c BETWEEN c0 AND c1 GROUP BY 1""")
def contrast_gate(spark: SparkSession, d: str) -> DataFrame:
    """Peak against the median over the component's bounding box, not over the component."""
    s = grid.component_stats(_labelled(spark, d))
    box = s.select("g", "label", "peak_hv", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("r"), "c0", "c1").select("g", "label", "peak_hv", "r", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("c"))
    rows = box.join(cells(spark, d).select("g", "r", "c", "hv"), ["g", "r", "c"]).groupBy("label").agg((F.first("peak_hv") - F.median("hv")).alias("x"))
    return rows.select("label", F.round("x", 5).alias("contrast"), F.coalesce(F.col("x") >= 3, F.lit(False)).alias("passed"))


@query(f"""WITH px AS ({t.PIXELS}), k AS (SELECT r, c, CASE WHEN (r * 5 + c * 11) % 29 IN (3, 8, 9, 10) THEN 1 ELSE 0 END AS cloud FROM px), o(y, x) AS (SELECT * FROM (VALUES (-2, 0), (-1, -1), (-1, 0), (-1, 1), (0, -2), (0, -1), (0, 0), (0, 1), (0, 2), (1, -1), (1, 0), (1, 1), (2, 0)) v),
v AS (SELECT k.r, k.c, max(n.cloud) AS shaded, count(n.cloud) = 13 AS whole FROM k CROSS JOIN o LEFT JOIN k n ON n.r = k.r + y AND n.c = k.c + x GROUP BY 1, 2) SELECT r, c, shaded = 0 AND whole AS visible FROM v""")
def visibility(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose disk of radius 2 is whole and without cloud."""
    k = cells(spark, d).select("r", "c", F.when(((F.col("r") * 5 + F.col("c") * 11) % 29).isin(3, 8, 9, 10), 1).otherwise(0).alias("cloud"))
    disk = [(y, x) for y in range(-2, 3) for x in range(-2, 3) if y * y + x * x <= 4]
    sent = k.select("cloud", F.explode(F.array(*(F.struct((F.col("r") + y).alias("r"), (F.col("c") + x).alias("c")) for y, x in disk))).alias("p")).select("cloud", "p.r", "p.c")
    got = sent.groupBy("r", "c").agg(F.max("cloud").alias("shaded"), F.count("cloud").alias("n"))
    return k.join(got, ["r", "c"]).select("r", "c", ((F.col("shaded") == 0) & (F.col("n") == len(disk))).alias("visible"))


@query(f"""WITH px AS ({t.PIXELS}), po AS (SELECT r, c, pow(10.0::DOUBLE, hv / 10) AS p FROM px), tg AS (SELECT r AS k, c AS j, r + ((r * 3 + c) % 4) / 4.0::DOUBLE AS y, c + ((r + c * 5) % 4) / 4.0::DOUBLE AS x FROM px),
f AS (SELECT k, j, y, x, floor(y)::INTEGER AS r0, floor(x)::INTEGER AS c0 FROM tg), n AS (SELECT k, j, sum(p * CASE WHEN a = 1 THEN y - r0 ELSE 1 - (y - r0) END * CASE WHEN b = 1 THEN x - c0 ELSE 1 - (x - c0) END) AS v, count(p) AS n
  FROM f CROSS JOIN (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) z(a, b)) LEFT JOIN po ON po.r = r0 + a AND po.c = c0 + b GROUP BY 1, 2)
SELECT k, j, round(CASE WHEN n = 4 THEN 10 * log10(v) END, 5) AS value_db FROM n""")
def bilinear_gather(spark: SparkSession, d: str) -> DataFrame:
    px = grid.prepared(cells(spark, d), P)
    r, c = F.col("r"), F.col("c")
    # quarters of a cell, so that truncation of negative rows needs the same rule in both engines
    targets = px.select("g", r.alias("k"), c.alias("j"), (r + ((r * 3 + c) % 4) / 4.0).alias("y"), (c + ((r + c * 5) % 4) / 4.0).alias("x"))
    return grid.bilinear(targets, px).select("k", "j", F.round(10 * F.log10("value"), 5).alias("value_db"))


@query(f"WITH px AS ({t.PIXELS}), k AS (SELECT r, c, c // 10 * 10 AS c0 FROM px), v AS (SELECT r, c, 300 + c0 * 1.5::DOUBLE + (c0 % 20) AS a, 300 + (c0 + 10) * 1.5::DOUBLE + ((c0 + 10) % 20) AS b, (c - c0) / 10.0::DOUBLE AS f FROM k) SELECT r, c, round(a + (b - a) * f, 6) AS gain FROM v")
def lut_interp(spark: SparkSession, d: str) -> DataFrame:
    """A coarse table's knots on both sides of a cell, and the line between them."""
    knots = spark.range(0, 61, 10).select(F.col("id").cast("int").alias("c0"), (300 + F.col("id") * 1.5 + F.col("id") % 20).alias("a"))
    px = cells(spark, d).withColumn("c0", (F.floor(F.col("c") / 10) * 10).cast("int"))
    rows = px.join(F.broadcast(knots), "c0").join(F.broadcast(knots.select((F.col("c0") - 10).alias("c0"), F.col("a").alias("b"))), "c0")
    return rows.select("r", "c", F.round(F.col("a") + (F.col("b") - F.col("a")) * (F.col("c") - F.col("c0")) / 10.0, 6).alias("gain"))


@query("WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 5 AS swath, CASE WHEN l_extendedprice > 2000 THEN l_extendedprice * l_extendedprice / 1e8 END AS power, l_discount / 10 AS noise FROM lineitem), k AS (SELECT swath, greatest(0.75, least(1.25, quantile_cont(power, 0.1) / nullif(avg(noise), 0))) AS scale FROM x GROUP BY 1) SELECT id, round(CASE WHEN power IS NOT NULL THEN greatest(power - noise * scale, 1e-6) END, 6) AS sigma FROM x JOIN k USING (swath)")
def calibrate_denoise(spark: SparkSession, d: str) -> DataFrame:
    """Squared amplitude over the gain, noise taken away by a subswath's clipped scale; what wasn't positive stays unknown."""
    li = t.table(spark, d, "lineitem")
    price = F.col("l_extendedprice")
    x = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 5).alias("swath"), F.when(price > 2000, price * price / 1e8).alias("power"), (F.col("l_discount") / 10).alias("noise"))
    k = x.groupBy("swath").agg(F.greatest(F.lit(0.75), F.least(F.lit(1.25), F.percentile("power", F.lit(0.1)) / F.avg("noise"))).alias("scale"))
    return x.join(F.broadcast(k), "swath").select("id", F.round(F.when(F.col("power").isNotNull(), F.greatest(F.col("power") - F.col("noise") * F.col("scale"), F.lit(1e-6))), 6).alias("sigma"))


@query(f"""WITH px AS ({t.PIXELS}), l AS (SELECT unnest([1, 2, 4, 8]) AS level), o AS (SELECT level, px.* FROM l JOIN px ON r % level = 0 AND c % level = 0)
SELECT level, count(*) AS n, count(*) FILTER (WHERE abs((hh - hv) - round(hh - hv, 3)) > 0.0004) AS ratio_off, count(*) FILTER (WHERE hv > hh) AS inverted, round(min(hv), 5) AS low, round(max(hv), 5) AS high FROM o GROUP BY 1""")
def stack_inspection(spark: SparkSession, d: str) -> DataFrame:
    """Counts and ranges of a band stack and of each of its overviews, in one pass over the cells."""
    ratio = F.col("hh") - F.col("hv")
    fits = F.filter(F.array(*map(F.lit, (1, 2, 4, 8))), lambda k: (F.col("r") % k == 0) & (F.col("c") % k == 0))
    rows = cells(spark, d).withColumn("level", F.explode(fits))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(ratio - F.round(ratio, 3)) > 0.0004).alias("ratio_off"), F.count_if(F.col("hv") > F.col("hh")).alias("inverted"), F.round(F.min("hv"), 5).alias("low"), F.round(F.max("hv"), 5).alias("high"))


@query(f"WITH px AS ({t.PIXELS}) SELECT r, c, round(hv, 6) AS hv FROM px WHERE r % 4 = 0 AND c % 4 = 0")
def overview_decimate(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).where("r % 4 = 0 AND c % 4 = 0").select("r", "c", F.round("hv", 6).alias("hv"))


@query(f"""WITH {DENSE}, s AS (SELECT floor(r / 32.0)::INTEGER AS stripe, count(*) AS cells, count(power) AS valid, count(*) FILTER (WHERE power < 0.01) AS low, count(*) FILTER (WHERE 15 + (c % 40) NOT BETWEEN 18 AND 50) AS angle FROM dense GROUP BY 1)
SELECT stripe, cells, valid, array_to_string(list_filter([CASE WHEN valid::DOUBLE / cells < 0.1 THEN 'valid' END, CASE WHEN low::DOUBLE / nullif(valid, 0) > 0.05 OR valid = 0 THEN 'nonpositive' END, CASE WHEN angle > 250 THEN 'incidence' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def stripe_quality(spark: SparkSession, d: str) -> DataFrame:
    """Totals of stripes of rows, and the reasons against each."""
    rows = grid.prepared(grid.densify(cells(spark, d)), P).groupBy(F.floor(F.col("r") / 32.0).cast("int").alias("stripe"))
    s = rows.agg(F.count(F.lit(1)).alias("cells"), F.count("power").alias("valid"), F.count_if(F.col("power") < 0.01).alias("low"), F.count_if(~(15 + F.col("c") % 40).between(18, 50)).alias("angle"))
    reasons = F.array(F.when(F.col("valid") / F.col("cells") < 0.1, "valid"), F.when((F.col("valid") == 0) | (F.col("low") > 0.05 * F.col("valid")), "nonpositive"), F.when(F.col("angle") > 250, "incidence"))
    return s.select("stripe", "cells", "valid", F.array_join(F.array_compact(reasons), ",").alias("reasons"))


@query(f"""WITH px AS ({t.PIXELS}), j AS (SELECT hv, hv + ((r * 13 + c * 7) % 100 - 50) / 4000.0::DOUBLE AS ref FROM px) SELECT count(*) AS n, round(quantile_cont(abs(hv - ref), 0.95), 6) AS p95, round(avg(abs(hv - ref)), 6) AS mae,
count(*) FILTER (WHERE sign(hv) <> sign(ref)) AS sign_mismatch, count(*) >= 4096 AND quantile_cont(abs(hv - ref), 0.95) <= 0.02 AS passed FROM j""")
def matched_power(spark: SparkSession, d: str) -> DataFrame:
    """Our cells against a reference's, jointly valid ones only."""
    ours = cells(spark, d).select("r", "c", "hv")
    ref = ours.select("r", "c", (F.col("hv") + ((F.col("r") * 13 + F.col("c") * 7) % 100 - 50) / 4000.0).alias("ref"))
    diff = F.abs(F.col("hv") - F.col("ref"))
    s = ours.join(ref, ["r", "c"]).agg(F.count(F.lit(1)).alias("n"), F.percentile(diff, F.lit(0.95)).alias("p"), F.avg(diff).alias("a"), F.count_if(F.signum("hv") != F.signum("ref")).alias("sign_mismatch"))
    return s.select("n", F.round("p", 6).alias("p95"), F.round("a", 6).alias("mae"), "sign_mismatch", ((F.col("n") >= 4096) & (F.col("p") <= 0.02)).alias("passed"))


@query(f"WITH px AS ({t.PIXELS}), a AS (SELECT r, c, abs(r * 3 + c) % 4 AS k, round(hv) AS v FROM px), b AS (SELECT r, c, abs(r + c * 2) % 4 AS k, round(hh) AS v FROM px) SELECT a.k AS a_class, b.k AS b_class, count(*) AS n, count(*) FILTER (WHERE a.v = b.v) AS equal FROM a JOIN b USING (r, c) GROUP BY 1, 2")
def band_compare(spark: SparkSession, d: str) -> DataFrame:
    px = cells(spark, d)
    a = px.select("r", "c", (F.abs(F.col("r") * 3 + F.col("c")) % 4).alias("a_class"), F.round("hv").alias("va"))
    b = px.select("r", "c", (F.abs(F.col("r") + F.col("c") * 2) % 4).alias("b_class"), F.round("hh").alias("vb"))
    return a.join(b, ["r", "c"]).groupBy("a_class", "b_class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("va") == F.col("vb")).alias("equal"))


@query(f"""WITH px AS ({t.PIXELS}), core AS (SELECT o_orderkey % 300 AS r0, o_custkey % 45 AS c0 FROM orders WHERE o_orderstatus = 'P'), cut AS (SELECT o_orderkey % 300 AS r0, o_custkey % 45 AS c0 FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 200000)
SELECT r, c FROM px WHERE EXISTS (SELECT 1 FROM core WHERE r BETWEEN r0 AND r0 + 5 AND c BETWEEN c0 AND c0 + 5) AND NOT EXISTS (SELECT 1 FROM cut WHERE r BETWEEN r0 AND r0 + 2 AND c BETWEEN c0 AND c0 + 2)""")
def coverage_masks(spark: SparkSession, d: str) -> DataFrame:
    """Cells in any completed core and in no excluded rectangle: rectangles become cells, then semi and anti joins."""
    o = t.table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_totalprice", (F.col("o_orderkey") % 300).cast("int").alias("r0"), (F.col("o_custkey") % 45).cast("int").alias("c0"))

    def covered(rects: DataFrame, k: int) -> DataFrame:
        return rects.select(F.explode(F.sequence("r0", F.col("r0") + k)).alias("r"), "c0").select("r", F.explode(F.sequence("c0", F.col("c0") + k)).alias("c")).distinct()

    px = cells(spark, d).select("r", "c")
    return px.join(covered(o, 5), ["r", "c"], "left_semi").join(covered(o.where("o_totalprice >= 200000"), 2), ["r", "c"], "left_anti")
