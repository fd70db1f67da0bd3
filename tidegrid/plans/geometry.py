"""Queries on tiles, polygons, windows of cells and times between knots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import spatial
from tidegrid.operators import areas, brackets, cuts, grid, polygons, tiles

from . import stand_ins as t
from .catalogue import query
from .grids import TRAINED, P, cells

#: Tiles smaller than the stand-in grid, so that halos are exchanged.
CORE = 16


@query(f"WITH {TRAINED} SELECT r, c, n::BIGINT AS n, round(s, 6) AS s, round(q, 6) AS q, power IS NOT NULL AND n >= {P.needed(8)} AS analysed FROM tr JOIN (SELECT r, c FROM px) USING (r, c)")
def tiled_training(spark: SparkSession, d: str) -> DataFrame:
    """Training statistics by tiles with halos: one shuffle."""
    rows = tiles.training(cells(spark, d), P, CORE)
    return rows.select("r", "c", F.col("n").cast("long").alias("n"), F.round("s", 6).alias("s"), F.round("q", 6).alias("q"), grid.analysed(P, 8).alias("analysed"))


MASKED = TRAINED.replace("CASE WHEN hv > -90 THEN", "CASE WHEN hv > -90 AND (hh - hv) <= 0.16 THEN")


@query(f"""WITH RECURSIVE {MASKED}, b AS (SELECT r, c, hv, r::BIGINT * 1048576 + c AS code FROM tr WHERE power > greatest(n, 8) * (pow(0.25::DOUBLE, -1.0 / greatest(n, 8)) - 1) * s / greatest(n, 8) AND n >= {P.needed(8)} AND coalesce(hh > -90 AND hh - hv <= 20, false)),
e AS (SELECT x.code AS a, y.code AS z FROM b x JOIN b y ON abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1), w(code, label) AS (SELECT code, code FROM b UNION SELECT e.z, w.label FROM w JOIN e ON e.a = w.code WHERE w.label < e.z),
lab AS (SELECT code, min(label) AS label FROM w GROUP BY 1) SELECT label, count(*) AS pixel_area, min(r) AS r0, min(c) AS c0, max(r) + 1 AS r1, max(c) + 1 AS c1, round(max(hv), 5) AS peak_hv FROM b JOIN lab USING (code) GROUP BY 1""")
def tiled_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates under a caller's mask: threshold by tiles with halos, then components of the whole grid."""
    px = cells(spark, d).withColumn("ok", F.col("hh") - F.col("hv") <= 0.16)
    hits = grid.veto(grid.cell_averaging(tiles.training(px, P, CORE, mask="ok"), P)).where("hit").select("g", "r", "c", "hv")
    rows = grid.label_components(hits, tile=CORE).join(hits, ["g", "r", "c"]).groupBy("label")
    return rows.agg(F.count(F.lit(1)).alias("pixel_area"), F.min("r").alias("r0"), F.min("c").alias("c0"), (F.max("r") + 1).alias("r1"), (F.max("c") + 1).alias("c1"), F.round(F.max("hv"), 5).alias("peak_hv"))


def rings(spark: SparkSession, d: str) -> DataFrame:
    """A nation's area: the ring of its sites by their angle around their mean; nations of three sites or more."""
    p = t.sites(spark, d)
    mid = p.groupBy("nation").agg(F.avg("lon").alias("mx"), F.avg("lat").alias("my"), F.count(F.lit(1)).alias("k")).where("k >= 3")
    rows = p.join(mid, "nation").withColumn("seq", F.struct(F.atan2(F.col("lat") - F.col("my"), F.col("lon") - F.col("mx")), "site"))
    return rows.select(F.col("nation").alias("poly"), F.lit(0).alias("ring"), "seq", F.col("lon").alias("x"), F.col("lat").alias("y"))


RINGS = f"""
p AS ({t.SITES}), m AS (SELECT nation, avg(lon) AS mx, avg(lat) AS my FROM p GROUP BY 1 HAVING count(*) >= 3),
v AS (SELECT nation AS poly, lon AS x, lat AS y, row_number() OVER (PARTITION BY nation ORDER BY atan2(lat - my, lon - mx), site) AS seq FROM p JOIN m USING (nation))"""
EDGES = """SELECT poly, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM {} WINDOW w AS (PARTITION BY poly ORDER BY seq)"""
#: Of a point (x, y) and an edge: the signed area, whether it crosses the ray to the right, and whether the point is on it.
SIGNED = "((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))"
RIGHT = f"((y1 < y) <> (y2 < y) AND ({SIGNED} > 0) = (y2 > y1))"
ON = f"({SIGNED} = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2))"
HELD = f"count(*) FILTER (WHERE {RIGHT}) % 2 = 1 OR bool_or({ON})"
#: Cells of the polygon index, in degrees and in metres.
DEGREES, METRES = 2.0, 200_000.0
#: Cells for tables of points and polygons that both grow: smaller ones leave fewer edges to compare with each point.
FINE = 0.25
CUSTOMERS = "SELECT c_custkey AS cust, -60.5::DOUBLE + (c_custkey * 6971 % 16510) / 1000.0::DOUBLE AS x, 42.5::DOUBLE + (c_custkey * 100003 % 18010) / 1000.0::DOUBLE AS y FROM customer"


@query(f"""WITH {RINGS}, e AS ({EDGES.format('v')}), c AS ({CUSTOMERS}), i AS (SELECT cust, poly FROM c, e GROUP BY cust, poly HAVING {HELD})
SELECT c.cust, round(x, 6) AS lon, round(y, 6) AS lat, count(poly) AS n_areas, coalesce(min(poly), -1) AS first_area, coalesce(max(poly), -1) AS last_area FROM c LEFT JOIN i ON i.cust = c.cust GROUP BY 1, 2, 3""")
def customers_in_areas(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's place, and the areas of a table of polygons that hold it, boundaries included."""
    k = F.col("c_custkey")
    points = t.table(spark, d, "customer").select(k.alias("cust"), (-60.5 + (k * 6971 % 16510) / 1000.0).alias("x"), (42.5 + (k * 100003 % 18010) / 1000.0).alias("y"))
    index = polygons.index(polygons.edges(rings(spark, d)), FINE)
    rows = polygons.locate(points, index, FINE)
    return rows.select("cust", F.round("x", 6).alias("lon"), F.round("y", 6).alias("lat"), F.size("found").cast("long").alias("n_areas"), *(F.coalesce(F.try_element_at("found", F.lit(k)), F.lit(-1)).alias(n) for k, n in ((1, "first_area"), (-1, "last_area"))))


N, K, RHO0, E = spatial.conic_constants()
#: A rotated affine grid over the study area, in planar metres.
AFFINE = (2.0e6, 26_000.0, 2_500.0, 1.75e6, -6_000.0, -7_500.0)


def placed(spark: SparkSession, d: str) -> DataFrame:
    a0, ac, ar, b0, bc, br = AFFINE
    c, r = F.col("c") + 0.5, F.col("r") + 0.5
    return cells(spark, d).select("g", "r", "c", "hv", (a0 + c * ac + r * ar).alias("x_m"), (b0 + c * bc + r * br).alias("y_m"))


PLACED = f"""px AS ({t.PIXELS}), cells AS (SELECT r, c, {AFFINE[0]}::DOUBLE + (c + 0.5::DOUBLE) * {AFFINE[1]}::DOUBLE + (r + 0.5::DOUBLE) * {AFFINE[2]}::DOUBLE AS x_m,
  {AFFINE[3]}::DOUBLE + (c + 0.5::DOUBLE) * {AFFINE[4]}::DOUBLE + (r + 0.5::DOUBLE) * {AFFINE[5]}::DOUBLE AS y_m FROM px)"""
INVERSE = f"""k0 AS (SELECT *, pow(sqrt(x_m * x_m + ({RHO0!r}::DOUBLE - y_m) * ({RHO0!r}::DOUBLE - y_m)) / {spatial.MAJOR_M * K!r}::DOUBLE, 1.0::DOUBLE / {N!r}::DOUBLE) AS tt FROM cells), k1 AS (SELECT *, pi() / 2 - 2 * atan(tt) AS p FROM k0)""" + "".join(
    f", k{i + 1} AS (SELECT * EXCLUDE (p), pi() / 2 - 2 * atan(tt * exp(-{E!r}::DOUBLE * atanh({E!r}::DOUBLE * sin(p)))) AS p FROM k{i})" for i in range(1, 7)
) + f", geo AS (SELECT r, c, degrees(atan2(x_m, {RHO0!r}::DOUBLE - y_m) / {N!r}::DOUBLE) - 95.0::DOUBLE AS x, degrees(p) AS y FROM k7)"


@query(f"""WITH {RINGS}, e AS ({EDGES.format('v')}), {PLACED}, {INVERSE}, i AS (SELECT r, c, poly FROM geo, e GROUP BY r, c, poly HAVING {HELD})
SELECT geo.r, geo.c, round(x, 6) AS lon, round(y, 6) AS lat, count(poly) > 0 AS inside, count(poly) AS n_areas FROM geo LEFT JOIN i ON i.r = geo.r AND i.c = geo.c GROUP BY 1, 2, 3, 4""")
def area_raster(spark: SparkSession, d: str) -> DataFrame:
    """All cells of a projected, rotated grid: centres back to degrees, then inside the table's areas or not."""
    px = placed(spark, d)
    lon, lat = spatial.conic_inverse(F.col("x_m"), F.col("y_m"))
    points = px.select("r", "c", lon.alias("lon"), lat.alias("lat"))
    rows = polygons.locate(points, polygons.index(polygons.edges(rings(spark, d)), DEGREES), DEGREES, "lon", "lat")
    return rows.select("r", "c", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), (F.size("found") > 0).alias("inside"), F.size("found").cast("long").alias("n_areas"))


CONIC = f"""y0 AS (SELECT *, radians(y) AS ph FROM v), yy AS (SELECT *, {spatial.MAJOR_M * K!r}::DOUBLE * pow(tan(pi() / 4 - ph / 2) / pow((1 - {E!r}::DOUBLE * sin(ph)) / (1 + {E!r}::DOUBLE * sin(ph)), {E / 2!r}::DOUBLE), {N!r}::DOUBLE) AS rho FROM y0),
vm AS (SELECT poly, seq, rho * sin({N!r}::DOUBLE * radians(x + 95.0::DOUBLE)) AS x, {RHO0!r}::DOUBLE - rho * cos({N!r}::DOUBLE * radians(x + 95.0::DOUBLE)) AS y FROM yy)"""
NEAR = "power(x - (x1 + tt * (x2 - x1)), 2) + power(y - (y1 + tt * (y2 - y1)), 2)"
BUFFER = 60_000.0


@query(f"""WITH {RINGS}, {CONIC}, e AS ({EDGES.format('vm')}), {PLACED}, geo AS (SELECT r, c, x_m AS x, y_m AS y FROM cells),
q AS (SELECT geo.*, e.*, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)), 0.0), 1.0) AS tt FROM geo, e WHERE x1 <> x2 OR y1 <> y2),
i AS (SELECT r, c, poly, {HELD} AS held, min({NEAR}) <= {BUFFER * BUFFER!r}::DOUBLE AS near FROM q GROUP BY r, c, poly),
f AS (SELECT r, c, bool_or(held) AS land, bool_or(held OR near) AS masked FROM i GROUP BY r, c)
SELECT CASE WHEN land THEN 'land' WHEN masked THEN 'coast' ELSE 'water' END AS stage, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM px), 6) AS fraction FROM f GROUP BY 1""")
def land_mask(spark: SparkSession, d: str) -> DataFrame:
    """The grid's cells on land, within the coastal buffer, and on water, by polygons projected into the grid's metres."""
    v = rings(spark, d)
    x, y = spatial.conic(F.col("x"), F.col("y"))
    e = polygons.edges(v.select("poly", "ring", "seq", x.alias("x"), y.alias("y")))
    index = polygons.index(e, METRES, BUFFER)
    points = placed(spark, d).select("r", "c", "x_m", "y_m")
    land = polygons.locate(points, index, METRES, "x_m", "y_m").withColumnRenamed("found", "land")
    rows = polygons.locate(land, index, METRES, "x_m", "y_m", BUFFER)
    n = rows.groupBy(F.when(F.size("land") > 0, "land").when(F.size("found") > 0, "coast").otherwise("water").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("stage", "n", F.round(F.col("n") / F.col("total"), 6).alias("fraction"))


@query(f"""WITH {RINGS}, e AS ({EDGES.format('v')}), s AS (SELECT 'SW' AS scene, [-58.0, 44.0, -53.0, 49.0] AS b UNION ALL SELECT 'NE', [-52.05, 51.05, -44.95, 58.05] UNION ALL SELECT 'far', [10.0, 10.0, 11.0, 11.0] UNION ALL SELECT 'tiny', [-52.001, 51.001, -52.0, 51.002]),
f AS (SELECT scene, unnest([[b[1], b[2], b[3], b[2]], [b[3], b[2], b[3], b[4]], [b[3], b[4], b[1], b[4]], [b[1], b[4], b[1], b[2]]]) AS z FROM s), g AS (SELECT scene, z[1]::DOUBLE AS fx, z[2]::DOUBLE AS fy, z[3]::DOUBLE AS gx, z[4]::DOUBLE AS gy FROM f),
cut AS (SELECT DISTINCT poly, scene FROM e, g WHERE sign((x2 - x1) * (fy - y1) - (y2 - y1) * (fx - x1)) * sign((x2 - x1) * (gy - y1) - (y2 - y1) * (gx - x1)) < 0 AND sign((gx - fx) * (y1 - fy) - (gy - fy) * (x1 - fx)) * sign((gx - fx) * (y2 - fy) - (gy - fy) * (x2 - fx)) < 0),
w1 AS (SELECT poly, scene FROM v, s WHERE x BETWEEN b[1] AND b[3] AND y BETWEEN b[2] AND b[4]), w2 AS (SELECT poly, scene FROM (SELECT scene, fx AS x, fy AS y FROM g), e GROUP BY scene, x, y, poly HAVING {HELD})
SELECT scene, count(DISTINCT poly) AS n_areas, min(poly) AS first_area FROM (SELECT * FROM cut UNION SELECT * FROM w1 UNION SELECT * FROM w2) GROUP BY 1""")
def scenes_meeting_areas(spark: SparkSession, d: str) -> DataFrame:
    """Scene footprints that have a point in common with the table's areas: crossing sides, or one inside the other."""
    boxes = {"SW": (-58.0, 44.0, -53.0, 49.0), "NE": (-52.05, 51.05, -44.95, 58.05), "far": (10.0, 10.0, 11.0, 11.0), "tiny": (-52.001, 51.001, -52.0, 51.002)}
    corners = [(k, 0, i, x, y) for k, (x0, y0, x1, y1) in boxes.items() for i, (x, y) in enumerate(((x0, y0), (x1, y0), (x1, y1), (x0, y1)))]
    scenes = spark.createDataFrame(corners, "poly string, ring int, seq int, x double, y double")
    pairs = polygons.meeting(polygons.edges(rings(spark, d)), polygons.edges(scenes), DEGREES)
    return pairs.groupBy(F.col("b").alias("scene")).agg(F.count_distinct("a").alias("n_areas"), F.min("a").alias("first_area"))


KNOTS = "SELECT o_custkey AS cust, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS t, avg(o_totalprice) / 997.0::DOUBLE AS p, (avg(o_totalprice) - min(o_totalprice)) / 49999.0::DOUBLE - 0.5::DOUBLE AS v FROM orders GROUP BY 1, 2"
SHIPPED = "SELECT o_custkey AS cust, l_orderkey AS ord, l_linenumber AS line, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))::DOUBLE AS t, l_extendedprice / 1009.0::DOUBLE AS p, l_tax AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"""WITH k AS ({KNOTS}), s AS ({SHIPPED}), n AS (SELECT *, lead(t) OVER w AS t1, lead(p) OVER w AS p1, lead(v) OVER w AS v1 FROM k WINDOW w AS (PARTITION BY cust ORDER BY t)),
j AS (SELECT s.cust, s.t, s.p AS sp, s.v AS sv, n.t AS t0, n.p AS p0, n.v AS v0, n.t1, n.p1, n.v1 FROM s ASOF LEFT JOIN n ON s.cust = n.cust AND s.t >= n.t), h AS (SELECT *, t1 - t0 AS h, (t - t0) / (t1 - t0) AS u FROM j),
q AS (SELECT *, CASE WHEN t1 IS NULL AND t = t0 THEN p0 ELSE p0 * (1 + 2 * u) * (1 - u) * (1 - u) + v0 * h * u * (1 - u) * (1 - u) + p1 * u * u * (3 - 2 * u) + v1 * h * u * u * (u - 1) END AS ip,
  CASE WHEN t1 IS NULL AND t = t0 THEN v0 ELSE ((p0 - p1) * 6 * u * (u - 1) + v0 * h * (1 - u) * (1 - 3 * u) + v1 * h * u * (3 * u - 2)) / h END AS iv FROM h)
SELECT cust, count(*) AS n_samples, count(*) FILTER (WHERE ip IS NULL) AS n_uncovered, round(quantile_cont(abs(sp - ip), 0.5), 5) AS p_50, round(quantile_cont(abs(sp - ip), 0.95), 5) AS p_95, round(max(abs(sp - ip)), 5) AS p_100, round(max(abs(sv - iv)), 5) AS v_100 FROM q GROUP BY 1""")
def orbit_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Samples against the cubic through the knots around them: residual percentiles of each track, and what no knots cover."""
    o = t.table(spark, d, "orders")
    day = lambda c: F.datediff(c, F.lit("1992-01-01")).cast("double")
    mean = F.avg("o_totalprice")
    knots = o.groupBy(F.col("o_custkey").alias("cust"), day("o_orderdate").alias("t")).agg((mean / 997.0).alias("p"), ((mean - F.min("o_totalprice")) / 49999.0 - 0.5).alias("v"))
    samples = t.table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    samples = samples.select(F.col("o_custkey").alias("cust"), day("l_shipdate").alias("t"), (F.col("l_extendedprice") / 1009.0).alias("sp"), F.col("l_tax").alias("sv"))
    p, v = brackets.hermite(F.col("t"), F.col("before"), F.col("after"), "p", "v")
    rows = brackets.bracket(samples, knots, "cust", 180.0).withColumn("dp", F.abs(F.col("sp") - p)).withColumn("dv", F.abs(F.col("sv") - v))
    out = rows.groupBy("cust").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("dp").isNull()).alias("n_uncovered"), F.percentile("dp", F.array(F.lit(0.5), F.lit(0.95), F.lit(1.0))).alias("q"), F.max("dv").alias("v"))
    return out.select("cust", "n_samples", "n_uncovered", *(F.round(F.col("q")[i], 5).alias(n) for i, n in enumerate(("p_50", "p_95", "p_100"))), F.round("v", 5).alias("v_100"))


@query(f"""WITH px AS ({t.PIXELS}), w AS (SELECT r AS wr, c AS wc FROM px WHERE hv > -12.5), m AS (SELECT wr, wc, px.r, px.c, hv, hh FROM w JOIN px ON px.r BETWEEN wr - 2 AND wr + 2 AND px.c BETWEEN wc - 2 AND wc + 2)
SELECT wr AS r, wc AS c, md5(string_agg((round(hv * 1000))::BIGINT::VARCHAR, ',' ORDER BY r, c)) AS chip, round(avg(hh), 6) AS mean_hh FROM m GROUP BY 1, 2 HAVING count(*) = 25""")
def chip_cut(spark: SparkSession, d: str) -> DataFrame:
    """A 5 x 5 chip around every bright cell, in row order; chips that leave the grid or meet a missing cell are none."""
    px = cells(spark, d)
    w = cuts.centred(px.where("hv > -12.5").select("g", F.struct("r", "c").alias("id"), "r", "c"), 5)
    rows = cuts.cut(px, w, {"hv": F.col("hv"), "hh": F.col("hh")}, tile=8)
    spelled = F.array_join(F.transform("hv", lambda v: F.round(v * 1000).cast("long").cast("string")), ",")
    mean = F.aggregate("hh", F.lit(0.0), lambda s, v: s + v) / F.size("hh")
    return rows.select("id.r", "id.c", F.md5(spelled).alias("chip"), F.round(mean, 6).alias("mean_hh"))


@query(f"""WITH px AS ({t.PIXELS}), z AS (SELECT r - min(r) OVER () AS r, c, hv FROM px), x AS (SELECT max(r) + 1 AS rows, max(c) + 1 AS cols FROM z),
w AS (SELECT p_partkey AS part, p_size * 7.3::DOUBLE - 20 AS a, p_partkey % 61 - 6.4::DOUBLE AS b, p_size % 5 + 1.5::DOUBLE AS s FROM part), k AS (SELECT part, greatest(floor(a), 0)::INTEGER AS r0, greatest(floor(b), 0)::INTEGER AS c0, least(ceil(a + s), rows)::INTEGER AS r1, least(ceil(b + s), cols)::INTEGER AS c1 FROM w, x),
g AS (SELECT * FROM k WHERE r1 > r0 AND c1 > c0) SELECT part, r0, c0, r1, c1, count(hv) AS n, count(hv) = (r1 - r0) * (c1 - c0) AS complete, round(max(hv), 6) AS peak FROM g JOIN z ON z.r >= r0 AND z.r < r1 AND z.c >= c0 AND z.c < c1 GROUP BY 1, 2, 3, 4, 5""")
def window_copy(spark: SparkSession, d: str) -> DataFrame:
    """Windows with fractional corners, rounded outward, clipped to the grid, and read without resampling."""
    px = cells(spark, d)
    px = px.join(F.broadcast(px.groupBy("g").agg(F.min("r").alias("first"))), "g").select("g", (F.col("r") - F.col("first")).alias("r"), "c", "hv")
    extent = px.groupBy("g").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    a, b, s = F.col("p_size") * 7.3 - 20, F.col("p_partkey") % 61 - 6.4, F.col("p_size") % 5 + 1.5
    w = t.table(spark, d, "part").select(F.lit(0).cast("long").alias("g"), F.col("p_partkey").alias("part"), a.alias("r0"), b.alias("c0"), (a + s).alias("r1"), (b + s).alias("c1"))
    rows = cuts.cut(px, cuts.clipped(w, extent).where("NOT too_large"), {"hv": F.col("hv")}, "part", tile=8, whole=False)
    return rows.select("part", "r0", "c0", "r1", "c1", "n", "complete", F.round(F.array_max("hv"), 6).alias("peak"))


#: The area that footprints are measured in, in degrees; and cells of the index, in equal-area metres.
STUDY = (-58.0, 44.0, -46.0, 58.0)
EQUAL = 300_000.0
E2 = spatial.FLATTENING * (2 - spatial.FLATTENING)
SCALE = spatial.MAJOR_M * math.cos(math.radians(30)) / math.sqrt(1 - E2 * 0.25)


def _equal(lon: str, lat: str) -> tuple[str, str]:
    s = f"sin(radians({lat}))"
    q = f"({1 - E2!r}::DOUBLE * ({s} / (1 - {E2!r}::DOUBLE * {s} * {s}) - ln((1 - {E!r}::DOUBLE * {s}) / (1 + {E!r}::DOUBLE * {s})) / {2 * E!r}::DOUBLE))"
    return f"{SCALE!r}::DOUBLE * radians({lon})", f"{spatial.MAJOR_M ** 2 / (2 * SCALE)!r}::DOUBLE * {q}"


HALF = "(1 + site % 3) * 0.7::DOUBLE"
PRINTS = f"SELECT site, nation, {_equal(f'lon - {HALF}', '0')[0]} AS x0, {_equal('0', f'lat - {HALF}')[1]} AS y0, {_equal(f'lon + {HALF}', '0')[0]} AS x1, {_equal('0', f'lat + {HALF}')[1]} AS y1 FROM p"
CLIPPED = f"a AS (SELECT {_equal(str(STUDY[0]), '0')[0]} AS ax0, {_equal('0', str(STUDY[1]))[1]} AS ay0, {_equal(str(STUDY[2]), '0')[0]} AS ax1, {_equal('0', str(STUDY[3]))[1]} AS ay1)"


def footprints(spark: SparkSession, d: str) -> DataFrame:
    """A box around every site as a ring in equal-area metres."""
    half = (1 + F.col("site") % 3) * 0.7
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    place = [spatial.equal_area(F.col("lon") + a * half, F.col("lat") + b * half) for a, b in corners]
    return t.sites(spark, d).select("site", "nation", F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in place)).alias("ring"))


def study_index(spark: SparkSession) -> DataFrame:
    x0, y0, x1, y1 = STUDY
    x, y = spatial.equal_area(F.col("x"), F.col("y"))
    v = spark.createDataFrame([(0, 0, i, a, b) for i, (a, b) in enumerate(((x0, y0), (x1, y0), (x1, y1), (x0, y1)))], "poly long, ring int, seq int, x double, y double")
    return polygons.index(polygons.edges(v.select("poly", "ring", "seq", x.alias("x"), y.alias("y"))), EQUAL)


@query(f"""WITH p AS ({t.SITES}), f AS ({PRINTS}), {CLIPPED}, k AS (SELECT nation::VARCHAR AS kind, * FROM f UNION ALL SELECT 'all', * FROM f),
z AS (SELECT DISTINCT kind, greatest(x0, ax0) AS x0, greatest(y0, ay0) AS y0, least(x1, ax1) AS x1, least(y1, ay1) AS y1 FROM k, a WHERE x0 < ax1 AND x1 > ax0 AND y0 < ay1 AND y1 > ay0),
c AS (SELECT kind, x0 AS x FROM z UNION SELECT kind, x1 FROM z), s AS (SELECT kind, x AS a, lead(x) OVER (PARTITION BY kind ORDER BY x) AS b FROM c),
i AS (SELECT s.kind, a, b, y0, y1, max(y1) OVER (PARTITION BY s.kind, a ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s JOIN z ON z.kind = s.kind AND z.x0 <= a AND z.x1 >= b WHERE b IS NOT NULL),
u AS (SELECT kind, sum((b - a) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))) / 1e6 AS km2 FROM i GROUP BY 1), n AS (SELECT kind, count(*) AS n_footprints FROM k GROUP BY 1)
SELECT kind, n_footprints, round(coalesce(km2, 0), 2) AS union_km2 FROM n LEFT JOIN u USING (kind)""")
def coverage_areas(spark: SparkSession, d: str) -> DataFrame:
    """Footprints clipped to the study area and united, for each nation and for all: what was acquired, once."""
    f = footprints(spark, d)
    kinds = f.select(F.explode(F.array(F.col("nation").cast("string"), F.lit("all"))).alias("kind"), "ring")
    got = areas.covered(kinds, study_index(spark), EQUAL, "kind")
    n = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n_footprints"))
    return n.join(got, "kind", "left").select("kind", "n_footprints", F.round(F.coalesce(F.col("area") / 1e6, F.lit(0.0)), 2).alias("union_km2"))


@query(f"""WITH p AS ({t.SITES}), f AS ({PRINTS}), {CLIPPED}, o AS (SELECT site, (x1 - x0) * (y1 - y0) AS own, greatest(0, least(x1, ax1) - greatest(x0, ax0)) * greatest(0, least(y1, ay1) - greatest(y0, ay0)) AS part, nation FROM f, a),
i AS (SELECT l_suppkey AS site, l_shipdate, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem),
h AS (SELECT DISTINCT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))
SELECT i.site, l_partkey AS item, round(part / own, 6) AS fraction, CASE WHEN n_nationkey IS NULL THEN 'candidate' ELSE 'held out' END AS status FROM i JOIN o USING (site) LEFT JOIN h ON nation = n_nationkey WHERE k = 1 AND part > 0""")
def catalogue_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue items as first seen over all pages, those that overlap the study area with their fraction; held-out ones are listed, not dropped."""
    pages = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_partkey").alias("item"))
    seen = areas.first_seen(pages, "site", "l_shipdate", "l_orderkey", "l_linenumber")
    f = footprints(spark, d)
    part = areas.covered(f.select("site", "ring"), study_index(spark), EQUAL, "site")
    n, r = t.table(spark, d, "nation"), t.table(spark, d, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    held = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"))
    rows = seen.join(f, "site").join(part, "site").withColumn("fraction", F.round(F.col("area") / areas.ring_area(F.col("ring")), 6))
    free = rows.join(held, "nation", "left_anti").withColumn("status", F.lit("candidate"))
    return free.unionByName(rows.join(held, "nation", "left_semi").withColumn("status", F.lit("held out")).select(*free.columns)).select("site", "item", "fraction", "status")
