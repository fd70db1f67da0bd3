"""Screening and catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import scalars, spatial
from tidegrid.operators import screen
from tidegrid.params import Gates

from . import stand_ins as t
from .catalogue import query

JUDGED = f"""
c AS ({t.CANDIDATES}), judged AS (SELECT *, CASE
  WHEN NOT coalesce(pixel_area >= 4, false) THEN 'min_size' WHEN NOT coalesce(pixel_area <= 45, false) THEN 'max_size'
  WHEN NOT coalesce(length_m / greatest(width_m, 1e-6) <= 8, false) THEN 'aspect_ratio' WHEN NOT coalesce(peak_hv >= -30, false) THEN 'min_peak_hv'
  WHEN NOT coalesce(ratio_db <= 18, false) THEN 'copol_dominance' WHEN NOT coalesce(peak_hv - clutter_db >= 3, false) THEN 'clutter_contrast' END AS first_rejection FROM c)
"""
#: The stand-in's pixel areas end at 50, so the upper size limit is lower than the default.
LIMITS = Gates(max_pixels=45)
RESULTS = f"""
{JUDGED}, s AS ({t.SCENES}), n AS (SELECT scene_id, count(*) AS raw, count(*) FILTER (WHERE first_rejection IS NULL) AS targets FROM judged GROUP BY 1),
results AS (SELECT s.*, coalesce(raw, 0) AS raw, coalesce(targets, 0) AS targets FROM s LEFT JOIN n USING (scene_id))
"""
RATIOS = """stratum, n_scenes, round(area, 1) AS area_km2, targets::BIGINT AS targets, raw_candidates::BIGINT AS raw_candidates, round(CASE WHEN area > 0 THEN 1000.0::DOUBLE * targets / area ELSE 0 END, 3) AS density,
  round(CASE WHEN area > 0 THEN 1000.0::DOUBLE * raw_candidates / area ELSE 0 END, 3) AS raw_density, round(raw_candidates::DOUBLE / greatest(targets, 1), 2) AS suppression"""
SUMS = "count(*) AS n_scenes, sum(area_km2) AS area, sum(targets) AS targets, sum(raw) AS raw_candidates"


def judged(spark: SparkSession, d: str) -> DataFrame:
    return screen.first_rejection(t.candidates(spark, d), LIMITS)


def results(spark: SparkSession, d: str) -> DataFrame:
    return screen.scene_results(judged(spark, d), t.scenes(spark, d))


@query(f"WITH {RESULTS}, g AS (SELECT mode AS stratum, {SUMS} FROM results GROUP BY 1 UNION ALL SELECT 'all', {SUMS} FROM results) SELECT {RATIOS} FROM g")
def density_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return screen.rollup(results(spark, d), "mode")


@query(f"WITH {RESULTS}, x AS (SELECT r.*, region.r_name FROM results r JOIN customer ON site = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), g AS (SELECT r_name AS stratum, {SUMS} FROM x GROUP BY 1 UNION ALL SELECT 'all', {SUMS} FROM x) SELECT {RATIOS} FROM g")
def density_by_region(spark: SparkSession, d: str) -> DataFrame:
    where = t.table(spark, d, "customer").join(t.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return screen.rollup(results(spark, d).join(where.select(F.col("c_custkey").alias("site"), "r_name"), "site"), "r_name")


@query(
    f"""WITH {JUDGED}, o(stage_ord, stage) AS (VALUES (0, 'min_size'), (1, 'max_size'), (2, 'aspect_ratio'), (3, 'min_peak_hv'), (4, 'copol_dominance'), (5, 'clutter_contrast')),
n AS (SELECT stage_ord, stage, (SELECT count(*) FROM judged WHERE first_rejection = stage) AS removed, (SELECT count(*) FROM judged) AS raw FROM o)
SELECT stage_ord, stage, removed, (raw - sum(removed) OVER (ORDER BY stage_ord))::BIGINT AS remaining, round(100.0::DOUBLE * removed / greatest(raw, 1), 2) AS pct_of_raw FROM n"""
)
def suppression_ledger(spark: SparkSession, d: str) -> DataFrame:
    return screen.ledger(judged(spark, d), LIMITS)


@query(f"WITH {JUDGED} SELECT scene_id, target_id, first_rejection FROM judged")
def first_rejection(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("scene_id", "target_id", "first_rejection")


@query(f"WITH {JUDGED}, s AS ({t.SCENES}) SELECT s.scene_id, count(target_id) AS n_candidates, count(target_id) FILTER (WHERE first_rejection IS NULL) AS n_kept FROM s LEFT JOIN judged USING (scene_id) GROUP BY 1")
def scene_detection_counts(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("scene_id", F.col("raw").alias("n_candidates"), F.col("targets").alias("n_kept"))


@query(f"WITH s AS ({t.SCENES}) SELECT scene_id, status, acquired, area_km2 FROM s WHERE status IN ('O', 'P') AND acquired >= TIMESTAMP '1995-06-01' AND acquired <= TIMESTAMP '1997-06-01' ORDER BY acquired DESC, scene_id LIMIT 50 OFFSET 20")
def scene_list_page(spark: SparkSession, d: str) -> DataFrame:
    rows = t.scenes(spark, d).where(F.col("status").isin("O", "P") & F.col("acquired").between(F.lit("1995-06-01").cast("timestamp_ntz"), F.lit("1997-06-01").cast("timestamp_ntz")))
    return screen.page(rows, 50, 20, F.desc("acquired"), F.col("scene_id")).select("scene_id", "status", "acquired", "area_km2")


AOI = " OR ".join(
    f"((lon - {x1}) * ({y2} - {y1}) - (lat - {y1}) * ({x2} - {x1}) = 0 AND lon BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND lat BETWEEN {min(y1, y2)} AND {max(y1, y2)})"
    for (x1, y1), (x2, y2) in zip(spatial.STUDY_AREA, spatial.STUDY_AREA[1:], strict=False)
)
CAST = " + ".join(
    f"CASE WHEN ((lat < {y1}) <> (lat < {y2})) AND lon < {x1} + (lat - {y1}) * ({x2} - {x1}) / ({y2} - {y1}) THEN 1 ELSE 0 END"
    for (x1, y1), (x2, y2) in zip(spatial.STUDY_AREA, spatial.STUDY_AREA[1:], strict=False)
    if y1 != y2
)
#: Doubles, not decimals, in the twins.
INSIDE = f"(({CAST}) % 2 = 1 OR {AOI})"


@query(f"WITH p AS ({t.SITES}) SELECT site, lon, lat, {INSIDE} AS inside FROM p")
def aoi_points(spark: SparkSession, d: str) -> DataFrame:
    p = t.sites(spark, d)
    return p.select("site", "lon", "lat", spatial.covers(F.col("lon"), F.col("lat")).alias("inside"))


@query(f"WITH c AS ({t.CANDIDATES}), p AS ({t.SITES}), s AS ({t.SCENES}) SELECT target_id, c.scene_id, peak_hv, lon, lat FROM c JOIN p ON supp = site JOIN s USING (scene_id) WHERE {INSIDE} AND lon BETWEEN -58 AND -46 AND lat BETWEEN 44 AND 58 AND peak_hv >= -25 AND acquired >= TIMESTAMP '1996-01-01' ORDER BY peak_hv DESC, target_id LIMIT 200 OFFSET 100")
def detection_page(spark: SparkSession, d: str) -> DataFrame:
    p = t.sites(spark, d).where(spatial.covers(F.col("lon"), F.col("lat")) & spatial.in_box(F.col("lon"), F.col("lat"), -58, 44, -46, 58)).withColumnRenamed("site", "supp")
    s = t.scenes(spark, d).where(F.col("acquired") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("scene_id")
    rows = t.candidates(spark, d).where("peak_hv >= -25").join(p, "supp").join(s, "scene_id")
    return screen.page(rows, 200, 100, F.desc("peak_hv"), F.col("target_id")).select("target_id", "scene_id", "peak_hv", "lon", "lat")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) WHERE k = 1")
def latest_review(spark: SparkSession, d: str) -> DataFrame:
    return screen.latest(t.table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")


VERDICTS = ["CONFIRMED_ICEBERG", "VESSEL", "REJECTED_CLUTTER", "SEA_ICE", "SEA_ICE_FEATURE", "UNSURE"]
VERDICT = "CASE length(text) % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(VERDICTS)) + " END"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.element_at(F.array(*map(F.lit, VERDICTS)), F.length("text") % 6 + 1).alias("verdict"))


@query(f"WITH l AS (SELECT conv_id, {VERDICT} AS verdict, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) SELECT conv_id, verdict, CASE verdict WHEN 'CONFIRMED_ICEBERG' THEN 'iceberg' WHEN 'VESSEL' THEN 'ship' WHEN 'REJECTED_CLUTTER' THEN 'clutter' WHEN 'SEA_ICE_FEATURE' THEN 'sea_ice_feature' END AS label FROM l WHERE k = 1 AND verdict NOT IN ('SEA_ICE', 'UNSURE')")
def chip_labels(spark: SparkSession, d: str) -> DataFrame:
    """The latest verdict is chosen first; unknown ones are dropped after that."""
    last = screen.latest(_reviews(spark, d), "conv_id", "turn", "role", "text")
    return last.select("conv_id", "verdict", scalars.mapped(F.col("verdict"), scalars.CHIP).alias("label")).where("label IS NOT NULL")


@query(f"WITH l AS (SELECT conv_id, {VERDICT} AS verdict, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, n AS n_reviews, CASE verdict WHEN 'CONFIRMED_ICEBERG' THEN 'iceberg' WHEN 'VESSEL' THEN 'ship' WHEN 'REJECTED_CLUTTER' THEN 'clutter' WHEN 'SEA_ICE' THEN 'sea_ice_feature' ELSE 'unclassified' END AS display_class FROM l WHERE k = 1")
def review_display(spark: SparkSession, d: str) -> DataFrame:
    rows = _reviews(spark, d).groupBy("conv_id").agg(F.max_by("verdict", F.struct("turn", "role", "text")).alias("verdict"), F.count(F.lit(1)).alias("n_reviews"))
    return rows.select("conv_id", "n_reviews", scalars.mapped(F.col("verdict"), scalars.DISPLAY, "unclassified").alias("display_class"))


@query(f"""WITH c AS ({t.CANDIDATES}), p AS ({t.SITES}) SELECT target_id, '{{"type":"Feature","id":' || target_id || ',"geometry":' || CASE WHEN lon IS NULL THEN 'null' ELSE '{{"type":"Point","site":' || supp || '}}' END || ',"properties":{{"scene_id":' || scene_id || ',"pixel_area":' || pixel_area || ',"confidence_kind":"uncalibrated_detector_score"}}}}' AS feature FROM c LEFT JOIN p ON supp = site""")
def detection_geojson(spark: SparkSession, d: str) -> DataFrame:
    rows = t.candidates(spark, d).join(t.sites(spark, d), F.col("supp") == F.col("site"), "left")
    geometry = F.when(F.col("lon").isNotNull(), F.struct(F.lit("Point").alias("type"), F.col("supp").alias("site")))
    properties = F.struct("scene_id", "pixel_area", F.lit("uncalibrated_detector_score").alias("confidence_kind"))
    return rows.select("target_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("target_id").alias("id"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


@query("SELECT page_id, url FROM pages WHERE NOT upper(url) LIKE '%BLOG%' AND regexp_matches(url, '^https?://[a-z0-9.-]+/')")
def publishable(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "pages").where(~F.upper("url").like("%BLOG%") & F.col("url").rlike("^https?://[a-z0-9.-]+/")).select("page_id", "url")


@query(f"WITH c AS ({t.CANDIDATES}) SELECT target_id, CASE WHEN coalesce(peak_hv >= -24 AND ratio_db <= 15, false) THEN 'iceberg' WHEN coalesce(clutter_db + 25 >= -10 AND ratio_db > 15 AND pixel_area <= 10, false) THEN 'ship' ELSE 'clutter' END AS heuristic_class, round(CASE WHEN coalesce(peak_hv >= -24 AND ratio_db <= 15, false) THEN least(0.95, 0.5 + greatest(0.0, (peak_hv + 24.0) * 0.03)) WHEN coalesce(clutter_db + 25 >= -10 AND ratio_db > 15 AND pixel_area <= 10, false) THEN least(0.9, 0.5 + greatest(0.0, (clutter_db + 25 + 10.0) * 0.03)) ELSE 0.5 END, 8)::DOUBLE AS score FROM c")
def heuristic_class(spark: SparkSession, d: str) -> DataFrame:
    name, score = scalars.heuristic(F.col("peak_hv"), F.col("clutter_db") + 25, F.col("ratio_db"), F.col("pixel_area"))
    return t.candidates(spark, d).select("target_id", name.alias("heuristic_class"), F.round(score, 8).alias("score"))


@query(f"WITH {JUDGED}, w AS (SELECT scene_id, median(CASE WHEN target_id % 3 > 0 THEN clutter_db END) AS wind FROM judged GROUP BY 1), b AS (SELECT quantile_cont(wind, 1.0/3) AS lo, quantile_cont(wind, 2.0/3) AS hi, count(wind) AS n FROM w) SELECT scene_id, round(wind, 6) AS wind, CASE WHEN wind IS NULL OR n < 3 OR lo = hi THEN 'unknown' WHEN wind <= lo THEN 'low' WHEN wind >= hi THEN 'high' ELSE 'moderate' END AS regime FROM w, b")
def wind_terciles(spark: SparkSession, d: str) -> DataFrame:
    w = judged(spark, d).groupBy("scene_id").agg(F.median(F.when(F.col("target_id") % 3 > 0, F.col("clutter_db"))).alias("wind"))
    return screen.terciles(w, "wind").select("scene_id", F.round("wind", 6).alias("wind"), "regime")


@query(f"WITH c AS ({t.CANDIDATES}), f AS (SELECT scene_id, count(*) FILTER (WHERE pixel_area % 13 BETWEEN 2 AND 10) AS ice, count(*) FILTER (WHERE pixel_area % 13 <= 10) AS charted FROM c GROUP BY 1) SELECT scene_id, round(ice::DOUBLE / nullif(charted, 0), 6) AS ice_fraction, CASE WHEN charted = 0 THEN 'unknown' WHEN ice::DOUBLE / charted >= 0.15 THEN 'ice_affected' ELSE 'open_water' END AS regime FROM f")
def ice_regime(spark: SparkSession, d: str) -> DataFrame:
    sic = F.col("pixel_area") % 13
    n = t.candidates(spark, d).groupBy("scene_id").agg(F.count_if(sic.between(2, 10)).alias("ice"), F.count_if(sic <= 10).alias("charted"))
    f = F.col("ice") / F.when(F.col("charted") > 0, F.col("charted"))
    return n.select("scene_id", F.round(f, 6).alias("ice_fraction"), F.when(f.isNull(), "unknown").when(f >= 0.15, "ice_affected").otherwise("open_water").alias("regime"))


@query(f"WITH p AS ({t.SITES}), e AS (SELECT nation, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM p GROUP BY 1) SELECT nation, west, east, south, north FROM e WHERE (west + east) / 2 BETWEEN -54 AND -50 AND (south + north) / 2 BETWEEN 48 AND 55 AND west <= -46 AND east >= -58 AND south <= 58 AND north >= 44")
def extent_prune(spark: SparkSession, d: str) -> DataFrame:
    e = t.sites(spark, d).groupBy("nation").agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    return e.where("(west + east) / 2 BETWEEN -54 AND -50 AND (south + north) / 2 BETWEEN 48 AND 55 AND west <= -46 AND east >= -58 AND south <= 58 AND north >= 44")


@query(f"""WITH p AS ({t.SITES}), x AS (SELECT site, radians(lat) AS p, radians(lon) AS l FROM p), k AS (SELECT {spatial.conic_constants()[0]!r}::DOUBLE AS n, {spatial.conic_constants()[1]!r}::DOUBLE AS f, {spatial.conic_constants()[2]!r}::DOUBLE AS r0, {spatial.conic_constants()[3]!r}::DOUBLE AS e),
y AS (SELECT site, 6378137.0::DOUBLE * f * pow(tan(pi() / 4 - p / 2) / pow((1 - e * sin(p)) / (1 + e * sin(p)), e / 2), n) AS rho, n * (l - radians(-95.0::DOUBLE)) AS theta, r0 FROM x, k) SELECT site, round(rho * sin(theta), 2) AS x_m, round(r0 - rho * cos(theta), 2) AS y_m FROM y""")
def projected_sites(spark: SparkSession, d: str) -> DataFrame:
    x, y = spatial.conic(F.col("lon"), F.col("lat"))
    return t.sites(spark, d).select("site", F.round(x, 2).alias("x_m"), F.round(y, 2).alias("y_m"))
