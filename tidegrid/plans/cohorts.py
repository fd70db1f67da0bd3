"""Cohort, matching and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import scalars
from tidegrid.operators import matching, ranks

from . import screening
from . import stand_ins as t
from .catalogue import query

SECONDS = "floor(epoch(ts))::BIGINT"


def _places(spark: SparkSession, d: str, kind: str, name: str) -> DataFrame:
    e = t.table(spark, d, "events").where(F.col("event_type") == kind)
    return e.select(F.col("event_id").alias(name), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_id") * 37 % 1000 * 100.0).alias("x"), (F.col("event_id") * 91 % 1000 * 100.0).alias("y"))


def _place_sql(kind: str) -> str:
    return f"SELECT event_id, {SECONDS} AS t, event_id * 37 % 1000 * 100.0::DOUBLE AS x, event_id * 91 % 1000 * 100.0::DOUBLE AS y FROM events WHERE event_type = '{kind}'"


EDGES = f"l AS ({_place_sql('error')}), r AS ({_place_sql('purchase')}), e AS (SELECT l.event_id AS a, r.event_id AS b, abs(l.t - r.t) AS dt, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) AS distance FROM l JOIN r ON abs(l.t - r.t) <= 10800 AND sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) <= greatest(500, 0.5 * abs(l.t - r.t)))"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return matching.near(_places(spark, d, "error", "a"), _places(spark, d, "purchase", "b"), 10800.0)


@query(f"WITH {EDGES} SELECT a, b, dt, round(distance, 3) AS distance FROM e")
def sighting_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("a", "b", "dt", F.round("distance", 3).alias("distance"))


@query(f"""WITH {EDGES}, n AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM (SELECT DISTINCT a, b FROM e)), o AS (SELECT a, any_value(na) AS candidates, max(CASE WHEN na = 1 AND nb = 1 THEN b END) AS b FROM n GROUP BY 1)
SELECT l.event_id AS a, CASE WHEN b IS NOT NULL THEN 'unique' WHEN candidates IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS status, coalesce(candidates, 0) AS candidates, coalesce(b, -1) AS b FROM l LEFT JOIN o ON l.event_id = o.a""")
def sighting_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched(_places(spark, d, "error", "a"), _places(spark, d, "purchase", "b"), 10800.0).withColumn("b", F.coalesce("b", F.lit(-1)))


@query(f"WITH l AS ({_place_sql('error')}), r AS ({_place_sql('purchase')}), p AS (SELECT l.event_id AS a, r.event_id AS b, abs(l.t - r.t) AS dt, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t), r.t, r.event_id) AS k FROM l JOIN r ON abs(l.t - r.t) <= 1800) SELECT l.event_id AS a, coalesce(b, -1) AS b, coalesce(dt, -1) AS dt FROM l LEFT JOIN p ON p.a = l.event_id AND k = 1")
def nearest_time(spark: SparkSession, d: str) -> DataFrame:
    got = matching.nearest(_places(spark, d, "error", "a").select("a", "t"), _places(spark, d, "purchase", "b").select("b", "t"), 1800)
    return got.select("a", F.coalesce("b", F.lit(-1)).alias("b"), F.coalesce("dt", F.lit(-1)).alias("dt"))


@query(f"""WITH RECURSIVE {EDGES}, x AS (SELECT l.t // 86400 AS day, a, b, distance, row_number() OVER (PARTITION BY l.t // 86400 ORDER BY a, b) AS k FROM e JOIN l ON l.event_id = e.a WHERE distance <= 6000),
s(day, k, used_a, used_b, far) AS (SELECT DISTINCT day, 0::BIGINT, []::BIGINT[], []::BIGINT[], 0.0::DOUBLE FROM x UNION ALL
  SELECT s.day, x.k, CASE WHEN take THEN list_append(used_a, x.a) ELSE used_a END, CASE WHEN take THEN list_append(used_b, x.b) ELSE used_b END, CASE WHEN take THEN far + x.distance ELSE far END
  FROM s JOIN x ON x.day = s.day AND x.k = s.k + 1 CROSS JOIN (VALUES (true), (false)) AS c(take) WHERE NOT take OR NOT (list_contains(used_a, x.a) OR list_contains(used_b, x.b))),
z AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY len(used_a) DESC, far) AS best FROM s), u AS (SELECT day, unnest(used_a) AS a, unnest(used_b) AS b FROM z WHERE best = 1)
SELECT u.day, u.a, u.b, distance FROM u JOIN x ON x.day = u.day AND x.a = u.a AND x.b = u.b""")
def assignment(spark: SparkSession, d: str) -> DataFrame:
    """Most one-to-one pairs, then the least total distance, by day; the twin tries all sets of a day's edges. Events of one time and place are one node with their number."""
    left, right = _places(spark, d, "error", "a"), _places(spark, d, "purchase", "b")
    own = matching.places(left, "a").withColumn("a", F.struct("a.id", "a.n", F.expr("t div 86400").alias("day")))
    e = matching.near(own, matching.places(right, "b"), 10800.0).where("distance <= 6000")
    found = matching.flows(e.select("a.day", F.col("a.id").alias("a"), F.col("a.n").alias("na"), F.col("b.id").alias("b"), F.col("b.n").alias("nb"), "distance"), "day")
    return matching.dealt_out(found, left, right, "day")


@query(f"""WITH RECURSIVE p AS ({t.SITES}), o AS (SELECT site, row_number() OVER (ORDER BY score DESC, site) AS k FROM p),
n AS (SELECT x.site, list(y.site) AS near FROM p x JOIN p y ON x.site <> y.site AND sqrt(power(x.lon - y.lon, 2) + power(x.lat - y.lat, 2)) <= 0.5 GROUP BY 1),
g(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN list_has_any(g.kept, coalesce(n.near, []::BIGINT[])) THEN g.kept ELSE list_append(g.kept, o.site) END FROM g JOIN o ON o.k = g.k + 1 LEFT JOIN n ON n.site = o.site)
SELECT unnest(kept) AS site FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1)""")
def nms(spark: SparkSession, d: str) -> DataFrame:
    """Sites kept by score where none kept is within half a degree; tests hold it against a plain loop."""
    s = t.sites(spark, d).select(F.col("site").alias("id"), "score", "lon", "lat")
    cell = s.withColumn("kx", F.floor(F.col("lon") * 2)).withColumn("ky", F.floor(F.col("lat") * 2))
    around = F.explode(F.array(*(F.struct((F.col("kx") + i).alias("kx"), (F.col("ky") + j).alias("ky")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    other = cell.select(F.col("id").alias("b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"), around.alias("k")).select("b", "lon_b", "lat_b", "k.*")
    pairs = cell.join(other, ["kx", "ky"]).where((F.col("id") < F.col("b")) & (F.hypot(F.col("lon") - F.col("lon_b"), F.col("lat") - F.col("lat_b")) <= 0.5))
    return matching.suppress(s.select("id", "score"), pairs.select(F.col("id").alias("a"), "b")).withColumnRenamed("id", "site")


SCENE_LINKS = """rec AS (SELECT o_orderkey AS id, o_custkey AS site, epoch(o_orderdate)::BIGINT AS t, o_orderstatus AS status FROM orders)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("site"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("t"), F.col("o_orderstatus").alias("status"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Records of one site that are within 120 days are linked, and so what they link to: links in time order are a chain, so groups are islands between longer gaps."""
    order = Window.partitionBy("site").orderBy("t", "id")
    late = F.coalesce(F.col("t") - F.lag("t").over(order) > 10368000, F.lit(True))
    runs = _records(spark, d).withColumn("late", late.cast("int")).withColumn("run", F.sum("late").over(order))
    return runs.select("id", "site", "t", "status", F.min("id").over(Window.partitionBy("site", "run")).alias("group_id"))


GROUPS = f"{SCENE_LINKS}, tu AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY site ORDER BY t, id) <= 10368000 THEN 0 ELSE 1 END AS turn FROM rec), ru AS (SELECT *, sum(turn) OVER (PARTITION BY site ORDER BY t, id) AS run FROM tu), gr AS (SELECT id, site, t, min(id) OVER (PARTITION BY site, run) AS group_id FROM ru)"


@query(f"WITH {GROUPS} SELECT id, group_id FROM gr")
def cohort_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select("id", "group_id")


@query(f"""WITH {GROUPS}, g AS (SELECT group_id, bool_and(o_orderstatus <> 'F') AS clean, sha256('17|' || group_id) AS rank, list(DISTINCT o_orderpriority) AS families FROM gr JOIN orders ON id = o_orderkey GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY rank) AS n, count(*) OVER (PARTITION BY clean) AS m FROM g), le AS (SELECT min(rank) AS rank FROM (SELECT rank, unnest(families) AS f FROM g WHERE clean) GROUP BY f),
te AS (SELECT group_id, rank, clean AND (n <= greatest(1, ceil(m * 0.2)) OR rank IN (SELECT rank FROM le)) AS test FROM k),
v AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY rank) AS n, count(*) OVER (PARTITION BY test) AS m FROM te)
SELECT group_id, CASE WHEN test THEN 'test' WHEN n <= least(m - 1, ceil(m * 0.15)) THEN 'validation' ELSE 'train' END AS partition FROM v""")
def partition_assign(spark: SparkSession, d: str) -> DataFrame:
    """Groups by hash rank: the first clean ones test, with one of each family; then validation; the rest train."""
    family = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    g = _groups(spark, d).join(family, "id").groupBy("group_id").agg(F.bool_and(F.col("status") != "F").alias("clean"), F.collect_set("o_orderpriority").alias("families"))
    return ranks.partitions(g.withColumn("digest", scalars.hashed(F.lit("17"), F.col("group_id"))), 0.2, 0.15).select("group_id", "partition")


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id, string_agg(DISTINCT source, ',' ORDER BY source) AS aliases, count(DISTINCT lang) > 1 AS conflict FROM documents GROUP BY 1")
def inventory_merge(spark: SparkSession, d: str) -> DataFrame:
    """Records of one content with the union of their aliases, and whether they contradict each other."""
    g = t.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("aliases"), (F.countDistinct("lang") > 1).alias("conflict"))


@query(f"WITH {SCENE_LINKS} SELECT DISTINCT r.id FROM rec r JOIN rec h ON h.status = 'P' AND r.status <> 'P' AND r.site = h.site AND abs(r.t - h.t) <= 604800")
def holdout_guard(spark: SparkSession, d: str) -> DataFrame:
    """Records of a site within 7 days of a held-out one (those of status P)."""
    r = _records(spark, d)
    held = r.where("status = 'P'").select("site", F.explode(F.array(*(F.floor(F.col("t") / 604800) + k for k in (-1, 0, 1)))).alias("week"), F.col("t").alias("th"))
    rest = r.where("status <> 'P'").withColumn("week", F.floor(F.col("t") / 604800))
    near = (F.abs(rest["t"] - held["th"]) <= 604800) & (rest["site"] == held["site"]) & (rest["week"] == held["week"])
    return rest.join(held, near, "left_semi").select("id")


STRATA = f"{screening.JUDGED}, st AS (SELECT target_id, concat_ws('|', supp % 10, coalesce(first_rejection, 'retained'), CASE WHEN pixel_area <= 3 THEN pixel_area::VARCHAR WHEN pixel_area < 16 THEN '4-15' ELSE '16+' END, CASE WHEN peak_hv < -28 THEN 'low' WHEN peak_hv < -22 THEN 'mid' ELSE 'high' END) AS stratum, coalesce(first_rejection, 'retained') AS stage FROM judged)"


@query(f"""WITH {STRATA}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('17|' || stratum || '|' || target_id), target_id) AS n, count(*) OVER (PARTITION BY stratum) AS population FROM st),
b AS (SELECT *, CASE stage WHEN 'retained' THEN population WHEN 'min_size' THEN least(20, population) ELSE least(8, population) END AS chosen FROM k)
SELECT target_id, stratum, population, chosen, round(chosen::DOUBLE / population, 8) AS probability FROM b WHERE n <= chosen""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A census of what was kept and hash-ranked draws of what wasn't, with inclusion probabilities."""
    j = screening.judged(spark, d).withColumn("stage", F.coalesce("first_rejection", F.lit("retained")))
    s = j.withColumn("stratum", scalars.stratum_key(F.col("supp") % 10, F.col("stage"), F.col("pixel_area"), F.col("peak_hv"), (-28.0, -22.0)))
    chosen = F.when(F.col("stage") == "retained", F.col("population")).when(F.col("stage") == "min_size", F.least(F.lit(20), F.col("population"))).otherwise(F.least(F.lit(8), F.col("population")))
    s = s.withColumn("digest", scalars.hashed(F.lit("17"), F.col("stratum"), F.col("target_id")))
    rows = ranks.first_ranked(s, "digest", ("stratum",), chosen, ("target_id",)).withColumn("chosen", chosen)
    return rows.select("target_id", "stratum", "population", "chosen", F.round(F.col("chosen") / F.col("population"), 8).alias("probability"))


@query(f"WITH {STRATA}, n AS (SELECT stratum, any_value(stage) AS stage, count(*) AS population, count(*) FILTER (WHERE target_id % 3 = 0) AS targets, count(*) FILTER (WHERE target_id % 3 = 1) AS uncertain FROM st GROUP BY 1), w AS (SELECT *, CASE stage WHEN 'retained' THEN population WHEN 'min_size' THEN least(20, population) ELSE least(8, population) END AS chosen FROM n) SELECT stratum, population, chosen, CASE WHEN targets > 0 THEN round(targets * population::DOUBLE / chosen, 4) END AS lower, CASE WHEN targets > 0 THEN round((targets + uncertain) * population::DOUBLE / chosen, 4) END AS upper FROM w")
def weighted_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Weighted counts of a stratum: certain ones, and with the uncertain; null where nothing was answered."""
    j = screening.judged(spark, d).withColumn("stage", F.coalesce("first_rejection", F.lit("retained")))
    s = j.withColumn("stratum", scalars.stratum_key(F.col("supp") % 10, F.col("stage"), F.col("pixel_area"), F.col("peak_hv"), (-28.0, -22.0)))
    n = s.groupBy("stratum", "stage").agg(F.count(F.lit(1)).alias("population"), F.count_if(F.col("target_id") % 3 == 0).alias("targets"), F.count_if(F.col("target_id") % 3 == 1).alias("uncertain"))
    chosen = F.when(F.col("stage") == "retained", F.col("population")).when(F.col("stage") == "min_size", F.least(F.lit(20), F.col("population"))).otherwise(F.least(F.lit(8), F.col("population")))
    n = n.withColumn("chosen", chosen)
    value = lambda c: F.when(F.col("targets") > 0, F.round(c * F.col("population") / F.col("chosen"), 4))
    return n.select("stratum", "population", "chosen", value(F.col("targets")).alias("lower"), value(F.col("targets") + F.col("uncertain")).alias("upper"))


@query("WITH s AS (SELECT DISTINCT o_custkey AS scene FROM orders), k AS (SELECT scene, row_number() OVER (ORDER BY scene) AS n, count(*) OVER () AS m FROM s) SELECT scene, CASE WHEN n > m - greatest(1, ceil(m * 0.2)) THEN 'val' ELSE 'train' END AS split FROM k")
def split_by_scene(spark: SparkSession, d: str) -> DataFrame:
    """The last fifth of sorted scenes validates. Where the cut is comes from ranks of ranges, not from one sorted task."""
    s = t.table(spark, d, "orders").select(F.col("o_custkey").alias("scene")).distinct()
    cells = s.withColumn("cell", F.floor(F.col("scene") / 1000))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("cell", (F.sum("size").over(Window.orderBy("cell")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("m"))
    ranked = cells.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("scene"))).join(before, "cell")
    cut = F.col("m") - F.greatest(F.lit(1), F.ceil(F.col("m") * F.lit(0.2).cast("decimal(3,1)")))
    return ranked.select("scene", F.when(F.col("before") + F.col("k") > cut, "val").otherwise("train").alias("split"))


@query("WITH c AS (SELECT doc_id, source, sha256(text) AS sha, n_chars FROM documents) SELECT a.source, count(*) AS n, count(*) FILTER (WHERE b.doc_id IS NOT NULL) AS shared FROM c a LEFT JOIN (SELECT DISTINCT sha, min(doc_id) AS doc_id FROM c GROUP BY sha) b ON a.sha = b.sha AND a.doc_id > b.doc_id GROUP BY 1")
def content_identity(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    first = c.groupBy("sha").agg(F.min("doc_id").alias("first"))
    return c.join(first, "sha").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id") > F.col("first")).alias("shared"))


@query(f"""WITH p AS ({t.SITES}), c AS (SELECT nation, avg(lon) AS lon0, avg(lat) AS lat0 FROM p GROUP BY 1), x AS (SELECT nation, site, 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2))) AS m FROM p JOIN c USING (nation)),
k AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY m, site) AS place, count(*) OVER (PARTITION BY nation) AS total FROM x) SELECT nation, site, place, total, round(m, 2) AS metres FROM k WHERE place <= 3""")
def location_items(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest items of each location, and how many there were."""
    from tidegrid.functions.spatial import haversine

    p = t.sites(spark, d)
    c = p.groupBy("nation").agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))
    x = p.join(c, "nation").withColumn("m", haversine(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")))
    return matching.top_items(x, "nation", 3, "m", "site").select("nation", "site", "place", "total", F.round("m", 2).alias("metres"))


@query("WITH l AS (SELECT l_suppkey AS loc, l_returnflag AS mode, bool_or(l_quantity >= 49) AS useful, bool_or(l_discount >= 0.09) AS context FROM lineitem GROUP BY ALL), a AS (SELECT mode, count(*) AS locations, count(*) FILTER (WHERE useful) AS useful, count(*) FILTER (WHERE context) AS context FROM l GROUP BY 1 UNION ALL SELECT 'combined', count(*), count(*) FILTER (WHERE u), count(*) FILTER (WHERE c) FROM (SELECT loc, bool_or(useful) AS u, bool_or(context) AS c FROM l GROUP BY 1)) SELECT * FROM a")
def strict_screen_rollup(spark: SparkSession, d: str) -> DataFrame:
    l = t.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("loc"), F.col("l_returnflag").alias("mode")).agg(F.bool_or(F.col("l_quantity") >= 49).alias("useful"), F.bool_or(F.col("l_discount") >= 0.09).alias("context"))
    both = l.groupBy("loc").agg(F.bool_or("useful").alias("useful"), F.bool_or("context").alias("context")).withColumn("mode", F.lit("combined"))
    return l.select("mode", "useful", "context").unionByName(both.select("mode", "useful", "context")).groupBy("mode").agg(F.count(F.lit(1)).alias("locations"), F.count_if("useful").alias("useful"), F.count_if("context").alias("context"))
