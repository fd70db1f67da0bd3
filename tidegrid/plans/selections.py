"""Selections, bindings and derivations: chips, windows, preferences, pass flags, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import scalars
from tidegrid.operators import grid, screen, tiles

from . import grids
from . import stand_ins as t
from .catalogue import query


@query(f"""WITH {grids.DENSE}, ch AS (SELECT CAST(floor(r / 8.0) AS INTEGER) AS i, CAST(floor(c / 8.0) AS INTEGER) AS j, count(power) AS known, count(*) AS cells, count(*) FILTER (WHERE (r + c) % 13 <= 10) AS charted FROM dense GROUP BY 1, 2),
e AS (SELECT *, sha256('5|' || i || '|' || j) AS rank FROM ch WHERE cells = 64 AND known >= 48), k AS (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM e) SELECT i, j, known, charted FROM k WHERE n <= 60""")
def chip_selection(spark: SparkSession, d: str) -> DataFrame:
    """Whole chips with enough known cells, by hash rank, up to a cap for each scene."""
    rows = grid.prepared(grid.densify(grids.cells(spark, d)), grids.P)
    chips = rows.groupBy("g", F.floor(F.col("r") / 8).cast("int").alias("i"), F.floor(F.col("c") / 8).cast("int").alias("j"))
    e = chips.agg(F.count("power").alias("known"), F.count(F.lit(1)).alias("cells"), F.count_if((F.col("r") + F.col("c")) % 13 <= 10).alias("charted")).where("cells = 64 AND known >= 48")
    n = F.row_number().over(Window.partitionBy("g").orderBy(scalars.hashed(F.lit(5), F.col("i"), F.col("j"))))
    return e.withColumn("n", n).where("n <= 60").select("i", "j", "known", "charted")


@query(f"WITH px AS ({t.PIXELS}) SELECT r, c, round((greatest(-60, least(10, hv)) + 25.5) / 10, 6) AS hv_in, CASE WHEN ((r + c) % 13 + 13) % 13 <= 1 THEN 0 WHEN ((r + c) % 13 + 13) % 13 <= 10 THEN 1 ELSE 255 END AS label FROM px")
def model_input(spark: SparkSession, d: str) -> DataFrame:
    """Clipped and scaled bands, and chart classes as labels."""
    k = F.pmod(F.col("r") + F.col("c"), F.lit(13))
    clipped = F.greatest(F.lit(-60.0), F.least(F.lit(10.0), F.col("hv")))
    return grids.cells(spark, d).select("r", "c", F.round((clipped + 25.5) / 10, 6).alias("hv_in"), F.when(k <= 1, 0).when(k <= 10, 1).otherwise(255).alias("label"))


@query("WITH o AS (SELECT o_custkey AS acquisition, o_orderkey AS id, o_orderstatus = 'O' AS online, o_orderkey % 7 AS baseline FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY acquisition ORDER BY online DESC, baseline DESC, id) AS n FROM o) SELECT acquisition, id, online, baseline FROM k WHERE n = 1")
def product_preference(spark: SparkSession, d: str) -> DataFrame:
    """Of an acquisition's products: online before offline, then the highest baseline, then the name. An aggregation, not a sort."""
    o = t.table(spark, d, "orders").select(F.col("o_custkey").alias("acquisition"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "O").alias("online"), (F.col("o_orderkey") % 7).alias("baseline"))
    best = o.groupBy("acquisition").agg(F.max(F.struct("online", "baseline", (-F.col("id")).alias("name"))).alias("m"))
    return best.select("acquisition", (-F.col("m.name")).alias("id"), "m.online", "m.baseline")


@query("""WITH c AS (SELECT l_orderkey AS product, CASE l_linenumber % 3 WHEN 0 THEN 'p95' WHEN 1 THEN 'sign' ELSE 'shift' END AS name, l_discount AS a, l_tax AS b, l_quantity AS n, l_returnflag <> 'R' AS stated FROM lineitem),
v AS (SELECT *, CASE name WHEN 'p95' THEN a <= 0.08 WHEN 'sign' THEN b <= 0.06 ELSE sqrt(a * a + b * b) * 100 <= 9 END AS own FROM c) SELECT product, bool_and(own) AS passed, count(*) FILTER (WHERE own <> stated) AS contradicted FROM v GROUP BY 1""")
def pass_flags(spark: SparkSession, d: str) -> DataFrame:
    """Checks recomputed from their figures against what was stated."""
    li = t.table(spark, d, "lineitem")
    k, a, b = F.col("l_linenumber") % 3, F.col("l_discount"), F.col("l_tax")
    own = F.when(k == 0, a <= 0.08).when(k == 1, b <= 0.06).otherwise(F.sqrt(a * a + b * b) * 100 <= 9)
    rows = li.select(F.col("l_orderkey").alias("product"), own.alias("own"), (F.col("l_returnflag") != "R").alias("stated"))
    return rows.groupBy("product").agg(F.bool_and("own").alias("passed"), F.count_if(F.col("own") != F.col("stated")).alias("contradicted"))


@query("""WITH r AS (SELECT doc_id, source, lang, substr(sha256(source || '|' || lang || '|' || length(text) % 40), 1, 3) AS key FROM documents), b AS (SELECT l.doc_id, substr(sha256(source || '|' || lang || '|' || length(text) % 47), 1, 3) AS key FROM labels l JOIN documents USING (doc_id)),
c AS (SELECT key, count(DISTINCT (source, lang)) AS n, min(doc_id) AS first_id FROM r GROUP BY 1) SELECT b.doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN n = 1 THEN first_id ELSE -1 END AS recipe FROM b LEFT JOIN c USING (key)""")
def recipe_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Results name their recipe by a short digest, which must find exactly one configuration: none is missing, several are ambiguous."""
    docs = t.table(spark, d, "documents")
    key = lambda m: F.substring(F.sha2(F.concat_ws("|", "source", "lang", (F.length("text") % m).cast("string")), 256), 1, 3).alias("key")
    stored = docs.select("doc_id", "source", "lang", key(40)).groupBy("key").agg(F.count_distinct("source", "lang").alias("n"), F.min("doc_id").alias("first_id"))
    results = t.table(spark, d, "labels").select("doc_id").join(docs, "doc_id").select("doc_id", key(47))
    rows = results.join(stored, "key", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return rows.select("doc_id", status.alias("status"), F.when(F.col("n") == 1, F.col("first_id")).otherwise(-1).alias("recipe"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role) AS history FROM conversations GROUP BY 1 ORDER BY max(turn) DESC, conv_id LIMIT 100")
def pair_listing(spark: SparkSession, d: str) -> DataFrame:
    """The hundred longest histories, each in order."""
    g = t.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("h"))
    rows = g.select("conv_id", "turns", "last", F.array_join(F.transform("h", lambda x: x["role"]), ">").alias("history"))
    return screen.page(rows, 100, 0, F.desc("last"), F.col("conv_id")).drop("last")


@query("WITH v AS (SELECT user_id, event_id, event_type, ts, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id) AS last FROM events), u AS (SELECT * FROM v WHERE event_type = 'purchase' AND ts < last) SELECT user_id, count(*) AS too_early, strftime(max(last) + INTERVAL 7 DAY, '%Y-%m-%d') AS not_before FROM u GROUP BY 1")
def survey_order(spark: SparkSession, d: str) -> DataFrame:
    """Candidate reviews before a reviewer's last survey, and when a repeat is due. The last survey is joined, not windowed."""
    e = t.table(spark, d, "events")
    last = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("last"))
    u = e.where("event_type = 'purchase'").join(last, "user_id").where("ts < last").groupBy("user_id")
    return u.agg(F.count(F.lit(1)).alias("too_early"), F.date_format(F.max("last") + F.expr("INTERVAL 7 DAY"), "yyyy-MM-dd").alias("not_before"))


@query("WITH k AS (SELECT unnest(range(0, 5)) AS i), g AS (SELECT a.i AS i, b.i AS j, (a.i * 5 + b.i) AS n FROM k a, k b) SELECT i, j, round(-60.5 + (i + 0.5) * 3.3, 4)::DOUBLE AS lon, round(42.5 + (j + 0.5) * 3.6, 4)::DOUBLE AS lat, CASE WHEN n % 7 = 0 THEN 'land' WHEN n % 5 = 0 THEN 'incidence' ELSE 'kept' END AS reason FROM g")
def review_lattice(spark: SparkSession, d: str) -> DataFrame:
    """A fixed 5 x 5 lattice of review locations with the first reason against each."""
    n = F.col("i") * 5 + F.col("j")
    rows = spark.range(25).select(F.floor(F.col("id") / 5).alias("i"), (F.col("id") % 5).alias("j"))
    reason = F.when(n % 7 == 0, "land").when(n % 5 == 0, "incidence").otherwise("kept")
    return rows.select("i", "j", F.round(-60.5 + (F.col("i") + 0.5) * 3.3, 4).alias("lon"), F.round(42.5 + (F.col("j") + 0.5) * 3.6, 4).alias("lat"), reason.alias("reason"))


@query("WITH b AS (SELECT p_size AS h, (p_partkey % 40 + 5)::INTEGER AS w, p_partkey AS k FROM part), f(a) AS (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) SELECT k, a, round_even((h + 20 - 5) * a, 0)::INTEGER AS r0, round_even((w + 20 - 5) * a, 0)::INTEGER AS c0 FROM b, f")
def sampling_windows(spark: SparkSession, d: str) -> DataFrame:
    """Origins of fixed windows, rounded half to even."""
    b = t.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("h"), (F.col("p_partkey") % 40 + 5).cast("int").alias("w"))
    rows = b.withColumn("a", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))))
    return rows.select("k", "a", F.bround((F.col("h") + 15) * F.col("a"), 0).cast("int").alias("r0"), F.bround((F.col("w") + 15) * F.col("a"), 0).cast("int").alias("c0"))


@query(f"""WITH px AS ({t.PIXELS}), bx AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM px), k AS (SELECT r, c, (r - r0)::DOUBLE / (r1 - r0) * 4 AS y, (c - c0)::DOUBLE / (c1 - c0) * 4 AS x FROM px, bx), f AS (SELECT *, least(3, floor(y)) AS i, least(3, floor(x)) AS j FROM k),
v AS (SELECT r, c, 42.5::DOUBLE + i * 4 + j AS a, 42.5::DOUBLE + i * 4 + j + 1 AS b, 42.5::DOUBLE + (i + 1) * 4 + j AS d, 42.5::DOUBLE + (i + 1) * 4 + j + 1 AS e, y - i AS fy, x - j AS fx FROM f)
SELECT r, c, round((a * (1 - fx) + b * fx) * (1 - fy) + (d * (1 - fx) + e * fx) * fy, 6) AS lat FROM v""")
def tie_points(spark: SparkSession, d: str) -> DataFrame:
    """A 5 x 5 grid of tie points expanded to all cells; the last cell of each axis is the last tie point."""
    knots = spark.range(25).select(F.floor(F.col("id") / 5).cast("int").alias("i"), (F.col("id") % 5).cast("int").alias("j")).withColumn("v", 42.5 + F.col("i") * 4 + F.col("j"))
    px = grids.cells(spark, d)
    px = px.join(F.broadcast(px.groupBy("g").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))), "g")
    px = px.withColumn("y", (F.col("r") - F.col("r0")) / (F.col("r1") - F.col("r0")) * 4).withColumn("x", (F.col("c") - F.col("c0")) / (F.col("c1") - F.col("c0")) * 4)
    px = px.withColumn("i", F.least(F.lit(3), F.floor("y")).cast("int")).withColumn("j", F.least(F.lit(3), F.floor("x")).cast("int"))
    for name, a, b in (("v00", 0, 0), ("v01", 0, 1), ("v10", 1, 0), ("v11", 1, 1)):
        px = px.join(F.broadcast(knots.select((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.col("v").alias(name))), ["i", "j"])
    fy, fx = F.col("y") - F.col("i"), F.col("x") - F.col("j")
    value = (F.col("v00") * (1 - fx) + F.col("v01") * fx) * (1 - fy) + (F.col("v10") * (1 - fx) + F.col("v11") * fx) * fy
    return px.select("r", "c", F.round(value, 6).alias("lat"))


@query(f"WITH p AS ({t.SITES}) SELECT nation, floor(min(lon) * 10)::BIGINT - 2 AS col0, ceil(max(lon) * 10)::BIGINT + 2 AS col1, floor(min(lat) * 10)::BIGINT - 2 AS row0, ceil(max(lat) * 10)::BIGINT + 2 AS row1 FROM p GROUP BY 1")
def output_grid(spark: SparkSession, d: str) -> DataFrame:
    """Extents snapped outwards to a grid's phase, with a margin."""
    g = t.sites(spark, d).groupBy("nation")
    return g.agg((F.floor(F.min("lon") * 10) - 2).alias("col0"), (F.ceil(F.max("lon") * 10) + 2).alias("col1"), (F.floor(F.min("lat") * 10) - 2).alias("row0"), (F.ceil(F.max("lat") * 10) + 2).alias("row1"))


@query(f"WITH {grids.TRAINED}, th AS (SELECT *, greatest(n, 8) * (pow(0.25::DOUBLE, -1.0 / greatest(n, 8)) - 1) * s / greatest(n, 8) AS threshold FROM tr), h AS (SELECT CAST(floor(r / 32.0) AS INTEGER) AS tile, count(*) FILTER (WHERE power > threshold AND n >= {grids.P.needed(8)}) AS hits, count(*) FILTER (WHERE power IS NOT NULL AND n >= {grids.P.needed(8)}) AS eligible FROM th GROUP BY 1) SELECT tile, hits, eligible, round(eligible * 0.0064, 4)::DOUBLE AS area_km2 FROM h")
def frame_summary(spark: SparkSession, d: str) -> DataFrame:
    """Hits, eligible cells and their area by stripe of a frame."""
    rows = grid.cell_averaging(tiles.training(grids.cells(spark, d), grids.P), grids.P)
    s = rows.groupBy(F.floor(F.col("r") / 32).cast("int").alias("tile")).agg(F.count_if("hit").alias("hits"), F.count_if("analysed").alias("eligible"))
    return s.select("tile", "hits", "eligible", F.round(F.col("eligible") * 0.0064, 4).alias("area_km2"))
