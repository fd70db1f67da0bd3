"""Queries that check again what is stored, and gate what may be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import audit

from . import stand_ins as t
from .catalogue import query


@query("""WITH now AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN text || '!' ELSE text END AS text, lang, source FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id WHERE n_chars < 15000),
more AS (SELECT doc_id, text, lang, source FROM now UNION ALL SELECT item_id + 1000000000, text, 'xx', 'benchmark' FROM benchmark)
SELECT coalesce(d.doc_id, m.doc_id) AS id, CASE WHEN m.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unrecorded' ELSE 'changed' END AS status FROM documents d FULL JOIN more m ON d.doc_id = m.doc_id WHERE d.doc_id IS NULL OR m.doc_id IS NULL OR d.text <> m.text""")
def publication_audit(spark: SparkSession, d: str) -> DataFrame:
    """All documents hashed again against their receipts: edits, losses and additions found by descent from the roots."""
    docs = t.table(spark, d, "documents")
    fields = [F.col(c) for c in ("text", "lang", "source")]
    toxic = t.table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    now = docs.where("n_chars < 15000").join(toxic, "doc_id", "left").withColumn("text", F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    added = t.table(spark, d, "benchmark").select((F.col("item_id") + 1000000000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("benchmark").alias("source"))
    found = now.select("doc_id", "text", "lang", "source").unionByName(added)
    depth = audit.depth_for(docs.count())
    return audit.audited(audit.receipts(docs, "doc_id", fields), audit.receipts(found, "doc_id", fields), depth)


@query("""WITH w AS (SELECT p_partkey AS part, p_brand, p_size, p_type FROM part), s AS (SELECT DISTINCT p_brand, p_size, p_type FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49) ON l_partkey = p_partkey)
SELECT part, s.p_brand IS NOT NULL AS reused FROM w LEFT JOIN s ON s.p_brand = w.p_brand AND s.p_size = w.p_size AND s.p_type = w.p_type""")
def build_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Builds named by their inputs' digest: those whose inputs were built before are taken from the store."""
    part = t.table(spark, d, "part")
    inputs = [F.col(c) for c in ("p_brand", "p_size", "p_type")]
    built = t.table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    stored = audit.builds(part.join(built, "p_partkey", "left_semi"), spark.createDataFrame([], "build string"), inputs)
    return audit.builds(part, stored, inputs).select(F.col("p_partkey").alias("part"), "reused")


@query("""WITH m AS (SELECT d.doc_id, CASE source WHEN 'forum' THEN 'validation' ELSE CASE lang WHEN 'en' THEN 'train' WHEN 'de' THEN 'test' ELSE 'pool' END END AS part, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id),
n AS (SELECT part, count(*) AS n, count(*) FILTER (WHERE labelled) AS n_labelled FROM m GROUP BY 1 UNION ALL SELECT 'reserve', 0, 0)
SELECT part AS partition, n, n_labelled, CASE WHEN n = 0 THEN 'empty' WHEN part = 'test' THEN 'unreleased' WHEN n_labelled < n THEN 'unlabelled' ELSE 'open' END AS status FROM n""")
def partition_gate(spark: SparkSession, d: str) -> DataFrame:
    """What each partition may be used for: the test part's release is bound to other members, so it stays shut; an empty part is told, not skipped."""
    lang = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "de", "test").otherwise("pool")
    seen = t.table(spark, d, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    m = t.table(spark, d, "documents").withColumn("partition", F.when(F.col("source") == "forum", "validation").otherwise(lang)).join(seen, "doc_id", "left")
    releases = spark.createDataFrame([("test", "0" * 64), ("reserve", "0" * 64)], "partition string, digest string")
    return audit.gated(m.select(F.col("doc_id").alias("id"), "partition", "labelled"), releases, F.coalesce("labelled", F.lit(False))).drop("digest")
