"""Mixing sources to target weights, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import core

#: Weights of the sources in their order, repeating; the mix's share of all sizes; the most copies of a source.
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"


def word_count(text: str = "text") -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, weigh `weights`, repeating. Targets share `share` of all sizes by weight, stop at
    `most` times their source's size, and the excess is shared again until none is above. That end is one level
    for all open sources: with the caps ascending by cap / weight, the first k are capped for the smallest
    k at which the next cap isn't below the level. Sources of size 0 have target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % n + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "gone": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "all_size": F.sum("source_size").over(every),
        "all_w": F.sum("w").over(every),
    })
    level = (F.col("all_size") * F.lit(float(share)) - F.col("capped")) / (F.col("all_w") - F.col("gone"))
    # the level once all with a smaller ratio are capped; the first source whose cap isn't below it sets the level of the rest
    rows = rows.withColumn("level", F.when(level <= F.col("cap") / F.col("w"), level))
    rows = rows.withColumn("level", F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """docs with _size (words), _source_size, _target and _copies: how often the mix takes each row.

    docs needs doc_id, text and source. Null texts have size 0; a null source is a source; nulls are hashed as the text
    'null'; repeated rows are rows of their own, with the same draw; rows of one doc_id with other texts have other draws. An empty table gives an empty result.
    Sizes are summed before the shuffle, and sources come back as a small table, so a hot source is never gathered.
    """
    # the draw is made before the join, so that a text that nobody asks for isn't shuffled for it
    sized = docs.withColumn("_size", word_count()).withColumn("_draw", _draw(seed))
    per_source = targets(sized.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, most)
    t = per_source.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    rows = sized.join(t, sized["source"].eqNullSafe(t["_s"]), "left").drop("_s")
    return rows.withColumn("_copies", _copies()).drop("_draw")


def _draw(seed: str) -> Column:
    """A number from 0 to 1 by a hash of the seed, doc_id, source and text."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "source", "text")]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *own).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _copies() -> Column:
    """floor(target / source size), and one more with the rest's probability by the draw."""
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(F.col("_draw") < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix: rows of docs, each as often as the plan takes it."""
    planned = plan(docs, weights, share, most, seed).where("_copies > 0")
    return planned.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(docs).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
    sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w FROM w
), l AS (
  SELECT min((all_size * 1.5::DOUBLE - capped) / (all_w - gone)) AS level FROM o WHERE (all_size * 1.5::DOUBLE - capped) / (all_w - gone) <= cap / w
    AND cap / w = (SELECT min(cap / w) FROM o WHERE (all_size * 1.5::DOUBLE - capped) / (all_w - gone) <= cap / w)
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM o, l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || coalesce(d.source, 'null') || '|' || coalesce(d.text, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
