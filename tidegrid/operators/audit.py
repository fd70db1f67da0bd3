"""Audits of everything stored: digests rolled up by levels, so that what changed is found by descent; builds and gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records of one leaf bucket, about; and the levels' fan-out, a hexadecimal digit.
BUCKET = 256


def depth_for(records: int) -> int:
    """Levels below the root so that a bucket holds BUCKET records about."""
    return max(0, math.ceil(math.log(max(1, records / BUCKET), 16)))


def receipts(rows: DataFrame, ident: str, fields: list[Column]) -> DataFrame:
    """(id, place, digest): a digest of each row's fields with their lengths, nulls told apart, and a place by the id's hash."""
    text = [f.cast("string") for f in fields]
    body = F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text))
    return rows.select(F.col(ident).alias("id"), F.sha2(F.col(ident).cast("string"), 256).alias("place"), F.sha2(body, 256).alias("digest"))


def rolled(records: DataFrame, depth: int) -> DataFrame:
    """(level, bucket, digest, n) of receipts: every bucket's digest is that of its sorted children's, from the leaves' buckets to the root.

    A level is one aggregation of the level below, so the rows of one bucket are few at each, and no task sees all.
    """
    line = F.concat("id", F.lit("="), "digest") if dict(records.dtypes)["id"] == "string" else F.concat(F.col("id").cast("string"), F.lit("="), "digest")
    low = records.groupBy(F.substring("place", 1, depth).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    out = low.select(F.lit(depth).alias("level"), "bucket", "digest", "n")
    for level in range(depth - 1, -1, -1):
        up = low.groupBy(F.substring("bucket", 1, level).alias("bucket"))
        low = up.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", F.lit("="), "digest"))), "\n"), 256).alias("digest"), F.sum("n").alias("n"))
        out = out.unionByName(low.select(F.lit(level).alias("level"), "bucket", "digest", "n"))
    return out


def differing(stored: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """(bucket) of the lowest level whose digests differ, or that one side lacks, by descent: only children of differing buckets are compared."""
    at = None
    for level in range(depth + 1):
        s, f = (x.where(F.col("level") == level).select("bucket", F.col("digest").alias(n)) for x, n in ((stored, "_s"), (found, "_f")))
        if at is not None:
            above = at.withColumnRenamed("bucket", "_up")
            s, f = (x.withColumn("_up", F.substring("bucket", 1, level - 1)).join(above, "_up", "left_semi").drop("_up") for x in (s, f))
        at = s.join(f, "bucket", "full").where(~F.col("_s").eqNullSafe(F.col("_f"))).select("bucket")
    return at


def audited(stored: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """(id, status) of receipts that don't agree: `changed`, `missing` (stored alone) or `unrecorded` (found alone).

    Records of buckets whose rolled-up digests agree are never compared. Repeated ids are compared by all their digests.
    """
    bad = differing(rolled(stored, depth), rolled(found, depth), depth)
    own = lambda x, n: x.withColumn("bucket", F.substring("place", 1, depth)).join(bad, "bucket", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("digest")).alias(n))
    rows = own(stored, "_s").join(own(found, "_f"), "id", "full").where(~F.col("_s").eqNullSafe(F.col("_f")))
    return rows.select("id", F.when(F.col("_f").isNull(), "missing").when(F.col("_s").isNull(), "unrecorded").otherwise("changed").alias("status"))


def builds(wanted: DataFrame, stored: DataFrame, inputs: list[Column]) -> DataFrame:
    """wanted with `build`, the digest of its inputs, and `reused`: whether a stored build (build) of the same inputs is there."""
    named = wanted.withColumn("build", F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in inputs)), 256))
    return named.join(stored.select("build").distinct().withColumn("_has", F.lit(True)), "build", "left").withColumn("reused", F.coalesce("_has", F.lit(False))).drop("_has")


def gated(members: DataFrame, releases: DataFrame, labelled: Column) -> DataFrame:
    """(partition, n, n_labelled, status) of members (id, partition) and releases (partition, digest).

    A partition is `empty` without members, `unreleased` where it is `test` and no release is bound to its members' digest,
    `unlabelled` where any member lacks a label, else `open`. The digest is that of its sorted members, by one
    aggregation of buckets of ids.
    """
    bucketed = members.where("id IS NOT NULL").groupBy("partition", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("_b"))
    parts = bucketed.agg(F.count(F.lit(1)).alias("n"), F.count_if(labelled).alias("n_labelled"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ","), 256).alias("d"))
    own = parts.groupBy("partition").agg(F.sum("n").alias("n"), F.sum("n_labelled").alias("n_labelled"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("_b").cast("string"), F.lit("="), "d"))), ","), 256).alias("digest"))
    every = own.join(members.select("partition").union(releases.select("partition")).distinct(), "partition", "right")
    bound = releases.select("partition", "digest", F.col("digest").alias("_bound")).distinct()
    rows = every.join(bound, ["partition", "digest"], "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "empty").when((F.col("partition") == "test") & F.col("_bound").isNull(), "unreleased").when(F.col("n_labelled") < n, "unlabelled").otherwise("open")
    return rows.select("partition", n.alias("n"), F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"), status.alias("status"), "digest")
