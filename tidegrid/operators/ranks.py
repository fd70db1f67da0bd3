"""Ranks by a hash over whole tables, from counts of hash prefixes; and partitions of groups by such ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one cell of a prefix holds, about.
CELL = 50_000


def _cells(rows: DataFrame, digest: str, by: tuple[str, ...], total: int | None) -> tuple[DataFrame, DataFrame]:
    """rows with `_cell`, a prefix of the hexadecimal digest that leaves CELL rows about, and (by, _cell, _before, _total) of the counts."""
    total = rows.count() if total is None else total
    digits = max(1, math.ceil(math.log(max(1, total / CELL), 16))) if total > CELL else 1
    own = rows.withColumn("_cell", F.substring(digest, 1, digits))
    n = own.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    return own, n.select(*by, "_cell", (F.sum("_n").over(w.orderBy("_cell")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_total"))


def ranked(rows: DataFrame, digest: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = (), rank: str = "rank", total: str = "total", known: int | None = None) -> DataFrame:
    """rows with their rank, from 1, by a hexadecimal digest (then by `ties`) among the rows with equal `by`, and how many those are.

    No key is sorted whole: cells of a digest's prefix are counted, running sums of the counts say where a cell begins, and
    rows are sorted in their cell. Digests are even, so cells are, however many rows a key has. `known` is the count of rows, if it is known.
    """
    own, starts = _cells(rows, digest, by, known)
    place = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(digest, *ties))
    out = own.withColumn("_own", place).join(starts, [*by, "_cell"])
    return out.withColumn(rank, F.col("_before") + F.col("_own")).withColumnRenamed("_total", total).drop("_cell", "_own", "_before")


def first_ranked(rows: DataFrame, digest: str, by: tuple[str, ...], most: Column, ties: tuple[str, ...] = (), known: int | None = None) -> DataFrame:
    """The rows of each `by` whose rank by the digest is `most` or less, with `population`; `most` may use it.

    A cell that begins beyond `most` is never sorted; a cell that ends before it needs no sorting either.
    """
    own, starts = _cells(rows, digest, by, known)
    met = own.join(starts.withColumnRenamed("_total", "population"), [*by, "_cell"]).withColumn("_most", most).where(F.col("_before") < F.col("_most"))
    sizes = starts.select(*by, "_cell", F.coalesce(F.lead("_before").over(Window.partitionBy(*by).orderBy("_cell")), F.col("_total")).alias("_end"))
    met = met.join(sizes, [*by, "_cell"])
    whole, part = met.where(F.col("_end") <= F.col("_most")), met.where(F.col("_end") > F.col("_most"))
    place = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(digest, *ties))
    part = part.withColumn("_own", place).where(F.col("_before") + F.col("_own") <= F.col("_most")).drop("_own")
    return whole.unionByName(part).drop("_cell", "_before", "_end", "_most")


def partitions(groups: DataFrame, test: float, validation: float, digest: str = "digest", clean: str = "clean", families: str = "families") -> DataFrame:
    """groups with `partition`: by their digest the first of the clean ones test, with one of each family; of the rest the first validate, and one or more train.

    The test part is ceil(n * test) of the clean groups, one at least, and besides for each family of clean groups the one with the
    smallest digest. Groups that aren't clean never test. Shares are decimals, so no rounding moves a cut. Digests must differ.
    """
    share = lambda n, f: F.ceil(n * F.lit(str(f)).cast("decimal(6,4)"))
    own = ranked(groups.where(clean), digest, known=None)
    leads = own.select(F.explode(families).alias("_family"), digest).groupBy("_family").agg(F.min(digest).alias(digest)).select(digest).distinct()
    tested = own.where(F.col("rank") <= F.greatest(F.lit(1), share(F.col("total"), test))).select(digest).union(leads).distinct()
    rest = ranked(groups.join(tested, digest, "left_anti"), digest)
    last = F.least(F.col("total") - 1, share(F.col("total"), validation))
    placed = rest.withColumn("partition", F.when(F.col("rank") <= last, "validation").otherwise("train")).drop("rank", "total")
    return placed.unionByName(groups.join(tested, digest, "left_semi").withColumn("partition", F.lit("test")).select(*placed.columns))
