"""Components of link tables by random contraction, in rounds of tables in the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on this machine alone gets one of its own where none is set."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_tidegrid_shared", None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = sc._tidegrid_shared = tempfile.mkdtemp(prefix="tidegrid-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder; its lineage ends there."""
    shared(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, label) of every node of links (a, b): label is the smallest node that links reach. Null ends and loops say nothing.

    In a round every node steps to the node of smallest hash among itself and its neighbours, with another hash each round.
    Nodes that stepped to one place become one, links follow, and those inside a node go; whatever a graph's shape or the
    order of its ids, a part of all nodes goes each round (half of a chain's, all but one of a clique's), so rounds grow with the
    logarithm of their number. At the end places go back through the rounds, the last first, and each place's
    smallest node is its label.

    Rounds are tables in the shared folder, read with their schema: a checkpoint would hand the optimizer what it knows of
    equal columns, which doubles with each round of joins. They are removed at the end. Only whether links are left reaches
    the driver. `rounds` takes the number of links left after each round.
    """
    spark = links.sparkSession
    at = f"{shared(spark)}/components-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    left = links.select("a", "b").where("a <> b")
    left = written(left.union(left.select("b", "a")).distinct(), "links0")
    steps, k = [], 0
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        step = left.groupBy("a").agg(F.least(F.first(rank("a")), F.min(rank("b"))).alias("m")).select("a", F.col("m.node").alias("place"))
        steps.append(written(step, f"step{k}"))
        ends = left.join(steps[-1], "a").select(F.col("place").alias("x"), F.col("b").alias("a")).join(steps[-1], "a").select("x", F.col("place").alias("y"))
        left = written(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"links{k + 1}")
        k += 1
        if rounds is not None:
            rounds.append(left.count())
    places = steps[-1] if steps else left.select("a", F.col("b").alias("place"))
    for i in reversed(range(k - 1)):
        later = places.select(F.col("a").alias("place"), F.col("place").alias("_later"))
        places = written(steps[i].join(later, "place", "left").select("a", F.coalesce("_later", "place").alias("place")), f"places{i}")
    label = places.groupBy("place").agg(F.min("a").alias("label"))
    out = kept(places.join(label, "place").select(F.col("a").alias("node"), "label"))
    removed(spark, at)
    return out


def smallest_labels(links: DataFrame, key: str) -> DataFrame:
    """(key, node, label): of each node the smallest node of its key that links (key, a, b) reach."""
    own = lambda c: F.struct(F.col(key).alias("k"), F.col(c).alias("n"))
    loops = links.select(key, F.col("a").alias("node")).union(links.select(key, "b")).distinct()
    found = components(links.select(own("a").alias("a"), own("b").alias("b"))).select(F.col("node.k").alias(key), F.col("node.n").alias("node"), F.col("label.n").alias("label"))
    return loops.join(found, [key, "node"], "left").select(key, "node", F.coalesce("label", "node").alias("label"))
