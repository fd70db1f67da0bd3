"""Review workflow: responses checked before any is stored, packets, corrections, freezing, pages."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalars import hashed
from tidegrid.operators.ledgers import Refused

LABELS = ("target", "non_target", "uncertain")


def faults(responses: DataFrame, tasks: DataFrame) -> DataFrame:
    """responses (task_id, reviewer, phase, status, begun, ended, marks array<struct<r, c, label>>) with `reasons`.

    tasks (task_id, phase, reviewer, mode, r0, c0, r1, c1): a response needs its issued task, ordered times, known labels,
    marks inside the task's core, and for a candidate exactly one mark.
    """
    t = tasks.select("task_id", "phase", "reviewer", "mode", "r0", "c0", "r1", "c1", F.lit(True).alias("_issued"))
    rows = responses.join(t, ["task_id", "phase", "reviewer"], "left")
    outside = F.exists("marks", lambda m: (m["r"] < F.col("r0")) | (m["r"] >= F.col("r1")) | (m["c"] < F.col("c0")) | (m["c"] >= F.col("c1")))
    reasons = F.array(
        F.when(F.col("_issued").isNull(), "not issued"), F.when(F.col("ended") < F.col("begun"), "times out of order"), F.when(~F.col("status").isin("complete", "partial", "skipped"), "unknown status"),
        F.when(F.exists("marks", lambda m: ~m["label"].isin(*LABELS)), "unknown label"), F.when(F.col("_issued") & outside, "mark outside the core"),
        F.when((F.col("mode") == "candidate") & (F.col("status") == "complete") & (F.size("marks") != 1), "a candidate needs one mark"),
    )
    return rows.withColumn("reasons", F.array_compact(reasons)).drop("_issued")


def imported(stored: DataFrame, responses: DataFrame, tasks: DataFrame) -> DataFrame:
    """The rows to append: all, or none if any is at fault; known ones again are no change, changed ones are refused."""
    bad = faults(responses, tasks).where(F.size("reasons") > 0)
    if not bad.isEmpty():
        raise Refused(f"responses at fault: {bad.select('task_id', 'reasons').limit(5).collect()}")
    key = ["task_id", "phase", "reviewer"]
    body = lambda d: d.select(*key, F.to_json(F.struct(*sorted(set(responses.columns) - set(key)))).alias("body"))
    if not body(stored).withColumnRenamed("body", "old").join(body(responses), key).where("old <> body").isEmpty():
        raise Refused("a stored response has another body")
    return responses.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def repeats(responses: DataFrame, reviewer: str, fraction: float, seed: int) -> DataFrame:
    """A reviewer's tasks to repeat, by hash rank, without what they answered."""
    own = responses.where((F.col("reviewer") == reviewer) & (F.col("status") == "complete"))
    n = max(1, ceil(own.count() * fraction))
    phase = hashed(F.lit("repeat"), F.lit(reviewer), F.lit(seed))
    return own.orderBy(hashed(F.lit(seed), F.col("task_id")), "task_id").limit(n).select("task_id", phase.alias("phase"), F.lit(reviewer).alias("reviewer"))


def adopted(current: DataFrame, corrections: DataFrame) -> DataFrame:
    """(task_id, digest) after corrections (task_id, of, digest): all or none; each must name the digest that holds now."""
    rows = corrections.join(current.withColumnRenamed("digest", "now"), "task_id", "left")
    bad = rows.where(F.col("now").isNull() | (F.col("now") != F.col("of")))
    twice = corrections.groupBy("task_id").count().where("count > 1")
    if not bad.isEmpty() or not twice.isEmpty():
        raise Refused("corrections that don't bind to what holds now")
    return current.join(corrections.select("task_id"), "task_id", "left_anti").unionByName(corrections.select("task_id", "digest"))


def frozen(tasks: DataFrame, responses: DataFrame, decisions: DataFrame) -> DataFrame:
    """One label a task: what reviewers agree on, else the decision; open tasks or undecided disagreements are refused."""
    done = responses.where("status = 'complete'").groupBy("task_id").agg(F.collect_set(F.col("marks")[0]["label"]).alias("labels"))
    rows = tasks.select("task_id").distinct().join(done, "task_id", "left").join(decisions.select("task_id", F.col("label").alias("_decided")), "task_id", "left")
    label = F.coalesce("_decided", F.when(F.size("labels") == 1, F.col("labels")[0]))
    rows = rows.select("task_id", label.alias("label"))
    if not rows.where("label IS NULL").isEmpty():
        raise Refused("tasks are open or disagreed on")
    return rows


def due(responses: DataFrame, days: int) -> DataFrame:
    """When each reviewer may begin a repeat: the latest review and a delay."""
    return responses.groupBy("reviewer").agg((F.max("ended") + F.expr(f"INTERVAL {int(days)} DAY")).alias("not_before"))


def in_order(responses: DataFrame) -> DataFrame:
    """Candidate reviews that began before the reviewer's surveys had ended."""
    last = F.max(F.when(F.col("mode") == "survey", F.col("ended"))).over(Window.partitionBy("reviewer"))
    return responses.withColumn("_last", last).where((F.col("mode") == "candidate") & (F.col("begun") < F.col("_last"))).drop("_last")


@dataclass(frozen=True)
class Page:
    items: list
    limit: int
    offset: int
    next_offset: int | None


def page_of(rows: DataFrame, keep, limit: int, offset: int, *order) -> Page:
    """A page envelope: there is a next page if the store gave a full one, whatever the scope filter keeps of it."""
    got = rows.orderBy(*order).offset(offset).limit(limit).collect()
    return Page([r for r in got if keep(r)], limit, offset, offset + limit if len(got) == limit else None)
