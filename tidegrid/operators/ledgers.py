"""Append-only ledgers: chains, amendments, persistence without duplicates, write-once sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Refused(ValueError):
    """What contradicts a ledger or a sealed manifest is refused, not repaired."""


def canonical(value) -> str:
    """JSON with sorted keys, compact separators and no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@dataclass(frozen=True)
class Event:
    sequence: int
    kind: str
    key: str
    body: str
    previous: str
    sha: str


def append(events: list[Event], new: Iterable[tuple[str, str, object]]) -> list[Event]:
    """The ledger with new (kind, key, body) in order. One key with one body twice is one event; with another, refused.

    All are checked before any is added.
    """
    out, known = list(events), {e.key: e for e in events}
    for kind, key, body in new:
        text = canonical(body)
        if key in known:
            if (known[key].kind, known[key].body) != (kind, text):
                raise Refused(f"another event has the key {key}")
            continue
        previous = out[-1].sha if out else ""
        event = Event(len(out) + 1, kind, key, text, previous, digest([len(out) + 1, kind, key, text, previous]))
        out.append(event)
        known[key] = event
    return out


def verify(events: list[Event]) -> None:
    """Sequence, links and digests of a whole chain."""
    previous = ""
    for k, e in enumerate(events, 1):
        if e.sequence != k or e.previous != previous or e.sha != digest([e.sequence, e.kind, e.key, e.body, e.previous]):
            raise Refused(f"the chain breaks at {k}")
        previous = e.sha


def chain_breaks(rows: DataFrame, ledger: str, sequence: str, body: str, previous: str, sha: str) -> DataFrame:
    """(ledger, n, breaks): of each ledger its events, and those whose number, link or digest is wrong."""
    w = Window.partitionBy(ledger).orderBy(sequence)
    own = F.sha2(F.concat_ws("|", F.coalesce(F.lag(sha).over(w), F.lit("")), F.col(sequence).cast("string"), F.col(body)), 256)
    wrong = (F.col(sequence) != F.row_number().over(w)) | (F.col(previous) != F.coalesce(F.lag(sha).over(w), F.lit(""))) | (F.col(sha) != own)
    return rows.withColumn("_wrong", wrong).groupBy(ledger).agg(F.count(F.lit(1)).alias("n"), F.count_if("_wrong").alias("breaks"))


def effective(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last of each key's events, and how often it was amended."""
    cols = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(cols, order).alias("_e"), (F.count(F.lit(1)) - 1).alias("amendments")).select("_e.*", "amendments")


def new_only(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't stored: running again adds nothing."""
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def replaced(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """stored with all rows of incoming's keys replaced."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def differences(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row: keys only in a, only in b, and with different values."""
    l = a.select(*key, F.struct(*values).alias("_a"))
    r = b.select(*key, F.struct(*values).alias("_b"))
    both = l.join(r, key, "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("differ"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def seal(rows: DataFrame, path: str, key: list[str]) -> str:
    """Write once; the manifest beside it has the rows' number and digest. An existing path is refused."""
    rows.write.mode("errorifexists").parquet(path)
    spark = rows.sparkSession
    stamp = manifest(spark.read.parquet(path), key)
    spark.createDataFrame([stamp], "n long, sha string").coalesce(1).write.mode("errorifexists").json(f"{path}.manifest")
    return stamp[1]


def manifest(rows: DataFrame, key: list[str]) -> tuple[int, str]:
    """Number of rows and a digest that doesn't depend on their order: hashes are summed, nothing is collected."""
    parts = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring(parts, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    n, *got = rows.agg(F.count(F.lit(1)), *sums).first()
    return n, digest([sorted(key), n, got])


def load_sealed(spark, path: str, key: list[str]) -> DataFrame:
    """The rows, if they are what was sealed."""
    rows = spark.read.parquet(path)
    want = spark.read.json(f"{path}.manifest").first()
    if manifest(rows, key) != (want.n, want.sha):
        raise Refused(f"{path} isn't what was sealed")
    return rows
