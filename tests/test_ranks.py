import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import ranks

sha = lambda x: hashlib.sha256(str(x).encode()).hexdigest()


@pytest.mark.parametrize("cell", [1, 7, 50_000])
def test_ranks_and_first_ranked(spark, monkeypatch, cell):
    """A key with most rows, ties of digests, and keys of one row: plain sorting, for every cell size."""
    monkeypatch.setattr(ranks, "CELL", cell)
    rng = random.Random(18)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, sha(rng.randint(0, 150))) for i in range(400)] + [("one", 999, sha(1))]
    frame = spark.createDataFrame([r for r in rows if r[0]], "k string, i long, d string")
    want = {}
    for k in {r[0] for r in rows if r[0]}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        want |= {r[1]: (n + 1, len(own)) for n, r in enumerate(own)}
    got = {r.i: (r["rank"], r.total) for r in ranks.ranked(frame, "d", ("k",), ("i",)).collect()}
    assert got == want
    some = ranks.first_ranked(frame, "d", ("k",), F.when(F.col("k") == "a", F.col("population")).otherwise(F.least(F.lit(20), F.col("population"))), ("i",))
    kept = {r.i: r.population for r in some.collect()}
    key = {r[1]: r[0] for r in rows}
    assert kept == {i: m for i, (n, m) in want.items() if key[i] == "a" or n <= 20}


@pytest.mark.parametrize("seed", range(4))
def test_partitions_against_plain(spark, seed):
    rng = random.Random(seed)
    rows = [(i, sha(i + 1000 * seed), rng.random() < 0.7, sorted({rng.choice("abcdefgh") for _ in range(rng.randint(1, 2))})) for i in range([40, 3, 1, 0][seed])]
    frame = spark.createDataFrame(rows, "id long, digest string, clean boolean, families array<string>")
    got = {r.id: r.partition for r in ranks.partitions(frame, 0.2, 0.15).collect()}
    clean = sorted((r for r in rows if r[2]), key=lambda r: r[1])
    test = {r[0] for r in clean[: max(1, math.ceil(len(clean) * 0.2))]}
    for f in {f for r in clean for f in r[3]}:
        test.add(next(r[0] for r in clean if f in r[3]))
    rest = sorted((r for r in rows if r[0] not in test), key=lambda r: r[1])
    n = max(0, min(len(rest) - 1, math.ceil(len(rest) * 0.15 - 1e-12)))
    assert got == {i: "test" for i in test} | {r[0]: "validation" if k < n else "train" for k, r in enumerate(rest)}
