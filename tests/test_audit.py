import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import audit


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_planted_edits_are_found_by_descent(spark, depth):
    rng = random.Random(20)
    rows = [(i, rng.choice(["a", "", None, "long " * 50]), i % 7) for i in range(600)] + [(5, "twice", 1)]
    now = [r for r in rows if r[0] not in (17, 401)] + [(9000, "new", None)]
    now = [(i, None if i == 100 else t, k + 1 if i == 200 and k is not None else k) for i, t, k in now]
    schema = "id long, t string, k int"
    make = lambda x: audit.receipts(spark.createDataFrame(x, schema), "id", [F.col("t"), F.col("k")])
    want = {17: "missing", 401: "missing", 9000: "unrecorded", 200: "changed"} | ({100: "changed"} if dict((r[0], r[1]) for r in rows)[100] is not None else {})
    assert {r.id: r.status for r in audit.audited(make(rows), make(now), depth).collect()} == want
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert audit.audited(make(rows), make(shuffled), depth).collect() == []
    bad = audit.differing(audit.rolled(make(rows), depth), audit.rolled(make(now), depth), depth)
    assert bad.count() <= len(want) and audit.rolled(make(rows), depth).where("level = 0").first().n == 601
    assert audit.audited(make(rows[:0]), make(rows[:0]), depth).collect() == []


def test_builds_and_gates(spark):
    wanted = spark.createDataFrame([(1, "ab", "c"), (2, "a", "bc"), (3, None, "c")], "id int, x string, y string")
    inputs = [F.col("x"), F.col("y")]
    stored = audit.builds(wanted.where("id = 2"), spark.createDataFrame([], "build string"), inputs)
    assert {r.id: r.reused for r in audit.builds(wanted, stored, inputs).collect()} == {1: False, 2: True, 3: False}
    members = spark.createDataFrame([(1, "test", True), (2, "test", True), (3, "train", True), (4, "train", False), (5, "val", True), (None, "void", True)], "id long, partition string, ok boolean")
    none = spark.createDataFrame([("spare", "x")], "partition string, digest string")
    got = {r.partition: (r.n, r.status) for r in audit.gated(members, none, F.col("ok")).collect()}
    assert got == {"test": (2, "unreleased"), "train": (2, "unlabelled"), "val": (1, "open"), "void": (0, "empty"), "spare": (0, "empty")}
    digest = audit.gated(members, none, F.col("ok")).where("partition = 'test'").first().digest
    bound = spark.createDataFrame([("test", digest)], "partition string, digest string")
    assert audit.gated(members, bound, F.col("ok")).where("partition = 'test'").first().status == "open"
    more = members.union(spark.createDataFrame([(9, "test", True)], members.schema))
    assert audit.gated(more, bound, F.col("ok")).where("partition = 'test'").first().status == "unreleased"
