import itertools

import numpy as np

from tests.llm import brute
from tidegrid.llm import core, toxicity


def test_marginals_against_all_paths():
    field = toxicity.Field(np.zeros(0, np.uint64), np.zeros(0), -1.5, (-0.7, 0.3, 0.9), (0, 0, 0), 0.1)
    # tokens: idle, active 2.0, idle, idle, active 3.0, active -1.0, idle
    extra = {1: 2.0, 4: 3.0, 5: -1.0}
    a = np.array([[0, -0.7], [0.3, 0.9]])
    z, on = 0.0, np.zeros(7)
    for path in itertools.product((0, 1), repeat=7):
        s = sum(a[x, y] for x, y in zip((0, *path), path, strict=False)) + sum((-1.5 + extra.get(i, 0)) * y for i, y in enumerate(path))
        z += np.exp(s)
        on += np.exp(s) * np.array(path)
    p, log = toxicity.marginals(field, np.array([[1, 2, 0]]), np.array([1]), np.array([[2.0, 3.0, -1.0]]), np.ones((1, 3), bool))
    assert np.allclose(log[0], np.log(z)) and np.allclose(p[0], on[[1, 4, 5]] / z)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op5(spark, d).join(core.table(spark, d, "labels"), "doc_id").where("held_out")
    hit, n, found, toxic = (float(x) for x in got.selectExpr("count_if(predicted = toxic)", "count(1)", "count_if(predicted = 1 AND toxic = 1)", "count_if(toxic = 1)").first())
    assert hit / n > 0.97 and found / toxic > 0.9


def test_awkward_rows(spark):
    docs = spark.createDataFrame(brute.awkward(6), brute.SCHEMA)
    labels = spark.createDataFrame([(r[0], int("worthless" in (r[1] or ""))) for r in brute.awkward(6)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    field = toxicity.train(docs, labels)
    rows = toxicity.toxicity(docs, field, spans=True, carry=("b", "n_chars")).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    for train_on in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.toxicity(docs, toxicity.train(docs, train_on)).where("score IS NULL").count() == 0
    assert toxicity.toxicity(docs.limit(0), field).count() == 0
    assert toxicity.toxicity(docs, toxicity.train(docs.limit(0), labels)).count() == docs.count()
