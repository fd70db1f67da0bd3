import random

import numpy as np

from tests.llm import brute
from tidegrid.llm import core, simhash
from tidegrid.llm.components import components
from tidegrid.operators import graph


def test_codewords_meet_at_one_bit():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000)
    for bit in range(23):
        a, b = simhash.codewords(x), simhash.codewords(x ^ (1 << bit))
        pairs = {(int(w), int(c)) for w, c in zip(*a, strict=True)} & {(int(w), int(c)) for w, c in zip(*b, strict=True)}
        assert {w for w, _ in pairs} == set(range(len(x)))


def test_keys_meet_at_three_bits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for _ in range(40):
        y = x.copy()
        for _ in range(3):
            y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        both = set(zip(*map(lambda v: v.tolist(), simhash.keys(x)), strict=True)) & set(zip(*map(lambda v: v.tolist(), simhash.keys(y)), strict=True))
        assert {w for w, _ in both} == set(range(len(x)))


def test_components_of_a_long_shuffled_chain(spark):
    n = list(range(5000))
    random.Random(1).shuffle(n)
    rounds = []
    got = graph.components(spark.createDataFrame(list(zip(n, n[1:], strict=False)), "a long, b long"), rounds)
    assert got.count() == 5000 and got.where("label <> 0").count() == 0 and len(rounds) <= 20


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(-5, 40)] + [(100, 99), (99, 100), (98, 100)], "a long, b long")
    assert dict(map(tuple, components(links).collect())) == {i: -5 for i in range(-5, 41)} | {98: 98, 99: 98, 100: 98}


def test_against_brute_force(spark):
    rows = brute.awkward(5)
    got = simhash.simhash_dedup(spark.createDataFrame(rows, brute.SCHEMA)).selectExpr("doc_id", "lpad(lower(hex(print)), 16, '0')", "component_id")
    assert brute.ordered([tuple(r) for r in got.collect()]) == brute.ordered(brute.simhash(rows, 3, 3))


def test_links_of_planted_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = base.copy()
    for _ in range(6):
        prints = np.r_[prints, prints[:300] ^ (np.uint64(1) << rng.integers(0, 64, len(prints[:300])).astype(np.uint64))]
    prints = np.unique(prints)
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    got = dict(map(tuple, components(simhash.links(frame, len(prints))).collect()))
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    label = np.arange(len(prints))
    for _ in range(len(prints)):
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    groups = {}
    for x, k in zip(prints.view(np.int64).tolist(), label.tolist(), strict=True):
        groups.setdefault(k, set()).add(x)
    mine = {}
    for x in prints.view(np.int64).tolist():
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_empty_and_whole_table(spark):
    assert simhash.simhash_dedup(spark.createDataFrame([], brute.SCHEMA)).count() == 0
    docs = core.table(spark, "/root/testdata/sf0.001", "documents")
    want = brute.simhash([tuple(r) for r in docs.select("doc_id", "text").collect()], 3, 3)
    assert brute.ordered([tuple(r) for r in simhash.op4(spark, "/root/testdata/sf0.001").collect()]) == brute.ordered(want)


def test_dense_keys_and_common_prints(spark):
    rng = np.random.default_rng(3)
    base = np.uint64(0x0123456789ABCDEF)
    masks = [np.uint64(1 << int(i) | 1 << int(j)) for i, j in rng.integers(0, 64, (600, 2))]
    prints = np.unique(np.array([base ^ m for m in masks] + [base ^ np.uint64(0xFF << k) for k in range(0, 56, 7)], np.uint64))
    code = np.zeros(len(prints), np.uint32)
    a, b = simhash._linked(prints, code, 3)
    label = {int(x): int(x) for x in prints}
    for x in map(int, prints):
        for y in map(int, prints):
            if (x ^ y).bit_count() <= 3:
                p, q = sorted((label[x], label[y]))
                label = {k: p if v == q else v for k, v in label.items()} if p != q else label
    got = {int(x): int(x) for x in prints} | {int(x): int(y) for x, y in zip(a, b, strict=True)}
    assert got == label and len(prints) > simhash.DENSE
    rows = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same text of half the rows' ELSE concat('text ', id, ' of ', id * 7, ' and ', id * 3) END AS text")
    got = simhash.simhash_dedup(rows).collect()
    assert len(got) == 5000 and {r.component_id for r in got if r.doc_id % 2 == 0} == {0}
