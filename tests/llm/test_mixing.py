from collections import defaultdict

import duckdb
import pytest

from tests.llm import brute
from tidegrid.llm import core, mixing


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        each = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += each * w[s]
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 70, None: 1}, {"a": 1, "b": 1000, "c": 1000, "d": 0, "É": 3, "z": 90}, {None: 4}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in rows} == pytest.approx(filled(sizes))


def test_awkward_rows(spark):
    rows = brute.awkward(7)
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    got = mixing.plan(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(brute.WORD.findall(r[1] or ""))
    target = filled(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r._size == len(brute.WORD.findall(r.text or "")) and r._target == pytest.approx(target[r.source])
        rate = r._target / r._source_size if r._source_size else 0
        assert r._copies in (int(rate), int(rate) + 1) and r._copies <= 2
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r._copies for r in got)
    assert mixing.plan(docs.limit(0)).count() == 0


def test_whole_table_against_sql_and_targets(spark):
    d = "/root/testdata/sf0.1"
    got = mixing.op8(spark, d).join(core.table(spark, d, "documents").select("doc_id", "source"), "doc_id").toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(mixing.ORACLE).df().set_index("doc_id").sort_index()
    mine = got.set_index("doc_id").sort_index()
    for c in ("size", "source_size", "taken"):
        assert (mine[c] == want[c]).all()
    assert (abs(mine.target - want.target) < 1e-6).all()
    for _, g in got.groupby("source"):
        assert g.taken.sum() == pytest.approx(g.target.iloc[0], rel=0.15)
