import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import brute
from tidegrid.llm import core, lm


def plain(rows):
    """The same model with dictionaries."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [[*brute.WORD.findall(low(r[1])), None] for r in rows]
    out = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    pairs, uses = Counter(), Counter()
    for d, o in zip(docs, out, strict=True):
        if not o:
            pairs.update(zip(["<s>", *d], d, strict=False))
            uses.update(d)
    types, total, follow = Counter(w for _, w in pairs), Counter(), defaultdict(Counter)
    for (b, _), n in pairs.items():
        total[b] += n
        follow[b][min(n, 3)] += 1
    kinds = lambda c: [sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)]
    dp, dw = lm.discounts(kinds(pairs)), lm.discounts(kinds(types))
    n_all, v_all, t_all = sum(uses.values()), len(uses), len(pairs)
    left = sum(dw[min(t, 3)] for t in types.values())
    res = []
    for r, d, o in zip(rows, docs, out, strict=True):
        base = score = 0.0
        for b, w in zip(["<s>", *d], d, strict=False):
            base += math.log10((uses[w] + 0.5) / (n_all + 0.5 * (v_all + 1)))
            p = (types[w] - dw[min(types[w], 3)]) / t_all + left / t_all / (v_all + 1)
            if total[b]:
                n = pairs[b, w]
                p = (n - dp[min(n, 3)] + sum(dp[k] * follow[b][k] for k in (1, 2, 3)) * p) / total[b]
            score += math.log10(p)
        res.append((r[0], o, len(d), sum(uses[w] > 0 for w in d), n_all, base, score))
    return res


def same(got, want):
    key = lambda r: repr((r[0], r[2], r[3], round(r[5], 4)))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:5]) == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)


def test_against_dictionaries(spark):
    rows = brute.awkward(9)
    same([tuple(r) for r in lm.lm_scores(spark.createDataFrame(rows, brute.SCHEMA)).collect()], plain(rows))


def test_whole_table_beats_base_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in lm.op2(spark, d).collect()]
    same(rows, plain([tuple(r) for r in core.table(spark, d, "documents").select("doc_id", "text").collect()]))
    held = [r for r in rows if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_no_rows(spark):
    empty = spark.createDataFrame([], brute.SCHEMA)
    assert lm.lm_scores(empty).count() == 0
    only = spark.createDataFrame([(k, "x y") for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 1], "doc_id long, text string")
    assert {(r.train_tokens, r.score, r.base_score) for r in lm.lm_scores(only).collect()} == {(0, 0.0, 0.0)}


def test_more_files_than_descriptors(tmp_path):
    import os
    import resource

    folder, some = str(tmp_path), np.arange(7, dtype=np.uint64)
    for k in range(300):
        lm._save(folder, f"word{k}", word=some + np.uint64(k), none=some[:0])
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    lm._mapped.clear()
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 40, hard))
    try:
        model = lm.Model(folder, lm.Layout(4, some[:0]), np.zeros(11))
        got = [model.array(f"word{k}-word") for k in range(300)]
        assert all((g == some + np.uint64(k)).all() for k, g in enumerate(got)) and len(model.array("word3-none")) == 0
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
