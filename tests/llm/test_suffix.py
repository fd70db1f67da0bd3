import random

import numpy as np
import pytest

from tests.llm import brute
from tidegrid.llm import core, suffix


@pytest.mark.parametrize("length", [20, 50])
def test_against_brute_force(spark, length):
    rows = brute.awkward(2)
    got = suffix.suffix_dedup(spark.createDataFrame(rows, brute.SCHEMA), length, digest=True)
    got = [(r[0], r[1], r[2], r[3], r[4].hex()) for r in got.collect()]
    assert brute.ordered(got) == brute.ordered(brute.suffix(rows, length))


def test_hot_anchors(spark, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(i * 7 % 300, f"{rng.random()}" * 3 + passage[: rng.randint(80, 120)] + f"{rng.random()}" * 3) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.ordered(brute.suffix(rows, 50))
    for hot in (0, 20, 4000):
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "shared", shared_with(hot))
        got = [(*tuple(r)[:4], r.kept.hex()) for r in suffix.suffix_dedup(frame, 50, digest=True).collect()]
        assert brute.ordered(got) == want


def shared_with(hot):
    """The module's function with another threshold, also in the workers."""
    plain = suffix.shared

    def how(t):
        suffix.HOT, before = hot, suffix.HOT
        try:
            return plain(t)
        finally:
            suffix.HOT = before

    return how


def test_empty(spark):
    assert suffix.suffix_dedup(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def test_whole_table(spark):
    docs = core.table(spark, "/root/testdata/sf0.001", "documents")
    want = brute.suffix([tuple(r) for r in docs.select("doc_id", "text").collect()], 50)
    assert brute.ordered([tuple(r) for r in suffix.op3(spark, "/root/testdata/sf0.001").collect()]) == brute.ordered(want)


def test_maximal_repeats():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(60)).encode() for _ in range(3)]
    where = {}
    for d, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i + 4, len(t) + 1):
                where.setdefault(t[i:j], []).append((d, i))
    want = []
    for s, at in where.items():
        left = {texts[d][i - 1] if i else (d, i) for d, i in at}
        right = {texts[d][i + len(s)] if i + len(s) < len(texts[d]) else (d, i) for d, i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            want.append((len(s), sorted(at)))
    assert sorted(suffix.maximal_repeats(texts, 4)) == sorted(want)


def test_carried_columns(spark):
    rows = brute.awkward(4)
    got = suffix.suffix_dedup(spark.createDataFrame(rows, brute.SCHEMA), 30, carry=("lang", "b", "key", "n_chars"))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "lang", "b", "key", "n_chars"]
    assert sorted(map(repr, ((r[0], r[5], r[8]) for r in got.collect()))) == sorted(map(repr, ((r[0], r[2], r[4]) for r in rows)))


def test_windows_that_may_begin_a_repeat_are_few_and_none_is_lost():
    """A passage of two documents begins a repeat at one window of each, however long; the rest is not sorted."""
    rng = random.Random(11)
    draw = lambda n: bytes(rng.choices(b"abcdefgh ", k=n))
    passage = draw(400)
    texts = [np.frombuffer(draw(300) + b"x" + passage + draw(300), np.uint8), np.frombuffer(draw(200) + b"y" + passage + draw(100), np.uint8)]
    text = np.concatenate(texts)
    at = np.concatenate([np.arange(len(texts[0]) - 49), len(texts[0]) + np.arange(len(texts[1]) - 49)])
    key = (at >= len(texts[0])).astype(np.int64)
    left = np.where((at > 0) & (at != len(texts[0])), text[at - 1].astype(np.int64), suffix.NONE)
    some = suffix.repeated(suffix.gram_hashes(text, 50, at), key, left)
    assert at[some].tolist() == [301, len(texts[0]) + 201]
    assert suffix.repeated(suffix.gram_hashes(text, 50, at), np.zeros(len(at), np.int64), left).tolist() == []


@pytest.mark.parametrize("gram", [1, 5, 8, 24, 50])
def test_gram_hashes_tell_grams_apart(gram):
    rng = np.random.default_rng(gram)
    buf = np.r_[rng.integers(0, 3, 40000), np.tile(np.r_[np.zeros(7), 1, np.zeros(7), 1], 50), rng.integers(0, 256, 5000)].astype(np.uint8)
    h = suffix.gram_hashes(buf, gram)
    raw = buf.tobytes()
    grams = [raw[i : i + gram] for i in range(len(raw) - gram + 1)]
    assert len(h) == len(grams) and len(set(h.tolist())) == len(set(grams)) == len(set(zip(h.tolist(), grams, strict=True)))
    places = rng.integers(0, len(grams), 30000)
    assert (suffix.gram_hashes(buf, gram, places) == h[places]).all()
    assert not len(suffix.gram_hashes(buf[: gram - 1], gram))


def test_an_extent_has_one_identity_whatever_else_its_batch_holds():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 101, 50).astype(np.uint8)
    for n in (50, 60, 90):
        buf = np.r_[passage, rng.integers(97, 123, n).astype(np.uint8)]
        x = suffix.Extents(buf, np.array([0, 50, 50 + n]), 50, 24)
        if n == 50:
            want = x.identity()[0]
        assert x.identity()[0] == want and len(set(x.identity().tolist())) == len(x.start)
    assert len(x.start) > 1
