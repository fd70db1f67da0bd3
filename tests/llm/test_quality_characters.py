"""The character model of op7 against dictionaries: no folding, buckets, and what was not seen."""

from collections import Counter, defaultdict

import numpy as np

from tests.llm import brute
from tidegrid.llm import core, quality


def model(texts):
    """log10 probability of a step (a, b, c) by an interpolated modified Kneser-Ney model of texts' characters."""
    three = Counter(x for t in texts for x in steps(t))
    two = Counter(x[1:] for x in three)
    one = Counter(x[1:] for x in two)

    def level(counts, lower):
        n = Counter(counts.values())
        cut = quality.discounts([n[k] for k in (1, 2, 3, 4)])
        sums, rest = Counter(), Counter()
        for x, k in counts.items():
            sums[x[:-1]] += k
            rest[x[:-1]] += cut[min(k, 3)]
        return lambda x: ((counts[x] - cut[min(counts[x], 3)] if x in counts else 0) + rest[x[:-1]] * lower(x[1:])) / sums[x[:-1]] if sums[x[:-1]] else lower(x[1:])

    return level(three, level(two, level(one, lambda x: 1 / (len(one) + 1))))


def steps(text):
    c = [quality.BORDER, quality.BORDER, *map(ord, text)]
    return list(zip(c, c[1:], c[2:], strict=False))


def log_perplexity(p, text):
    return -sum(np.log10(p(x)) for x in steps(text)) / len(text)


def test_characters_are_not_folded():
    def key(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return quality.characters(buf, np.array([0, len(buf)]))[0].tolist()

    texts = ["ab1", "aB1", "ab2", "дом", "том", "字", "学", "a\x00"]
    assert len({tuple(key(t)) for t in texts}) == len(texts) and all(len(key(t)) == len(t) for t in texts)
    buf, offs = np.frombuffer("é".encode() + b"\xc3" + b"\xa9b", np.uint8), np.array([0, 2, 3, 3, 5])
    keys, at = quality.characters(buf, offs)
    assert (keys & (1 << 21) - 1).tolist() == [ord("é"), 0xFFFD, 0xFFFD, ord("b")] and at.tolist() == [0, 1, 2, 2, 4]


def test_op7_is_the_model_of_characters(spark, tmp_path):
    rows = brute.awkward(9) + [(900 + i, f"Дом {i} и том 学校{i} ÀÉ", "ru", "s", 1, None, None) for i in range(15)]
    spark.createDataFrame(rows, brute.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r[1] or "")
    p = {k: model(v) for k, v in by.items()}
    want = brute.ordered([(r[0], round(float(10 ** log_perplexity(p[r[2]], r[1])), 3) if r[1] else None) for r in rows])
    assert brute.ordered([(r.doc_id, r.perplexity and round(r.perplexity, 3)) for r in quality.op7(spark, str(tmp_path)).collect()]) == want


def test_buckets_and_unseen_characters(spark, monkeypatch):
    texts = ["one two three", "two ones", "threes тест", "学校 two"]
    others = ["two онe z", "qqq", "学学", "one"]
    frame = lambda v: spark.createDataFrame([(i, t, "x") for i, t in enumerate(v)], "doc_id long, text string, lang string")
    p = model(texts)
    want = [round(float(log_perplexity(p, t)), 4) for t in others]
    for size, many in ((core.BUCKET_BYTES, False), (200, True)):
        monkeypatch.setattr(core, "BUCKET_BYTES", size)
        folder, models = quality.train_characters(frame(texts))
        assert (models.first().buckets > 1) == many
        assert [round(r.log_perplexity, 4) for r in quality.measured(frame(others), folder, models).orderBy("doc_id").collect()] == want


def test_junk_and_labels(spark):
    """Scrambled texts go, nearly all texts labelled as good stay, and a good part of the bad ones go."""
    import random

    d, rng = "/root/testdata/sf0.1", random.Random(1)
    docs = core.table(spark, d, "documents")
    junk = []
    for i, r in enumerate(docs.where("length(text) > 200").orderBy("doc_id").limit(200).collect()):
        t = r.text[:1500]
        t = "".join(rng.sample(t, len(t))) if i % 2 else " ".join(w[::-1] for w in t.split())
        junk.append((10**6 + i, t, r.lang, r.source, len(t)))
    got = core.kept(quality.quality(docs.unionByName(spark.createDataFrame(junk, docs.schema)), by_character=True).where("NOT base_failed"))
    bad = got.where("doc_id >= 1000000")
    count = lambda df: dict(df.join(core.table(spark, d, "labels"), "doc_id").groupBy("quality").count().collect())
    kept, every = count(got.where("kept")), count(got)
    print("junk kept", bad.where("kept").count(), "of", bad.count(), "kept by label", {k: kept[k] / every[k] for k in every})
    assert bad.where("kept").count() < 0.1 * bad.count() and kept[1] > 0.95 * every[1] and kept[0] < 0.8 * every[0]
