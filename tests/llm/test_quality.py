import re
from collections import Counter

import numpy as np

from tests.llm import brute
from tidegrid.llm import core, quality


def plain(text):
    t = text or ""
    w = brute.WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if brute.WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def test_statistics_on_awkward_rows(spark):
    rows = brute.awkward(10)
    rows += [(1000 + i, t, "en", "s", 1, None, None) for i, t in enumerate(["a\na\n\na", "a\r\na\r\na\n", "x | y #\n x | y #\nx | y #", "\n\n", "q " * 9, "\nz\n z\nz", "a b c d e f a b c d e"])]
    got = quality.quality(spark.createDataFrame(rows, brute.SCHEMA)).collect()
    assert brute.ordered([tuple(r)[:7] for r in got]) == brute.ordered([(r[0], *plain(r[1])) for r in rows])
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    keys, counts = np.unique(rng.integers(0, 30, 4000) * 128 * 128 + rng.integers(0, 9, 4000) * 128 + rng.integers(0, 60, 4000), return_counts=True)
    p3, p2, w3 = quality.kneser_ney(keys, counts)
    full = (w3[:, None] + p2.reshape(128, 128)[np.arange(1 << 14) & 127]).ravel()
    full[keys] = p3
    assert np.allclose((10**full).reshape(-1, 128).sum(axis=1), 1)


def test_bands_on_the_whole_table(spark):
    d = "/root/testdata/sf0.1"
    got = quality.op7(spark, d)
    noise = spark.createDataFrame([(10**6 + i, "".join(chr(33 + (i * 31 + k * k * 7 + k) % 90) + (" " if k % 6 == 0 else "") for k in range(400)), "en", "s", 400) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = quality.quality(core.table(spark, d, "documents").unionByName(noise)).where("NOT base_failed")
    assert mixed.where("doc_id >= 1000000 AND kept").count() == 0
    sound = got.where("NOT base_failed")
    assert sound.where("kept").count() > 0.9 * sound.count()


def test_classes():
    assert quality.CLASS.max() == 127 and quality.CLASS.min() == 0 and len(set(quality.CLASS[97:123])) == 26 and (quality.CLASS[65:91] == quality.CLASS[97:123]).all()


def judged(rows):
    """(doc_id, perplexity, inside the band) of each row, by dictionaries."""
    from collections import Counter, defaultdict

    def steps(text):
        c = [0, 0, *(int(quality.CLASS[b]) for b in text)]
        return list(zip(c, c[1:], c[2:], strict=False))

    def cut(counts):
        n = Counter(counts)
        t = [max(n[k], 1e-9) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        d = [k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3)]
        d = [x if 0 < x < k else (0.5, 1.0, 1.5)[k - 1] for k, x in enumerate(d, 1)]
        return lambda n: d[min(n, 3) - 1]

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0], (r[1] or "").encode()))
    out = []
    for lang, docs in by.items():
        three = Counter(x for _, t in docs for x in steps(t))
        two = Counter(x[1:] for x in three)
        one = Counter(x[1:] for x in two)

        def level(counts, lower, counts_cut):
            sums, rest = Counter(), Counter()
            for x, n in counts.items():
                sums[x[:-1]] += n
                rest[x[:-1]] += counts_cut(n)
            return lambda x: (counts[x] - counts_cut(counts[x]) if x in counts else 0) / sums[x[:-1]] + rest[x[:-1]] / sums[x[:-1]] * lower(x[1:]) if sums[x[:-1]] else lower(x[1:])

        p1 = level(one, lambda x: 1 / 128, cut(one.values()))
        p2 = level(two, p1, cut(two.values()))
        p3 = level(three, p2, cut(three.values()))
        logs = [(k, -sum(np.log10(p3(x)) for x in steps(t)) / len(t) if t else None) for k, t in docs]
        bins = sorted(int(v * quality.BINS // 1) for _, v in logs if v is not None)
        if bins:
            first, third = ((bins[int(np.ceil(len(bins) * q)) - 1] + 0.5) / quality.BINS for q in (0.25, 0.75))
            wide = 3.0 * max(third - first, 0.002)
        out += [(k, None if v is None else 10**v, v is None or first - wide <= v <= third + wide) for k, v in logs]
    return out


def test_perplexity_and_verdict_against_dictionaries(spark):
    rows = [r for r in brute.awkward(9) if r[2] != "de"] + [(500 + i, f"plain words number {i} of a long row of like texts " * 2 + str(i), "xx", "s", 1, None, None) for i in range(20)]
    rows.append((600, "qzx jvk wqp zzx kjq vvw pqz xjk wvz qkx jzw", "xx", "s", 1, None, None))
    got = {(r.doc_id, r.perplexity and round(r.perplexity, 3), r.kept or r.base_failed) for r in quality.quality(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    failed = {r.doc_id for r in quality.quality(spark.createDataFrame(rows, brute.SCHEMA)).where("base_failed").collect()}
    want = {(k, p and round(float(p), 3), inside or k in failed) for k, p, inside in judged(rows)}
    assert {x[:2] for x in got} == {x[:2] for x in want} and got == want and (600, False) in {(x[0], x[2]) for x in got}


def test_hundreds_of_languages(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('some words of language ', id % 300, ' that say nothing much at all, ', id) AS text", "concat('l', id % 300) AS lang")
    assert quality.quality(docs).where("perplexity > 1").count() == 3000


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
    got = quality.quality(docs.unionByName(spark.createDataFrame(junk, docs.schema))).where("NOT base_failed")
    bad = got.where("doc_id >= 1000000")
    assert bad.where("kept").count() < 0.1 * bad.count()
    labelled = got.join(core.table(spark, d, "labels"), "doc_id").groupBy("quality").agg({"*": "count"}).collect()
    kept = dict(got.where("kept").join(core.table(spark, d, "labels"), "doc_id").groupBy("quality").count().collect())
    all_ = {r[0]: r[1] for r in labelled}
    print("kept by label", {k: kept[k] / all_[k] for k in all_})
    assert kept[1] > 0.95 * all_[1] and kept[0] < 0.8 * all_[0]
