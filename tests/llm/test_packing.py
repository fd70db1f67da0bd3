import random
import zlib

import numpy as np

from tests.llm import brute
from tidegrid.llm import core, packing


def plain(lengths, capacity):
    """Best-fit decreasing, one piece at a time: the sorted contents of the bins."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= x]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(x)
        else:
            bins.append([x])
    return bins


def test_best_fit_against_plain():
    rng = random.Random(1)
    cases = [(12, [4] * 4 + [3] * 2 + [2])]
    for _ in range(2000):
        capacity = rng.choice([7, 12, 16, 50])
        some = rng.sample(range(1, capacity + 1), rng.randint(1, capacity))
        cases.append((capacity, [rng.choice(some) for _ in range(rng.randint(0, 60))]))
    for capacity, lengths in cases:
        counts = {x: lengths.count(x) for x in set(lengths)}
        bins = {}
        for length, a, b, first, offset in packing.best_fit(counts, capacity):
            for k in range(b - a):
                bins.setdefault(first + k, []).append((offset, length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(sum(x for _, x in b) for b in bins.values()) == sorted(map(sum, plain(lengths, capacity)))  # bins of one room are alike
        assert sorted(x for b in bins.values() for _, x in b) == sorted(lengths)


def check(rows, got):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(packing.vocabulary()), []
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert brute.ordered([tuple(r)[:5] for r in got]) == brute.ordered(want)
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in full.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(full) == len(plain([w[3] for w in want], 1024))


def test_awkward_rows(spark):
    rows = [*brute.awkward(8), (900, "long " * 5000, "en", "s", 1, None, None), (901, "<|endoftext|> x", "en", "s", 1, None, None)]
    check(rows, packing.pack(spark.createDataFrame(rows, brute.SCHEMA), packing.vocabulary()).collect())
    assert packing.pack(spark.createDataFrame([], brute.SCHEMA), packing.vocabulary()).count() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    check([tuple(r) for r in core.table(spark, d, "documents").select("doc_id", "text").collect()], packing.op10(spark, d).collect())


def test_ids_of_both_libraries():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    tokenizer.encode_special_tokens = True
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x20000, 64)]
    encode = packing.encoder(packing.vocabulary()).encode_ordinary
    assert [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)] == [encode(x) for x in texts]
