import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tidegrid.llm import alignment, core


def tokens(texts):
    """Both libraries' ids and the ends of their tokens, or nothing, by their own calls."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a_path, b_path = alignment.paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    assert ByteLevel
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(plain))}
    for text in texts:
        if not text:
            yield None
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids
        first = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids]
        own = b.encode(text)
        second = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in own]
        if b"".join(first) != (" " + text).encode() or b"".join(second) != (" " + text).encode():
            yield None
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 500 else np.cumsum([len(p) for p in parts]).tolist()
        yield ids, ends(first), own, ends(second)


def plain(rows):
    got, counts, out = list(tokens([r[1] for r in rows])), Counter(), []
    linked = []
    for x in got:
        pairs = []
        if x:
            at = dict(zip(x[3], x[2], strict=True))
            pairs = [(i, at[e]) for i, e in zip(x[0], x[1], strict=True) if e in at]
        linked.append(pairs)
        counts.update(pairs)
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    for r, x, pairs in zip(rows, got, linked, strict=True):
        if not x:
            out.append((r[0], 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts, groups, i, j = sorted(set(x[1]) & set(x[3])), [], 0, 0
        for c in cuts:
            one, two = [], []
            while i < len(x[1]) and x[1][i] <= c:
                one.append(str(x[0][i]))
                i += 1
            while j < len(x[3]) and x[3][j] <= c:
                two.append(str(x[2][j]))
                j += 1
            groups.append(",".join(one) + "|" + ",".join(two))
        text = ";".join(groups)
        out.append((r[0], len(x[0]), len(x[2]), len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), text))
    return out, counts, best


def check(spark, rows, **limits):
    documents, pairs = alignment.align(spark.createDataFrame(rows, brute.SCHEMA), *alignment.paths(), limits=alignment.Limits(**limits))
    want, counts, best = plain(rows)
    assert brute.ordered([tuple(r) for r in documents.collect()]) == brute.ordered(want)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted((a, b, n, n == best[b]) for (a, b), n in counts.items())


def test_awkward_rows(spark):
    rows = [*brute.awkward(10)]
    for i, t in enumerate(["<|endoftext|> <s> </s> <unk>", "a▁b", "  two  spaces ", "日本語 한국 \U00020001", "\u0000x", "ﬀ é é", "x" * 3000, "<0x41>"]):
        rows += [(900 + i, t, "en", "s", 1, None, None)] * 2
    check(spark, rows)


@pytest.mark.parametrize(("cells", "counted", "merged", "scored"), [(60_000, 1, 2, 1), (200_000, 2, 3, 2)])
def test_many_groups(spark, cells, counted, merged, scored):
    """More stripes, and more rounds and groups than these rows need, give the same rows."""
    rng = random.Random(5)
    check(spark, [(i, " ".join(rng.choice(["the", "of", "règle", "Straße", "x1", "…", "hold,", "ing"]) for _ in range(rng.randint(0, 40))), "en", "s", 1, None, None) for i in range(120)], cells=cells, batch=400, counted=counted, merged=merged, scored=scored)


def test_long_text_and_empty_table(spark):
    check(spark, [(1, "a long text, of words 12 and (more) \n\n  lines " * 40_000, "en", "s", 1, None, None)])
    documents, pairs = alignment.align(spark.createDataFrame([], brute.SCHEMA), *alignment.paths())
    assert documents.collect() == [] and pairs.collect() == []


def test_chunks_are_exact():
    """Texts cut at spaces between words have the ids of whole texts, by both sides."""
    rng = random.Random(6)
    own = alignment.Aligner(*alignment.paths())
    assert not own.b.spans
    words = ["the", "of", "don't", "1", "22", "x1", "é", "…", "a.", "(b", " ", "\n", "\t", "日本", "'s", ""]
    old = alignment.CHUNK
    try:
        for _ in range(300):
            text = "a" + " ".join(rng.choice(words) for _ in range(200))
            alignment.CHUNK = 1 << 20
            whole = own.tokens(text)
            alignment.CHUNK = 7
            cut = own.tokens(text)
            assert all(np.array_equal(x, y) for x, y in zip(whole, cut, strict=True))
    finally:
        alignment.CHUNK = old


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in core.table(spark, d, "documents").select("doc_id", "text").collect()]
    want = [(*x[:7], hashlib.sha256(x[7].encode()).hexdigest() if x[7] else "") for x in plain(rows)[0]]
    assert brute.ordered([tuple(r) for r in alignment.op13(spark, d).collect()]) == brute.ordered(want)
