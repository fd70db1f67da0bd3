import hashlib
import random
import sys

import numpy as np
import pytest

from tests.llm import brute
from tidegrid.llm import bpe, core

PATH = bpe.word_vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want(library, rows):
    out = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        out.append((r[0], ids, library.decode(ids, skip_special_tokens=False)))
    return out


def test_characters(library):
    """Every proved character: the same normal form and the same class as the library's."""
    from tokenizers import pre_tokenizers

    own, split = bpe.Vocabulary(PATH), pre_tokenizers.Split(bpe.pattern_of(PATH), "removed", invert=True)
    proved = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not bpe.PROVED.search(chr(c))]
    assert len(proved) > 30_000
    for i in range(0, len(proved), 50):
        text = " ".join(f"a{x}a{x}{x}!1{x}" for x in proved[i : i + 50])
        assert own.words(text) == [p for p, _ in split.pre_tokenize_str(library.normalizer.normalize_str(text))], hex(ord(proved[i]))


def test_merges(library):
    rng, v = random.Random(3), bpe.vocabulary(PATH)
    letters = [*"abcdeinorst", "é", "ß", "ж", "中"]
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 9, 60, 300]))) for _ in range(3000)] + ["a" * 5000, "ab" * 700]
    for w in words:
        assert v.merge(w.encode()) == library.encode(w, add_special_tokens=False).ids, w
    coded = [w.encode() for w in words]
    size, ids = v.merge_many(np.frombuffer(b"".join(coded), np.uint8), np.r_[0, np.cumsum([len(w) for w in coded])])
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [v.merge(w) for w in coded]


def test_transducer(tmp_path):
    """Finds its words with their ids and no other, is minimal, and shares suffixes."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))).encode() for _ in range(2000)})
    entries = [(w, tuple(rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 3)))) for w in words]
    made = bpe.compile_transducer(entries)
    for name, a in made.items():
        np.save(tmp_path / f"{name}.npy", a)
    lexicon, asked = bpe.Lexicon(str(tmp_path)), words + [w + b"x" for w in words] + [b"", b"c" * 70, b"zz"]
    buf, offs = np.frombuffer(b"".join(asked), np.uint8), np.r_[0, np.cumsum([len(w) for w in asked])]
    held, first, ids = lexicon.find(buf, offs)
    assert held.tolist() == [w in set(words) for w in asked]
    table = dict(entries)
    for i, w in enumerate(asked):
        assert tuple(ids[first[i] : first[i + 1]]) == table.get(w, ())

    def accepts(state, memory):  # the rest that a state accepts, with the ids
        if state not in memory:
            arcs = [(int(k) % 256, *map(int, a)) for k, a in zip(made["keys"], made["arcs"], strict=True) if k // 256 == state]
            final, at, n = map(int, made["ends"][state])
            own = {(b"", tuple(made["pool"][at : at + n].tolist()))} if final else set()
            for c, t, a, m in arcs:
                own |= {(bytes([c]) + w, tuple(made["pool"][a : a + m].tolist()) + out) for w, out in accepts(t, memory)}
            memory[state] = frozenset(own)
        return memory[state]

    memory = {}
    assert accepts(int(made["root"][0]), memory) == frozenset(entries)
    assert len(set(memory.values())) == len(made["ends"])
    alike = bpe.compile_transducer([(w, (7,)) for w in (b"baring", b"being", b"caring", b"seeing")])
    assert len(alike["ends"]) < len({w[:i] for w in (b"baring", b"being", b"caring", b"seeing") for i in range(8)})
    assert len(bpe.compile_transducer([])["keys"]) == 0


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    return bpe.encode(docs, PATH, bpe.build_lexicon(docs, PATH, **more), decoded=True).collect()


@pytest.mark.parametrize("most", [1, 40, 1 << 17])
def test_awkward_rows(spark, library, most):
    """The lexicon's size doesn't change ids; specials, capitals, combining marks, newer characters, very long words and texts."""
    rows = [*brute.awkward(9)]
    for i, t in enumerate(["<|endoftext|> A<|startoftext|>b <|END", "ΑΣ ΣΑΣ don't WE'LL", "é É İ İx", "Ᲊ Ɤ x\U00010d50y", "long word " * 150_000, "x" * 70_000, "日本語 한국 中文。", "  　\u0085 ", "ǅ ﬀ ½ ²"]):
        rows += [(900 + i, t, "en", "s", 1, None, None)] * 2
    got = run(spark, rows, most=most)
    assert brute.ordered([(r.doc_id, r.ids, r.decoded) for r in got]) == brute.ordered(want(library, rows))
    back = bpe.decode(spark.createDataFrame(got), PATH).collect()
    assert brute.ordered([(r.doc_id, r.text) for r in back]) == brute.ordered([(r.doc_id, r.decoded) for r in got])


def test_empty_table(spark):
    assert run(spark, []) == []


def test_whole_table(spark, library):
    d = "/root/testdata/sf0.01"
    rows = core.table(spark, d, "documents").select("doc_id", "text").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expect = [(i, len(ids), sha(" ".join(map(str, ids))), sha(text)) for i, ids, text in want(library, rows)]
    assert brute.ordered([tuple(r) for r in bpe.op11(spark, d).collect()]) == brute.ordered(expect)
