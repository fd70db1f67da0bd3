"""BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

Spark counts the words of all documents. Those that are frequent are merged once, on executors, and compiled into a
transducer whose states share prefixes and suffixes and whose arcs carry the ids as early as they are certain. Its arrays
are files in the shared folder, which workers map. Words that it doesn't hold are merged exactly, pair by pair.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

#: A word is frequent if it is at least this part of all words (and seen twice), so no more than LEXICON words are; longer words than LONGEST bytes never are.
LEXICON, LONGEST = 1 << 17, 64
#: Entries of a worker's table of counts before it is emptied.
ENTRIES = 1 << 16
#: The rank of pairs that don't merge.
NEVER = np.int32((1 << 31) - 1)
#: Characters that are taken at once; longer texts are cut at spaces, which no word and no composed character spans.
CHUNK = 1 << 20
#: Characters on which a test holds `regex` and `unicodedata` to be equal to the tokenizer's own normalizer and classes. Texts with others go through those.
PROVED = regex.compile(r"[^\u0000-\u052f\u1e00-\u1fff\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u2190-\u23ff\u2500-\u27bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff01-\uff5e]")


class Vocabulary:
    """A tokenizer file of word-end BPE: its words, merges, ids and tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        model, split = got["model"], got["pre_tokenizer"]["pretokenizers"][0]
        steps = [x["type"] for x in got["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError(f"not a file of lower-cased word-end BPE: {path}")
        self.path, self.end, self.library = path, model["end_of_word_suffix"], None
        self.word = regex.compile(split["pattern"]["Regex"])
        self.added = {x["content"]: x["id"] for x in got["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        vocab = model["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.inner, self.last = [vocab[chars[b]] for b in range(256)], [vocab[chars[b] + self.end] for b in range(256)]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        pairs = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.made = np.array([new for _, new in self.merges.values()], np.int32)
        self.letters = np.array([self.inner, self.last], np.int32)
        tokens = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in (vocab | self.added).items():
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.string())

    def words(self, text: str) -> list[str]:
        """Normalised words in order; added tokens' strings are words of their own."""
        if self.special is None or "<" not in text:
            return self._plain(text)
        out = []
        for i, x in enumerate(self.special.split(text)):
            out += [x] if i % 2 else self._plain(x)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.word.findall(text.lower())
        if not PROVED.search(text):
            return self.word.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.library is None:
            from tokenizers import Tokenizer, pre_tokenizers

            own = Tokenizer.from_file(self.path)
            self.library = own.normalizer, pre_tokenizers.Split(pattern_of(self.path), "removed", invert=True)
        normal, split = self.library
        return [x for x, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: always the pair of lowest rank, the leftmost of equals, is merged."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > 48:
            return self._merge_long(ids)
        merges = self.merges
        while len(ids) > 1:
            best = min(((*got, i) for i in range(len(ids) - 1) if (got := merges.get((ids[i], ids[i + 1])))), key=lambda x: (x[0], x[2]), default=None)
            if best is None:
                break
            ids[best[2] : best[2] + 2] = [best[1]]
        return ids

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, NEVER where they don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NEVER)

    def merge_many(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids in order: `merge` on all words at once, one pair of each in a step."""
        size = np.diff(offs)
        word, ids = np.arange(len(size)), self.letters[0][buf]
        ids[offs[1:] - 1] = self.letters[1][buf[offs[1:] - 1]]
        rank = np.append(self.rank(ids[:-1], ids[1:]), NEVER).astype(np.int32)
        rank[offs[1:] - 1] = NEVER
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, first)
            live = best < NEVER
            if not live.all():
                keep = np.repeat(live, size)
                done.append((word[~live], size[~live], ids[~keep]))
                word, size, best, ids, rank = word[live], size[live], best[live], ids[keep], rank[keep]
                if not len(word):
                    break
            of = np.repeat(np.arange(len(word)), size)
            hit = np.flatnonzero(rank == best[of])
            at = hit[np.r_[True, of[hit[1:]] != of[hit[:-1]]]]  # the leftmost of each word
            ids[at] = self.made[best]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            rank[at] = NEVER
            more = at[np.append(of, -1)[at + 2] == of[at]]
            rank[more] = self.rank(ids[more], ids[more + 2])
            less = at[(at > 0) & (of[at - 1] == of[at])]
            rank[less - 1] = self.rank(ids[less - 1], ids[less])
            ids, rank, size = ids[keep], rank[keep], size - 1
        if not done:
            return size, ids
        word, size, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word)
        start = np.cumsum(size) - size
        return size[order], ids[ragged(start[order], size[order])]

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before, live = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        heap = [(got[0], i, ids[i], ids[i + 1], got[1]) for i in range(n - 1) if (got := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (got := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (got[0], x, ids[x], ids[y], got[1]))
        return [x for x, alive in zip(ids, live, strict=True) if alive]


def pattern_of(path: str):
    from tokenizers import Regex

    with open(path, encoding="utf-8") as f:
        return Regex(json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def compile_transducer(entries: list[tuple[bytes, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The minimal acyclic subsequential transducer of words in ascending order with their ids, as arrays.

    A state is frozen when no later word can pass it; states that accept the same rest with the same ids become one.
    An arc's ids are those that all words through it begin with, less what earlier arcs gave.
    arcs: keys ascending (state * 256 + byte), target, at and size of its ids in `pool`. states: final, at and size of the last ids.
    """
    frozen: dict[tuple, int] = {}
    states: list[tuple] = []

    def freeze(node: list) -> int:
        key = (node[1], node[2], tuple((c, t, out) for c, (t, out) in sorted(node[0].items())))
        if key not in frozen:
            frozen[key] = len(states)
            states.append(key)
        return frozen[key]

    fresh = lambda: [{}, False, ()]  # arcs, final, last ids
    path, last = [fresh()], b""

    def close(depth: int) -> None:
        for i in range(len(path) - 1, depth, -1):
            arc = path[i - 1][0][last[i - 1]]
            arc[0] = freeze(path.pop())

    for word, ids in entries:
        if word <= last:
            raise ValueError("words must ascend, each once, and none be empty")
        shared, out = common(last, word), tuple(ids)
        close(shared)
        for i in range(shared):
            arc, node = path[i][0][word[i]], path[i + 1]
            k = common(arc[1], out)
            rest, arc[1], out = arc[1][k:], arc[1][:k], out[k:]
            if rest:
                for other in node[0].values():
                    other[1] = rest + other[1]
                if node[1]:
                    node[2] = rest + node[2]
        for i in range(shared, len(word)):
            path[i][0][word[i]] = [-1, out]
            path.append(fresh())
            out = ()
        path[-1][1], path[-1][2] = True, out
        last = word
    close(0)
    root = freeze(path[0])
    pool: dict[tuple, int] = {(): 0}
    flat: list[int] = []
    for _, end, arcs in states:
        for ids in (end, *(out for _, _, out in arcs)):
            if ids not in pool:
                pool[ids] = len(flat)
                flat += ids
    rows = [(s * 256 + c, t, pool[out], len(out)) for s, (_, _, arcs) in enumerate(states) for c, t, out in arcs]
    arcs = np.array(rows, np.int64).reshape(-1, 4)
    ends = np.array([(final, pool[end], len(end)) for final, end, _ in states], np.int64).reshape(-1, 3)
    return {"keys": arcs[:, 0].copy(), "arcs": arcs[:, 1:].astype(np.int32), "ends": ends.astype(np.int32), "pool": np.array(flat, np.int32), "root": np.array([root], np.int64)}


class Lexicon:
    """A compiled transducer whose files are mapped; looks up many words at once."""

    def __init__(self, folder: str):
        self.keys, self.arcs, self.ends, self.pool, self.root = (np.load(f"{folder}/{x}.npy", mmap_mode="r") for x in ("keys", "arcs", "ends", "pool", "root"))

    def find(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words it holds, and their ids: offsets (one more than words) and values."""
        size = np.diff(offs)
        state, live = np.full(len(size), self.root[0]), (size <= LONGEST) & (size > 0) & (len(self.keys) > 0)
        words, at, n = [], [], []
        for step in range(int(size[live].max(initial=0))):
            on = np.flatnonzero(live & (size > step))
            key = state[on] * 256 + buf[offs[on] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            live[on[~hit]] = False
            on, got = on[hit], self.arcs[arc[hit]]
            state[on] = got[:, 0]
            gives = got[:, 2] > 0
            words.append(on[gives]), at.append(got[gives, 1]), n.append(got[gives, 2])
        on = np.flatnonzero(live)
        end = self.ends[state[on]]
        live[on[end[:, 0] == 0]] = False
        gives = (end[:, 0] == 1) & (end[:, 2] > 0)
        words.append(on[gives]), at.append(end[gives, 1]), n.append(end[gives, 2])
        words, at, n = np.concatenate(words), np.concatenate(at).astype(np.int64), np.concatenate(n).astype(np.int64)
        keep = live[words]
        words, at, n = words[keep], at[keep], n[keep]
        order = np.argsort(words, kind="stable")
        words, at, n = words[order], at[order], n[order]
        counts = np.bincount(words, weights=n, minlength=len(size)).astype(np.int64)
        return live, np.r_[0, np.cumsum(counts)], self.pool[ragged(at, n)]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 ... of size[0], then the next run."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def chunks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > CHUNK:
        to = text.find(" ", at + CHUNK)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) of all words of at most LONGEST bytes that are seen twice or more; the null word has the count of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.frugal()
        v, seen, total = vocabulary(path), Counter(), 0
        table = lambda rows: pa.record_batch([pa.array([k for k, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for chunk in chunks(text):
                    words = v.words(chunk)
                    total += len(words)
                    seen.update(words)
                    if len(seen) > ENTRIES:
                        yield table([(b, n) for k, n in seen.items() if k not in v.added and len(b := k.encode()) <= LONGEST])
                        seen.clear()
        yield table([(None, total), *((b, n) for k, n in seen.items() if k not in v.added and len(b := k.encode()) <= LONGEST)])

    texts = docs.where(F.length("text") > 0).select("text")
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > 1)


def build_lexicon(docs: DataFrame, path: str, most: int = LEXICON) -> str:
    """Count, merge and compile the frequent words of docs; the folder of the transducer's files, in the shared folder.

    What the driver collects is bounded: `most` words of LONGEST bytes at most, whose counts are each at least a `most`-th
    of all. The lexicon only saves time: ids don't depend on it.
    """
    spark = docs.sparkSession
    core.ship(spark)
    counts = core.kept(count_words(docs, path))
    total = (counts.where(F.col("word").isNull()).first() or [None, 0])[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            if words:
                size, ids = v.merge_many(*core.column(batch.column(0)))
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(ids))], ["word", "ids"])

    frequent = counts.where(F.col("word").isNotNull() & (F.col("n") >= -(-total // most))).select("word").mapInArrow(run, "word binary, ids array<int>")
    entries = sorted((bytes(w), tuple(ids)) for w, ids in frequent.collect())
    folder = core.model_folder(spark, "lexicon")
    for name, array in compile_transducer(entries).items():
        np.save(f"{folder}/{name}.npy", array)
    return folder


class Coder:
    """In a worker: words to ids by the lexicon, and by merging where it doesn't hold them."""

    def __init__(self, path: str, folder: str | None):
        self.vocabulary, self.lexicon = vocabulary(path), Lexicon(folder) if folder else None

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each word has."""
        coded = pa.array(words, pa.string()).dictionary_encode()
        own, index = coded.dictionary, coded.indices.to_numpy()
        buf, offs = core.column(own)
        if self.lexicon:
            held, first, values = self.lexicon.find(buf, offs)
        else:
            held, first, values = np.zeros(len(own), bool), np.zeros(len(own) + 1, np.int64), np.zeros(0, np.int32)
        size, start, at = np.diff(first), first[:-1].copy(), len(values)
        values, long = [values], (np.diff(offs) > LONGEST) & ~held
        rest = np.flatnonzero(~held & ~long)
        if self.vocabulary.added:
            named = pc.is_in(own, value_set=pa.array(list(self.vocabulary.added))).to_numpy(zero_copy_only=False)
            rest, long = rest[~named[rest]], long | named
        if len(rest):
            n = offs[rest + 1] - offs[rest]
            size[rest], got = self.vocabulary.merge_many(buf[ragged(offs[rest], n)], np.r_[0, np.cumsum(n)])
            start[rest] = at + np.cumsum(size[rest]) - size[rest]
            values.append(got)
            at += len(got)
        for i in np.flatnonzero(long).tolist():
            word = own[i].as_py()
            got = [self.vocabulary.added[word]] if word in self.vocabulary.added else self.vocabulary.merge(word.encode())
            start[i], size[i] = at, len(got)
            values.append(np.array(got, np.int32))
            at += len(got)
        values = np.concatenate(values)
        return values[ragged(start[index], size[index])], size[index]


def encode(docs: DataFrame, path: str, folder: str | None, decoded: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, ids) of every text, and where `decoded` the text of those ids, tokens joined by one space as the library's decode gives it.

    ids are those of the `tokenizers` library for the file at `path`, without special tokens added; their strings in texts are
    their ids, as by its default call. A null or empty text has no ids and decodes to the empty text. Repeated rows come back each.
    Other columns are ignored. Texts of any length are whole, cut at spaces while they are worked on. An empty table gives none.
    """
    core.ship(docs.sparkSession)
    rows = docs.select(F.col(key), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def flat(coder: Coder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts and offsets, by groups of CHUNK characters."""
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        words: list[str] = []
        owner: list[tuple[int, int]] = []

        def flush() -> None:
            got, size = coder.ids(words)
            ends = np.r_[0, np.cumsum(size)]
            ids.append(got)
            at = 0
            for i, n in owner:
                counts[i] += ends[at + n] - ends[at]
                at += n
            words.clear(), owner.clear()

        held = 0
        for i, text in enumerate(texts):
            for chunk in chunks(text):
                got = coder.vocabulary.words(chunk)
                words.extend(got)
                owner.append((i, len(got)))
                held += len(chunk)
                if held > CHUNK:
                    flush()
                    held = 0
        flush()
        return np.concatenate(ids), np.r_[0, np.cumsum(counts)].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.frugal()
        coder = Coder(path, folder)
        for batch in batches:
            for piece in core.pieces(batch, "text"):
                ids, offs = flat(coder, piece.column(1).to_pylist())
                out = [piece.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(ids))]
                if decoded:
                    out.append(decode_ids(coder.vocabulary, out[1]))
                yield pa.record_batch(out, names)

    names = [key, "ids", *(["decoded"] if decoded else [])]
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def decode_ids(v: Vocabulary, ids: pa.ListArray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, v.tokens.take(ids.values)), " ")


def decode(rows: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows (key, ids): the tokens joined by one space. Null ids are none."""
    core.ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([x or [] for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), decode_ids(vocabulary(path), ids)], [key, "text"])

    return rows.select(key, F.col("ids").cast("array<int>")).mapInArrow(run, f"`{key}` {kind}, text string")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = core.table(spark, sf_dir, "documents"), word_vocabulary()
    coded = encode(docs, path, build_lexicon(docs, path), decoded=True)
    digest = lambda c: F.sha2(c, 256)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )
