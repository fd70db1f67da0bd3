"""LM scoring: an interpolated modified Kneser-Ney bigram model over words.

Counted in Spark by rounds of packed messages, stored as sorted hash arrays in the shared folder, which
scoring workers memory-map. Words are 48-bit hashes.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

#: Bytes of text whose counts are summed before they are sent.
FLUSH = 6_000_000
#: Maps that a worker holds; beyond it they are made anew (the system allows some 65 000).
MAPS = 30_000
#: Hashes of what stands before a text's first word and after its last.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
U = np.uint64


def token_stream(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hashes of all tokens (words with A-Z lowered, then one end for each text), of those before them, and each text's first token."""
    start, end, first = core.words(buf, offs)
    words = core.word_hashes(core.LOWER[buf], start, end) >> U(16)
    n = len(offs) - 1
    at = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))
    begin = first + np.arange(n + 1)
    out = np.full(len(words) + n, END, np.uint64)
    out[at] = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[begin[:-1]] = START
    return out, before, begin


@dataclass
class Layout:
    """Where counts live: 2**bits buckets by the upper bits of the context, or of the pair for common contexts."""

    bits: int
    hot: np.ndarray  # ascending

    def bucket(self, word: np.ndarray) -> np.ndarray:
        return word >> U(48 - self.bits)

    def pair(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """64-bit hashes of pairs; the upper bits are the bucket."""
        h = core.mix(core.mix(before) + word)
        hot = _among(before, self.hot)
        top = np.where(hot, h >> U(64 - self.bits), self.bucket(before))
        return (top << U(64 - self.bits)) | (core.mix(h) >> U(self.bits))


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def pack_words(w: np.ndarray) -> bytes:
    return w.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_words(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(-1, 6)
    return out.view("<u8").ravel()


def pack_counts(c: np.ndarray) -> bytes:
    """A byte each; 255 stands for a count in the list that follows."""
    big = c >= 255
    return np.where(big, 255, c).astype(np.uint8).tobytes() + c[big].astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    out = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = np.frombuffer(data, "<u8", len(big), at + n)
    return out, at + n + 8 * len(big)


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ascending distinct keys, the first place of each, and the sums of values."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return (k[at], order[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values))


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Whole files only: a task that runs again replaces them by equal ones."""
    for k, v in arrays.items():
        tmp = f"{folder}/.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            np.save(f, v)
        os.replace(tmp, f"{folder}/{name}-{k}.npy")


def _send_pairs(layout: Layout, before: list[np.ndarray], word: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Messages with distinct pairs: contexts, followers of each, then followers and counts."""
    before, word = np.concatenate(before), np.concatenate(word)
    pair, one, n = _summed(layout.pair(before, word), np.ones(len(word), np.int64))
    bucket = pair >> U(64 - layout.bits)
    before, word = before[one], word[one]
    order = np.lexsort((before, bucket))
    bucket, before, word, n = bucket[order], before[order], word[order], n[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for i, j in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(bucket)].tolist(), strict=True):
        if j > i:
            b = before[i:j]
            at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            yield int(bucket[i]), len(at).to_bytes(4, "little") + (j - i).to_bytes(4, "little") + pack_words(b[at]) + pack_counts(np.diff(np.r_[at, j - i])) + pack_words(word[i:j]) + pack_counts(n[i:j])


def _read_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, n = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    contexts = unpack_words(data, k, 8)
    many, at = unpack_counts(data, k, 8 + 6 * k)
    word = unpack_words(data, n, at)
    return np.repeat(contexts, many), word, unpack_counts(data, n, at + 6 * n)[0]


def _kinds(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _context_stats(before: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ascending contexts, their totals, and how many followers have count 1, 2 and 3 or more."""
    k, _, *v = _summed(before, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64))
    return (k, *v)


def counted(docs: DataFrame, layout: Layout, folder: str) -> np.ndarray:
    """Write the model of docs (text) to folder; returns N, V, sum of types, kinds of pair counts (4) and of types (4)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, word = 0, [], []

        def flush() -> pa.RecordBatch:
            rows = list(_send_pairs(layout, before, word))
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])

        for batch in batches:
            for x in core.pieces(batch):
                buf, offs = core.column(x.column(0))
                w, b, _ = token_stream(buf, offs)
                word.append(w)
                before.append(b)
                held += len(buf) + 8 * x.num_rows
                if held >= FLUSH:
                    yield flush()
                    held, before, word = 0, [], []
        if word:
            yield flush()

    def contexts(t: pa.Table) -> pa.Table:
        """Of one bucket: its pairs' and contexts' files; then by followers' bucket how often each follows, and as how many types."""
        bucket = t.column("bucket")[0].as_py()
        got = [_read_pairs(d) for d in t.column("data").to_pylist()]
        before, word, n = (np.concatenate([g[i] for g in got]) for i in range(3))
        pair, one, n = _summed(layout.pair(before, word), n)
        before, word = before[one], word[one]
        rest = pair << U(layout.bits)
        starts = np.searchsorted(rest, np.arange(65536, dtype=np.uint64) << U(48))
        _save(folder, f"pair{bucket}", starts=np.r_[starts, len(rest)].astype("<u4"), rest=((rest >> U(16)) & U(0xFFFFFFFF)).astype("<u4"), count=np.minimum(n, 255).astype(np.uint8), big=np.stack([np.flatnonzero(n >= 255), n[n >= 255]]).astype("<i8"))
        hot = _among(before, layout.hot)
        k, total, n1, n2, n3 = _context_stats(before[~hot], n[~hot])
        _save(folder, f"context{bucket}", word=k, stats=np.stack([total, n1, n2, n3]).astype("<u8"))
        w, _, types, uses = _summed(word, np.ones(len(word), np.int64), n)
        to = layout.bucket(w)
        cuts = np.flatnonzero(np.diff(to)) + 1
        out = []
        for i, j in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(w)].tolist(), strict=True):
            if j > i:
                out.append((int(to[i]), 0, (j - i).to_bytes(4, "little") + pack_words(w[i:j]) + pack_counts(types[i:j]) + pack_counts(uses[i:j])))
        if hot.any():
            k, *stats = _context_stats(before[hot], n[hot])
            for i, b in enumerate(layout.bucket(k).tolist()):
                out.append((int(b), 1, np.array([k[i], *(s[i] for s in stats)], "<u8").tobytes()))
        out.append((bucket, 2, np.array(_kinds(n), "<i8").tobytes()))
        return pa.table({"bucket": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int64()), "data": pa.array([r[2] for r in out], pa.binary())})

    def words(t: pa.Table) -> pa.Table:
        """Of one bucket of words: their counts and types, and the contexts' stats of common ones."""
        bucket = t.column("bucket")[0].as_py()
        w, types, uses, hot, kinds = [], [], [], [], np.zeros(4, np.int64)
        for kind, d in zip(t.column("kind").to_pylist(), t.column("data").to_pylist(), strict=True):
            if kind == 0:
                n = int.from_bytes(d[:4], "little")
                w.append(unpack_words(d, n, 4))
                a, at = unpack_counts(d, n, 4 + 6 * n)
                types.append(a)
                uses.append(unpack_counts(d, n, at)[0])
            elif kind == 1:
                hot.append(np.frombuffer(d, "<u8"))
            else:
                kinds += np.frombuffer(d, "<i8")
        none = np.zeros(0, np.int64)
        k, _, types, uses = _summed(np.concatenate(w) if w else none.astype(np.uint64), np.concatenate(types) if w else none, np.concatenate(uses) if w else none)
        _save(folder, f"word{bucket}", word=k, types=types.astype("<u8"), uses=uses.astype("<u8"))
        if hot:
            h = np.array(hot)
            key, _, *stats = _summed(h[:, 0], *(h[:, i].astype(np.int64) for i in range(1, 5)))
            _save(folder, f"common{bucket}", word=key, stats=np.stack(stats).astype("<u8"))
        every = [int(uses.sum()), len(k), int(types.sum()), *kinds.tolist(), *_kinds(types)]
        return pa.table({f"x{i}": pa.array([v], pa.int64()) for i, v in enumerate(every)})

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    first = texts.mapInArrow(pairs, "bucket long, data binary").groupBy("bucket").applyInArrow(contexts, "bucket long, kind long, data binary")
    done = first.groupBy("bucket").applyInArrow(words, ", ".join(f"x{i} long" for i in range(11)))
    return np.array([x or 0 for x in done.agg(*(F.sum(f"x{i}") for i in range(11))).first()], np.int64)


def discounts(kinds) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    t = np.maximum(np.asarray(kinds, float), 1e-9)
    y = t[0] / (t[0] + 2 * t[1])
    d = [k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3)]
    plain = (0.5, 1.0, 1.5)
    return np.array([0.0, *(x if 0 < x < k else p for k, (x, p) in enumerate(zip(d, plain, strict=True), 1))])


@dataclass
class Model:
    """Folder and constants of a stored model; workers map its files when they first need them."""

    folder: str
    layout: Layout
    totals: np.ndarray

    def array(self, name: str) -> np.ndarray | None:
        key = f"{self.folder}/{name}.npy"
        if key not in _mapped:
            if len(_mapped) >= MAPS:
                _mapped.clear()
            _mapped[key] = _map(key) if os.path.exists(key) else None
        return _mapped[key]

    def look_up(self, table: str, values: tuple[str, ...], words: np.ndarray) -> list[np.ndarray]:
        """Values of ascending words, 0 where they aren't there. Values of one word may be a column of several."""
        buckets = self.layout.bucket(words).astype(np.int64)
        out: list = [None] * len(values)
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        for i, j in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(words)].tolist(), strict=True):
            keys = self.array(f"{table}{buckets[i]}-word") if j > i else None
            if keys is None or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, words[i:j]), len(keys) - 1)
            hit = keys[at] == words[i:j]
            for k, v in enumerate(values):
                got = self.array(f"{table}{buckets[i]}-{v}")[..., at] * hit
                if out[k] is None:
                    out[k] = np.zeros((*got.shape[:-1], len(words)), np.float64)
                out[k][..., i:j] += got
        return out

    def pair_counts(self, pair: np.ndarray) -> np.ndarray:
        """Counts of ascending pair hashes."""
        out = np.zeros(len(pair))
        bits = self.layout.bits
        bucket = (pair >> U(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for i, j in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(pair)].tolist(), strict=True):
            if j == i or (starts := self.array(f"pair{bucket[i]}-starts")) is None:
                continue
            rest, count, big = (self.array(f"pair{bucket[i]}-{x}") for x in ("rest", "count", "big"))
            own = pair[i:j] << U(bits)
            top = (own >> U(48)).astype(np.int64)
            want = ((own >> U(16)) & U(0xFFFFFFFF)).astype(np.uint32)
            lo, hi = starts[top].astype(np.int64), starts[top + 1].astype(np.int64)
            end = hi.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                less = np.zeros(len(lo), bool)
                less[open_] = rest[mid[open_]] < want[open_]
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            found = np.flatnonzero(lo < end)
            found = found[rest[lo[found]] == want[found]]
            n = count[lo[found]].astype(np.float64)
            if big.shape[1] and (n == 255).any():
                large = np.flatnonzero(n == 255)
                n[large] = big[1][np.searchsorted(big[0], lo[found[large]])]
            out[i + found] = n
        return out

    def score(self, buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
        """For each text its tokens, known tokens, base and model log10 probabilities."""
        token, before, begin = token_stream(buf, offs)
        n_all, v_all, t_all = (float(x) for x in self.totals[:3])
        pair_d, word_d = discounts(self.totals[3:7]), discounts(self.totals[7:11])
        words, which = np.unique(np.r_[token, before], return_inverse=True)
        is_token, is_before = which[: len(token)], which[len(token) :]
        uses, types = (x if x is not None else np.zeros(len(words)) for x in self.look_up("word", ("uses", "types"), words))
        none = np.zeros((4, len(words)))
        stats = [x if x is not None else none for x in (*self.look_up("context", ("stats",), words), *self.look_up("common", ("stats",), words))]
        total, *follow = stats[0] + stats[1]
        kept = sum(float(d) * float(k) for d, k in zip(word_d[1:3], self.totals[7:9], strict=True)) + float(word_d[3]) * max(0.0, v_all - float(self.totals[7] + self.totals[8]))
        if t_all:
            low = (types - word_d[np.minimum(types, 3).astype(np.int64)]) / t_all + kept / t_all / (v_all + 1)
        else:
            low = np.full(len(words), 1 / (v_all + 1))
        pair, inverse = np.unique(self.layout.pair(before, token), return_inverse=True)
        n = self.pair_counts(pair)[inverse]
        p = low[is_token]
        t = total[is_before]
        back = sum(d * f[is_before] for d, f in zip(pair_d[1:], follow, strict=True))
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(t > 0, (n - pair_d[np.minimum(n, 3).astype(np.int64)] + back * p) / t, p)
        base = np.log10((uses + 0.5) / (n_all + 0.5 * (v_all + 1)))
        cut = begin[:-1]
        sums = lambda v: np.add.reduceat(v, cut) if len(cut) else np.zeros(0)
        return {"n_tokens": np.diff(begin), "n_known": sums((uses > 0)[is_token].astype(np.int64)), "base_score": sums(base[is_token]), "score": sums(np.log10(p))}


_mapped: dict[str, np.ndarray | None] = {}


def _map(path: str) -> np.ndarray:
    """An array file, mapped; its descriptor is closed, so a model may have more files than a process may open."""
    with open(path, "rb") as f:
        np.lib.format.read_magic(f)
        shape, _, kind = np.lib.format.read_array_header_1_0(f)
        n = int(np.prod(shape))
        if not n:
            return np.zeros(shape, kind)
        try:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        except TypeError:  # before Python 3.13 a map keeps a descriptor
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        return np.frombuffer(held, kind, n, f.tell()).reshape(shape)


def train(docs: DataFrame) -> Model:
    """A model of docs (text): one job counts, sums and stores it."""
    spark = docs.sparkSession
    core.ship(spark)
    rows, total = core.sizes(docs)
    bits = min(24, max(4, (core.parts(total, core.BUCKET_BYTES) - 1).bit_length()))
    least = 4 << min(bits, 16)  # a context of more than 1 / least of all tokens is common: a bucket of contexts would be uneven

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in core.pieces(batch):
                w, n = np.unique(token_stream(*core.column(x.column(0)))[1], return_counts=True)
                # half as common in this piece at least: pieces where a common context is rarer hold less than half of it
                top = np.flatnonzero(2 * least * n > n.sum())
                yield pa.record_batch([pa.array([*w[top].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[top].tolist(), int(n.sum())], pa.int64())], ["word", "n"])

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    seen = core.kept(texts.mapInArrow(frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    every = (seen.where("word IS NULL").first() or {"n": 0})["n"] if rows else 0
    common = seen.where("word IS NOT NULL").where(F.col("n") * (2 * least) > every).select("word")  # 2 * least words at most
    hot = np.sort(np.array([r.word for r in common.collect()], np.int64).view(np.uint64))
    folder = core.model_folder(spark, "lm")
    layout = Layout(bits, hot)
    return Model(folder, layout, counted(docs, layout, folder))


ARROW = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in core.pieces(batch, most=2 * core.BATCH_BYTES):
                got = model.score(*core.column(x.column(1)))
                yield pa.record_batch([x.column(0), *(pa.array(got[n], kind) for n, kind in ARROW[1:])], [n for n, _ in ARROW])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of docs.

    The model learns from the rows whose fold (crc32 of doc_id's text modulo 5; of the empty text where it is null) isn't
    `held_out`. docs needs doc_id and text; other columns are ignored. Null and empty texts have one token, the end. Repeated
    rows count and are scored each. With no training rows every token has probability 1 / (V + 1) = 1.
    """
    model = train(docs.where(core.fold() != held_out))
    rows = scored(docs, model)
    return rows.select(
        "doc_id", (core.fold() == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(int(model.totals[0])).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(core.table(spark, sf_dir, "documents"))
