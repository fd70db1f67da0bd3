"""SimHash near-dedup: Golay-code fuzzy keys on segment pairs, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core
from .components import components

#: Words in a shingle, and differing bits of linked fingerprints at most.
SHINGLE, BITS = 3, 3
#: Fingerprints of one key beyond which those that agree in three of six parts alone are compared.
DENSE = 256
#: (first bit, bits) of the segments; the last is a shortened codeword.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: The binary Golay code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
_made: dict = {}


def _remainder(x: int) -> int:
    for i in range(22, 10, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - 11)
    return x


def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of a word's lower 12 and upper 11 bits; for each syndrome the error patterns to near codewords, and how many.

    The code is perfect: a word is within 3 bits of exactly one codeword. Words that differ in one bit decode to
    one codeword, or one of them stands 3 from its own and 4 from the other's. So the keys of a word are its
    codeword and, where that is 3 away, the five codewords 4 away.
    """
    if not _made:
        unit = [_remainder(1 << i) for i in range(23)]

        def table(lo: int, n: int) -> np.ndarray:
            t = np.zeros(1 << n, np.int32)
            for i in range(n):
                t[1 << i : 2 << i] = t[: 1 << i] ^ unit[lo + i]
            return t

        patterns: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for at in combinations(range(23), weight):
                s = 0
                for i in at:
                    s ^= unit[i]
                if weight < 4 or patterns[s] and patterns[s][0].bit_count() == 3:
                    patterns[s].append(sum(1 << i for i in at))
        many = np.array([len(p) for p in patterns])
        near = np.array([p + [0] * (6 - len(p)) for p in patterns], np.int32)
        _made["t"] = table(0, 12), table(12, 11), near, many
    return _made["t"]


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which word, codeword index of 12 bits) for every key of 23-bit words."""
    low, high, near, many = golay()
    s = low[segment & 4095] ^ high[segment >> 12]
    n = many[s]
    which = np.repeat(np.arange(len(segment)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, (segment[which] ^ near[s[which], k]) >> 11


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, 26-bit key): for each pair of segments the pairs of their codewords.

    With three errors or fewer, leaving out the segment with most of them leaves at most one in each of the others.
    """
    word = [((prints >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    coded = [codewords(w) for w in word]
    starts = [np.searchsorted(c[0], np.arange(len(prints) + 1)) for c in coded]
    whose, out = [], []
    for table, (i, j) in enumerate(combinations(range(3), 2)):
        many = np.diff(starts[j])[coded[i][0]]  # for each key of i, the keys of j of the same fingerprint
        which = np.repeat(coded[i][0], many)
        k = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        whose.append(which)
        out.append((table << 24) | (np.repeat(coded[i][1], many) << 12) | coded[j][1][starts[j][which] + k])
    return np.concatenate(whose), np.concatenate(out)


def fingerprint(text: bytes, size: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, A-Z lowered; no words: 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length) - 1
    start = end - length + 1
    n = max(1, len(words) - size + 1)
    last = end[size - 1 :] if len(words) >= size else end[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        a, b = start[i : min(n, i + (1 << 16))].tolist(), last[i : i + (1 << 16)].tolist()
        h = np.array([digest(flat[x:y], 42) for x, y in zip(a, b, strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


_LOWER = core.LOWER.tobytes()


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, print) of every row; print is the fingerprint's bits as a long. Null texts are as empty ones."""
    core.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x, size) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, print long")


def _linked(prints: np.ndarray, code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints sorted by key: each that links to another of its key, and the smallest of its component here.

    Fingerprints of one key are compared all with all where they are few. Of more than DENSE, two that differ in 3 bits
    or fewer agree in at least three of six parts of their 64 bits: only those that do, in one of the 20 choices, are compared.
    """
    nodes, which = np.unique(prints, return_inverse=True)
    label = np.arange(len(nodes))

    def compare(rows: np.ndarray, run: np.ndarray) -> None:
        """Merge what is near among rows of one run, by ascending runs."""
        nonlocal label
        i, shift = np.arange(len(rows)), 1
        while len(i := i[i + shift < len(rows)]) and len(i := i[run[i] == run[i + shift]]):
            x, y = rows[i], rows[i + shift]
            near = np.bitwise_count(prints[x] ^ prints[y]) <= bits
            a, b = label[which[x[near]]], label[which[y[near]]]
            if (apart := a != b).any():
                pairs = np.unique(np.stack([a[apart], b[apart]]), axis=1)
                label = _merge(label, pairs[0], pairs[1])
            shift += 1

    cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[cuts, len(code)])
    dense = np.repeat(sizes > DENSE, sizes)
    few = np.flatnonzero(~dense)
    compare(few, code[few])
    for first in cuts[sizes > DENSE].tolist():
        own = first + np.unique(prints[first : first + int(sizes[np.searchsorted(cuts, first)])], return_index=True)[1]
        for mask in _choices():
            part = prints[own] & mask
            order = np.argsort(part, kind="stable")
            compare(own[order], part[order])
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _choices() -> list[np.uint64]:
    """Masks of three of six parts of 64 bits, all 20."""
    edges = [round(64 * k / 6) for k in range(7)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [np.uint64(sum(some)) for some in combinations(parts, 3)]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def links(distinct: DataFrame, rows: int, bits: int = BITS) -> DataFrame:
    """(a, b): for distinct fingerprints (print) links that connect what differs in `bits` (3 at most) or fewer.

    In a bucket fingerprints of one key are compared (_linked); what leaves the bucket is one
    link for each fingerprint at most, not all pairs.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the keys find differences of 3 bits at most")
    buckets = core.parts(rows * 84 * 12, core.BUCKET_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 10_000):
                prints = every[at : at + 10_000]
                which, code = keys(prints)
                bucket = (core.mix(code.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, code, own = bucket[order], code[order].astype("<u4"), prints[which[order]]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                spans = list(zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(code)].tolist(), strict=True)) if len(code) else []
                yield pa.record_batch([pa.array(bucket[[i for i, _ in spans]] if spans else [], pa.int64()), pa.array([own[i:j].tobytes() + code[i:j].tobytes() for i, j in spans], pa.binary())], ["bucket", "data"])

    def compare(t: pa.Table) -> pa.Table:
        data = t.column("data").to_pylist()
        prints = np.concatenate([np.frombuffer(d, "<u8", len(d) // 12) for d in data])
        code = np.concatenate([np.frombuffer(d, "<u4", len(d) // 12, len(d) // 12 * 8) for d in data])
        order = np.argsort(code, kind="stable")
        a, b = _linked(prints[order], code[order], bits)
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    return distinct.select("print").mapInArrow(deal, "bucket long, data binary").groupBy("bucket").applyInArrow(compare, "a long, b long")


def simhash_dedup(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, print, component_id) for every row of docs: component_id is the smallest doc_id that links reach.

    docs needs doc_id and text; other columns are ignored. Null, empty and blank texts have print 0 and are linked like any
    other. Repeated rows have equal prints, so one component; a null doc_id is never a component_id unless no other is
    there (then null). An empty table gives an empty result. Equal prints meet in an aggregation first, so a group of
    exact copies is one row afterwards.
    """
    prints = core.kept(fingerprints(docs, size))
    distinct = core.kept(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    labels = components(links(distinct, distinct.count(), bits)).withColumnRenamed("node", "print")
    linked = distinct.join(labels, "print")
    least = linked.groupBy("label").agg(F.min("least").alias("component"))
    of_print = distinct.join(linked.join(least, "label").select("print", "component"), "print", "left").select("print", "n", F.coalesce("component", "least").alias("component_id"))
    of_print = core.kept(of_print)
    # prints of over a thousandth of the rows are fewer than a thousand: broadcast, so a large group of copies isn't gathered by its print
    total = distinct.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") > max(1, total // 1000)
    found = of_print.where(common).select(F.col("print").alias("_print"), "component_id")
    tagged = prints.join(F.broadcast(found), F.col("print") == F.col("_print"), "left")
    rest = tagged.where("_print IS NULL").select("doc_id", "print").join(of_print.where(~common), "print")
    return tagged.where("_print IS NOT NULL").select("doc_id", "print", "component_id").unionByName(rest.select("doc_id", "print", "component_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(core.table(spark, sf_dir, "documents")).selectExpr("doc_id", "lpad(lower(hex(print)), 16, '0') AS fingerprint", "component_id")
