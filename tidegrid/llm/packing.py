"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import core

#: Tokens in a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
#: Pieces that one group numbers, about.
GROUP = 2_000
#: The byte-level pre-tokenizer's pattern of this kind of vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: tiktoken panics on whitespace runs of about a million characters; texts with runs of so many go to tokenizers.
LONG_RUN = re.compile(r"\s{100000}")
#: Tests hold both libraries' ids to be equal on all characters below this one; texts with later ones go to tokenizers.
UNPROVED = "\U00020000"
_encoders: dict = {}
_tokenizers: dict = {}


def encoder(path: str):
    """The vocabulary of a byte-level BPE file of `tokenizers`, run by tiktoken: the same ids, several times faster.

    Such files print bytes as characters: those of Latin-1 that can be printed as themselves, the others in order from 256.
    """
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {x["content"]: x["id"] for x in got.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in got["model"]["vocab"].items() if token not in special}
        _encoders[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def ids_of(path: str, special: bool):
    """A function of a text: its ids, those of added tokens' strings where `special`; else such strings are ordinary text."""
    fast = encoder(path)
    added = sorted(fast.special_tokens_set) if special else []

    def encode(text: str) -> list[int]:
        if (len(text) >= 100_000 and LONG_RUN.search(text)) or not (text.isascii() or max(text) < UNPROVED):
            if (path, special) not in _tokenizers:
                from tokenizers import Tokenizer

                _tokenizers[path, special] = Tokenizer.from_file(path)
                _tokenizers[path, special].encode_special_tokens = not special
            return _tokenizers[path, special].encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all") if any(x in text for x in added) else fast.encode_ordinary(text)

    return encode


class Open:
    """Counts of open bins by remaining capacity in a segment tree; finds the tightest that fits in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        self.runs.setdefault(room, []).append((first, count))
        self._change(room, count)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """A run of at most `most` bins with this room: first bin and count."""
        first, count = self.runs[room].pop()
        n = min(count, most)
        if n < count:
            self.runs[room].append((first + n, count - n))
        self._change(room, -n)
        return first, n

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest room of an open bin that is at least `need`."""
        at = need + self.size
        if self.tree[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] pieces: (length, first rank, end rank, first bin, offset).

    Pieces of one length are alike, so bins with one content move together: the work depends on the number of
    lengths, not of pieces. New bins open only where no open bin fits.
    """
    bins, out, used = Open(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            room = bins.tightest(length)
            if room is None:
                more = max(1, (n - rank) // (capacity // length))
                bins.add(capacity, used, more)
                used += more
                room = capacity
            # the bin just used is the tightest for the next equal piece, until none fits: so each gets as many as it holds
            each = min(room // length, n - rank)
            first, k = bins.take(room, (n - rank) // each)
            for i in range(each):
                out.append((length, rank, rank + k, first, capacity - room + i * length))
                rank += k
            if room > each * length:
                bins.add(room - each * length, first, k)
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, special: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the end id; longer ones are cut, the first piece shorter."""
    core.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path, special)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), end], "<u4")
                at, k = 0, 0
                while at < len(ids):
                    to = at + ((len(ids) - at - 1) % capacity + 1)  # the rest is a multiple of the capacity
                    for v, x in zip(out, (doc, k, at, to - at, zlib.crc32(ids[at:to].tobytes())), strict=True):
                        v.append(x)
                    at, k = to, k + 1
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(v, pa.int64()) for v in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(rows: DataFrame) -> DataFrame:
    """rows with `rank`, from 0 among those of one length. Lengths are numbered in groups by a hash, so a common one is split."""
    groups = core.parts(rows.count(), GROUP, 256)
    keyed = rows.withColumn("k", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counted = keyed.groupBy("length", "k").agg(F.count(F.lit(1)).alias("n"))
    before = counted.select("length", "k", (F.sum("n").over(Window.partitionBy("length").orderBy("k")) - F.col("n")).alias("before"))
    own = keyed.withColumn("own", F.row_number().over(Window.partitionBy("length", "k").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    return own.join(before, ["length", "k"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before", "k")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, special: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place in sequences of at most `capacity` ids.

    docs needs doc_id and text; other columns are ignored. A null or empty text is the end id alone. Repeated rows are packed
    each. An empty table gives an empty result. Added tokens' strings have their ids where `special`, as by the tokenizer's
    default call, and are ordinary text otherwise. What reaches the
    driver is the count of pieces of each length, `capacity` numbers at most; what it broadcasts are the
    runs of bins that best_fit makes of them, bounded by the capacity too.
    """
    spark = docs.sparkSession
    rows = core.kept(pieces(docs, path, capacity, end, special))
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    runs = best_fit(counts, capacity)
    table = spark.createDataFrame(pa.table({n: pa.array([r[i] for r in runs], pa.int64()) for i, n in enumerate(("_length", "_from", "_to", "_bin", "offset"))}))
    own = ranked(rows)
    placed = own.join(F.broadcast(table), (own["length"] == table["_length"]) & (own["rank"] >= table["_from"]) & (own["rank"] < table["_to"]))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_bin") + F.col("rank") - F.col("_from")).alias("sequence_id"), "offset")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(core.table(spark, sf_dir, "documents"), vocabulary())
