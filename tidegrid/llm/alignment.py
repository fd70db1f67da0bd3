"""Cross-tokenizer alignment: how two tokenizers' ids line up in the same bytes, counted over a corpus.

A task encodes its documents by both tokenizers, cuts them where tokens of both end, and sends its links to stripes of the
second tokenizer's ids: link by link they are summed before, so a stripe gets one row a batch of documents, however often a
pair is in it. A stripe is a dense block of counts (its own ids by all ids of the other side) that np.add.at fills; the
maxima of its rows are the best partners. Counts are merged by stripe in rounds of bounded groups. Scores are made where the
links are, by stripe: links and counts meet there, and only sums for each document go back to its batch.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core, packing

#: Characters that a tokenizer gets at once; longer texts are cut before a space between words, where no token of either side spans.
CHUNK = 1 << 20


class Limits(NamedTuple):
    """What tasks hold at most; results don't depend on it."""

    #: Cells of a stripe's block of counts, and bytes of text of a batch.
    cells: int = 3_200_000
    batch: int = core.BATCH_BYTES
    #: Batches whose links one task counts, partial counts that one task merges, and batches that one task scores.
    counted: int = 256
    merged: int = 32
    scored: int = 8192


class Bytes:
    """A byte-level BPE file: ids of texts that begin with a space, and the bytes of each id."""

    def __init__(self, path: str):
        own = packing.encoder(path)
        self.ids = packing.ids_of(path, False)
        self.tokens = [own.decode_single_token_bytes(i) if i not in set(own._special_tokens.values()) else own.decode([i]).encode() for i in range(own.n_vocab)]

    def encode(self, text: str) -> list[int]:
        return self.ids(text)


class Pieces:
    """A sentencepiece file that puts a space before texts; `encode` takes texts with it."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = []
        for i in range(self.own.get_piece_size()):
            piece = self.own.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:-1], 16)]) if self.own.is_byte(i) else piece.replace("▁", " ").encode())
        #: Whether some piece goes on after a space, so that texts can't be cut at spaces.
        self.spans = any(b" " in x.lstrip(b" ") for x in self.tokens)

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text[1:], num_threads=1)


_sides: dict[tuple[type, str], Bytes | Pieces] = {}


def side(kind: type, path: str):
    if (kind, path) not in _sides:
        _sides[kind, path] = kind(path)
    return _sides[kind, path]


def chunks(text: str) -> Iterator[str]:
    """Parts of a text, each but the first with the space before a word that follows another."""
    at = 0
    while len(text) - at > CHUNK:
        to = text.find(" ", at + CHUNK)
        while to > 0 and not (text[to - 1].isalnum() and text[to + 1 : to + 2].isalpha()):
            to = text.find(" ", to + 1)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:] if at else text


class Aligner:
    """In a worker: tokens of both sides, their lengths, and their ids as text."""

    def __init__(self, a_path: str, b_path: str, cells: int = Limits().cells):
        self.a, self.b = side(Bytes, a_path), side(Pieces, b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in s.tokens], np.int64) for s in (self.a, self.b))
        if not (self.a_size.all() and self.b_size.all()):
            raise ValueError("a token of no bytes would end where another does")
        spelled = lambda n, ends: np.array([[f"{i}{e}" for i in range(n)] for e in ends], object)
        self.a_text, self.b_text = spelled(len(self.a_size), ",|"), spelled(len(self.b_size), ",;")
        self.stripes, self.rows = layout(len(self.a_size), len(self.b_size), cells)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or nothing where their bytes aren't the text's."""
        text, a, b = " " + text, [], []
        for part in [text] if self.b.spans else chunks(text):
            own, other, want = np.array(self.a.encode(part), np.int64), self.b.encode(part), part.encode()
            # the first side's ids are those of the text's own bytes, so their length says all; the second side normalises
            if b"".join([self.b.tokens[i] for i in other]) != want or self.a_size[own].sum() != len(want):
                return None
            a.append(own)
            b.append(np.array(other, np.int64))
        return np.concatenate(a), np.concatenate(b)


def layout(n_a: int, n_b: int, cells: int) -> tuple[int, int]:
    """The number of stripes, and the ids of the second side in each: id b is row b // stripes of stripe b % stripes."""
    rows = max(1, cells // n_a)
    return -(-n_b // rows), rows


def put(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, each in the narrowest type that holds it."""
    kinds = [np.dtype(np.min_scalar_type(int(x.max(initial=0)))) for x in arrays]
    return struct.pack("<I", len(arrays[0])) + bytes(k.itemsize for k in kinds) + b"".join(x.astype(k.newbyteorder("<")).tobytes() for x, k in zip(arrays, kinds, strict=True))


def take(data: bytes, count: int) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", data), 4 + count, []
    for width in data[4 : 4 + count]:
        out.append(np.frombuffer(data, f"<u{width}", n, at).astype(np.int64))
        at += n * width
    return out


def links_of(own: Aligner, texts: list[str | None]):
    """For each text n_a, n_b, n_groups and its groups' text, and all links as (document, id, id)."""
    found = [(i, got) for i, t in enumerate(texts) if t and (got := own.tokens(t))]
    counts, spelled = np.zeros((3, len(texts)), np.int64), [""] * len(texts)
    if not found:
        none = np.zeros(0, np.int64)
        return counts, spelled, (none, none, none)
    where = np.array([i for i, _ in found])
    a, b = (np.concatenate([got[k] for _, got in found]) for k in (0, 1))
    last_a, last_b = (np.cumsum([len(got[k]) for _, got in found]) for k in (0, 1))
    end_a, end_b = np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b])
    at = np.searchsorted(end_b, end_a)
    both = end_b[at] == end_a  # every document ends both sides, so `at` is always inside
    link_a, link_b = np.flatnonzero(both), at[both]
    closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    closes_a[link_a], closes_b[link_b] = 1, 1
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    last_group = group_a[last_a - 1] + 1
    counts[0, where], counts[1, where], counts[2, where] = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0), np.diff(last_group, prepend=0)
    # in the text a group's first ids follow all of earlier groups, its second ids all first ones up to its own
    text = np.empty(len(a) + len(b), object)
    text[np.arange(len(a)) + np.r_[0, link_b + 1][group_a]] = own.a_text[closes_a, a]
    text[np.arange(len(b)) + (link_a + 1)[group_b]] = own.b_text[closes_b, b]
    first = 0
    for i, x, y in zip(where, last_a, last_b, strict=True):
        spelled[i] = "".join(text[first : x + y].tolist())[:-1]
        first = x + y
    return counts, spelled, (np.repeat(where, counts[2, where]), a[link_a], b[link_b])


TABLE = "piece long, stripe int, cells binary, docs binary, local int, doc_id long, n_a long, n_b long, n_groups long, groups string"


def linked(docs: DataFrame, a_path: str, b_path: str, spell: bool, limits: Limits) -> DataFrame:
    """A row for each document (stripe -1), and one for each batch and stripe with its links.

    `cells` has the distinct cells, in how many documents each is and how often; `docs` has those documents, cell by cell, and how often they have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.frugal()
        own, piece = Aligner(a_path, b_path, limits.cells), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in core.pieces(batch, most=limits.batch):
                counts, spelled, (doc, a, b) = links_of(own, part.column(1).to_pylist())
                n = part.num_rows
                said = [x if spell or not x else hashlib.sha256(x.encode()).hexdigest() for x in spelled]
                none = pa.nulls(n, pa.binary())
                yield pa.record_batch([pa.array([piece] * n, pa.int64()), pa.array([-1] * n, pa.int32()), none, none, pa.array(range(n), pa.int32()), part.column(0), *(pa.array(x) for x in counts), pa.array(said, pa.string())], names)
                key = ((b % own.stripes * own.rows + b // own.stripes) * len(own.a_size) + a) * n + doc
                key, times = np.unique(key, return_counts=True)
                doc = key % n
                cell, first, docs = np.unique(key // n, return_index=True, return_counts=True)
                block = own.rows * len(own.a_size)
                cuts = np.searchsorted(cell, np.arange(own.stripes + 1) * block)
                sent = [s for s in range(own.stripes) if cuts[s] < cuts[s + 1]]
                total, at = np.add.reduceat(times, first) if len(first) else first, np.r_[first, len(key)]
                cells = [put(np.diff(cell[i:j] - s * block, prepend=0), docs[i:j], total[i:j]) for s in sent for i, j in [(cuts[s], cuts[s + 1])]]
                held = [put(doc[at[i] : at[j]], times[at[i] : at[j]]) for s in sent for i, j in [(cuts[s], cuts[s + 1])]]
                m = len(sent)
                if m:
                    yield pa.record_batch([pa.array([piece] * m, pa.int64()), pa.array(sent, pa.int32()), pa.array(cells, pa.binary()), pa.array(held, pa.binary()), *(pa.nulls(m, k) for k in (pa.int32(), *[pa.int64()] * 4, pa.string()))], names)
                piece += 1

    names = [x.split()[0] for x in TABLE.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TABLE)


def counted(sent: DataFrame, batches: int, n_a: int, rows: int, limits: Limits) -> DataFrame:
    """(stripe, body) of links (stripe, piece, cells) with a stripe's cells, counts, and whether each is its row's highest; merged in rounds of bounded groups."""
    shape = (rows, n_a)

    def block(table: pa.Table, width: int) -> np.ndarray:
        core.frugal()
        out = np.zeros(shape, np.int64)
        for data in table["body"].to_pylist():
            got = take(data, width)
            np.add.at(out.reshape(-1), np.cumsum(got[0]), got[-1])
        return out

    def add(width: int):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            out = block(table, width).reshape(-1)
            cells = np.flatnonzero(out)
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([put(np.diff(cells, prepend=0), out[cells])], pa.binary())], ["stripe", "part", "body"])

        return run

    def best(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = block(table, 2)
        top = out.max(axis=1)
        cells = np.flatnonzero(out)
        n = out.reshape(-1)[cells]
        data = put(np.diff(cells, prepend=0), n, (n == top[cells // n_a]).astype(np.int64))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([data], pa.binary())], ["stripe", "body"])

    schema, width, groups = "stripe int, part long, body binary", 3, math.ceil(batches / limits.counted)
    part = F.pmod(F.xxhash64("piece"), F.lit(groups))
    out = sent.select("stripe", part.alias("part"), F.col("cells").alias("body")).groupBy("stripe", "part").applyInArrow(add(width), schema)
    while groups > limits.merged:
        groups = math.ceil(groups / limits.merged)
        out = out.withColumn("part", F.col("part") % groups).groupBy("stripe", "part").applyInArrow(add(2), schema)
    return out.groupBy("stripe").applyInArrow(best, "stripe int, body binary")


def scored(sent: DataFrame, counts: DataFrame, batches: int, limits: Limits) -> DataFrame:
    """(piece, body): for each batch and stripe its documents, their best links and their sums of counts."""
    groups = math.ceil(batches / limits.scored)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        core.frugal()
        cells, n, top = take(right["body"][0].as_py(), 3)
        cells, out = np.cumsum(cells), []
        for data, held in zip(left["cells"].to_pylist(), left["docs"].to_pylist(), strict=True):
            step, docs, _ = take(data, 3)
            doc, times = take(held, 2)
            at = np.repeat(np.searchsorted(cells, np.cumsum(step)), docs)
            own, where = np.unique(doc, return_inverse=True)
            sums = np.zeros((2, len(own)), np.int64)
            np.add.at(sums[0], where, times * top[at])
            np.add.at(sums[1], where, times * n[at])
            out.append(put(own, *sums))
        return pa.table([left["piece"], pa.array(out, pa.binary())], ["piece", "body"])

    left = sent.select("stripe", F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("part"), "piece", "cells", "docs")
    right = counts.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), "body")
    keys = ("stripe", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "piece long, body binary")


def align(docs: DataFrame, a_path: str, b_path: str, spell: bool = True, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document, and the pairs (a, b, n, best) of the corpus.

    `groups` is `a1,a2|b1;a3|b2,b3`, ids of both sides between the places where both end, or its SHA-256 unless `spell`. A
    link is a pair of tokens that end at one byte. Texts that are null or empty, or whose tokens' bytes aren't those of a
    space and the text (the second tokenizer normalises some), have no tokens: zeros and ''. Repeated rows count and come back
    each; of equal counts each is `best`. Strings of special tokens are ordinary text. Columns beyond doc_id and text are
    ignored. Very long texts are whole. An empty table gives no rows and no pairs. Both results are in the shared folder.
    """
    spark = docs.sparkSession
    core.ship(spark)
    at = f"{core.shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    linked(docs, a_path, b_path, spell, limits).write.option("compression", "zstd").parquet(at)
    table = spark.read.schema(TABLE).parquet(at)
    sent = table.where(F.col("stripe") >= 0).select("piece", "stripe", "cells", "docs")
    own = table.where(F.col("stripe") == -1).select("piece", "local", "doc_id", "n_a", "n_b", "n_groups", "groups")
    batches = max(1, own.agg(F.count_distinct("piece")).first()[0])
    n_a, n_b = len(side(Bytes, a_path).tokens), len(side(Pieces, b_path).tokens)
    stripes, rows = layout(n_a, n_b, limits.cells)
    counts = core.kept(counted(sent, batches, n_a, rows, limits))

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        local = left["local"].to_numpy()
        sums = np.zeros((2, int(local.max(initial=-1)) + 1), np.int64)
        for data in right["body"].to_pylist():
            doc, best, n = take(data, 3)
            np.add.at(sums[0], doc, best)
            np.add.at(sums[1], doc, n)
        return pa.table([*(left[x] for x in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")), pa.array(sums[0][local]), pa.array(sums[1][local]), left["groups"]], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    replies = scored(sent, counts, batches, limits)
    result = core.kept(own.groupBy("piece").cogroup(replies.groupBy("piece")).applyInArrow(total, ", ".join(f"{x} {'string' if x == 'groups' else 'long'}" for x in names)))

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for stripe, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells, n, top = take(data, 3)
                cells = np.cumsum(cells)
                yield pa.record_batch([pa.array(cells % n_a), pa.array(cells // n_a * stripes + stripe), pa.array(n), pc.equal(pa.array(top), 1)], ["a", "b", "n", "best"])

    core.remove(spark, at)
    return result, counts.mapInArrow(spread, "a long, b long, n long, best boolean")


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = align(core.table(spark, sf_dir, "documents"), *paths(), spell=False)
    return documents.withColumnRenamed("groups", "groups_sha256")
