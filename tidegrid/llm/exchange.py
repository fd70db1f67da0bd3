"""Rounds of messages between batches of documents and buckets of hashes.

Documents are dealt by a hash of their key, text and place in the input into batches of about 1.5 MB, so repeated
rows spread. The place is Spark's row number within the input's partitions: give a table that is read (or checkpointed),
whose parts come back in the same order when they are read again. A batch sends each bucket
of the hash range one row that holds its distinct hashes, so a passage that a third of all documents hold
reaches a bucket once for each batch and no group is hot. A bucket answers each batch with what it asked.
All rounds read the same exchange of the documents by batch, which Spark reuses; a lost executor's
part is recomputed from lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

#: What batches send to buckets, and buckets to batches.
MESSAGE = "b long, bucket long, data binary"
ARROW = pa.schema([("b", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
LOW = np.uint64((1 << 40) - 1)


def batched(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(b, id, key, text, then carry as c0, c1 ...) by batch, and the number of buckets. id is doc_id, key is it with null as the largest."""
    core.ship(docs.sparkSession)
    _, total = core.sizes(docs)
    n = core.parts(total, core.BATCH_BYTES)
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n)).alias("b"),
        F.col("doc_id").cast("long").alias("id"),
        core.key_column().alias("key"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)),
    )
    return rows, core.parts(total, core.BUCKET_BYTES)


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"b": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())}, ARROW)


def spread(h: np.ndarray) -> np.ndarray:
    """Hashes anew: anchors are the smallest of their windows, so their own upper bits are uneven."""
    return core.mix(h ^ np.uint64(0x5851F42D4C957F2D))


def short(h: np.ndarray, buckets: int) -> np.ndarray:
    """(bucket, low 40 bits) as one number: enough to choose candidates, with 5 bytes a hash on the wire."""
    h = spread(h)
    return (core.bucket_of(h, buckets) << np.uint64(40)) | (h & LOW)


def pack(codes: np.ndarray, width: int) -> bytes:
    if width == 8:
        return codes.astype("<u8").tobytes()
    low = codes & LOW
    return (low >> np.uint64(8)).astype("<u4").tobytes() + low.astype(np.uint8).tobytes()


def unpack(data: bytes, bucket: int, width: int) -> np.ndarray:
    n = len(data) // width
    if width == 8:
        return np.frombuffer(data, "<u8", n).astype(np.uint64)
    high, low = np.frombuffer(data, "<u4", n), np.frombuffer(data, np.uint8, n, 4 * n)
    return (np.uint64(bucket) << np.uint64(40)) | (high.astype(np.uint64) << np.uint64(8)) | low.astype(np.uint64)


def send(b: int, codes: np.ndarray, several: np.ndarray, buckets: int, width: int) -> list[tuple[int, int, bytes]]:
    """Messages for ascending distinct codes; several: seen at more than one place in this batch. Width 5: short hashes."""
    bucket = (core.bucket_of(codes, buckets) if width == 8 else codes >> np.uint64(40)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    out = []
    for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(codes)], strict=True):
        if j > i:
            out.append((b, int(bucket[i]), pack(codes[i:j], width) + np.packbits(several[i:j]).tobytes() + int(j - i).to_bytes(4, "little") + bytes([width])))
    return out


def answer(t: pa.Table) -> pa.Table:
    """Of one bucket: each batch gets back those of its hashes that it has more than once, or that other batches have too."""
    bucket, width = t.column("bucket")[0].as_py(), 8
    whose, codes, several = [], [], []
    for data in t.column("data").to_pylist():
        n, width = int.from_bytes(data[-5:-1], "little"), data[-1]
        codes.append(unpack(data[: width * n], bucket, width))
        several.append(np.unpackbits(np.frombuffer(data, np.uint8, len(data) - 5 - width * n, width * n), count=n))
        whose.append(n)
    every = np.concatenate(codes)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.concatenate(several).astype(bool)[order]
    hit[1:] |= same
    hit[:-1] |= same
    found = np.empty(len(hit), bool)
    found[order] = hit
    out, at = [], 0
    for b, n, own in zip(t.column("b").to_pylist(), whose, codes, strict=True):
        if len(own := own[found[at : at + n]]):
            out.append((b, bucket, pack(own, width) + bytes([width])))
        at += n
    return messages(out)


def received(t: pa.Table) -> np.ndarray:
    """The codes in a batch's answers, ascending."""
    got = [unpack(d[:-1], k, d[-1]) for d, k in zip(t.column("data").to_pylist(), t.column("bucket").to_pylist(), strict=True)]
    return np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)


def member(codes: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(codes), bool)
    return among[np.minimum(np.searchsorted(among, codes), len(among) - 1)] == codes


def ask(docs: DataFrame, replies: DataFrame | None, say: Callable[[pa.Table, pa.Table | None], pa.Table]) -> DataFrame:
    """What batches send, given their texts and the last answers."""
    if replies is None:
        return docs.groupBy("b").applyInArrow(lambda t: say(t, None), MESSAGE)
    return docs.groupBy("b").cogroup(replies.groupBy("b")).applyInArrow(lambda t, r: say(t, r) if t.num_rows else messages([]), MESSAGE)


def answered(sent: DataFrame, how: Callable[[pa.Table], pa.Table] = answer) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(how, MESSAGE)


def close(docs: DataFrame, replies: DataFrame, end: Callable[[pa.Table, pa.Table], pa.Table], schema: str, arrow: pa.Schema) -> DataFrame:
    """The rows that each batch returns after its last answers."""
    return docs.groupBy("b").cogroup(replies.groupBy("b")).applyInArrow(lambda t, r: end(t, r) if t.num_rows else arrow.empty_table(), schema)


def texts(t: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch's documents in slices with their bytes and offsets; only a longer text exceeds a few MB."""
    for batch in t.combine_chunks().to_batches():
        for x in core.pieces(batch, most=core.BATCH_BYTES // 2):
            yield (x, *core.column(x.column(x.schema.get_field_index("text"))))
