"""Media columns: texts stored as lossless WebP pixels, read back, and their features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core, webp, webp_store

#: Samples in a row of grey pixels, one for each byte; the format's most rows.
ROW, ROWS = 576, 16384
#: Bytes of texts that are stored and read together.
BATCH = 1_000_000


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (ROW - len(text) if len(text) < ROW else -len(text) % ROW)


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of ROW bytes) as a lossless WebP file of grey pixels; over ROWS rows as several, one after the other."""
    parts = [[p[at : at + ROW * ROWS] for at in range(0, len(p), ROW * ROWS)] for p in payloads]
    files = iter(webp_store.encode_grey([x for p in parts for x in p], ROW))
    return [b"".join(next(files) for _ in p) for p in parts]


def load(media: list[bytes]) -> list[np.ndarray]:
    """Decoded RGB pixels, rows x ROW x 3, of what store gave."""
    files = [webp_store.split(m) for m in media]
    decoded = iter(webp.decode_all([f for own in files for f in own]))
    out = []
    for own in files:
        argb = [next(decoded) for _ in own]
        argb = argb[0] if len(argb) == 1 else np.concatenate(argb)
        out.append(np.ascontiguousarray(argb).view(np.uint8).reshape(*argb.shape, 4)[..., 2::-1])
    return out


def samples(pixels: np.ndarray) -> bytes:
    """The grey samples: one byte for each pixel."""
    return np.ascontiguousarray(pixels[..., 1]).tobytes()


def features(pixels: np.ndarray) -> str:
    """Size, and for each channel the mean and the deviation; the mean step between neighbours in a row."""
    grey = [np.array_equal(pixels[..., k], pixels[..., 1]) for k in (0, 2)]  # then one channel's counts are all's
    green = np.ascontiguousarray(pixels[..., 1])
    middle = np.bincount(green.ravel(), minlength=256)
    first, last = (middle if same else np.bincount(pixels[..., k].ravel(), minlength=256) for k, same in zip((0, 2), grey, strict=True))
    flat = np.stack([first, middle, last])
    n, at = flat[0].sum(), np.arange(256)
    mean = flat @ at / n
    deviation = np.sqrt(np.maximum(flat @ (at * at) / n - mean**2, 0))
    a, b = green[:, 1:], green[:, :-1]
    step = (np.maximum(a, b) - np.minimum(a, b)).mean()
    return f"{pixels.shape[1]}x{pixels.shape[0]};" + ",".join(f"{x:.3f}" for x in mean) + ";" + ",".join(f"{x:.3f}" for x in deviation) + f";{step:.3f}"


def media_columns(docs: DataFrame, keep: bool = False) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and media if keep).

    docs needs doc_id and text; other columns are ignored. Null and empty texts are one row of 255. Repeated rows and equal
    texts give equal values. Texts of over 16384 rows (9 MB) are several files one after the other in the media column.
    An empty table gives an empty result. Everything but n_bytes comes from the stored bytes, read back.
    """
    core.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in core.pieces(batch, most=BATCH):
                out: list[list] = [[] for _ in range(8)]
                texts = x.column(1).to_pylist()
                stored = store([padded(text) for text in texts])
                for text, media, pixels in zip(texts, stored, load(stored), strict=True):
                    back = samples(pixels)
                    row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(pixels), media)
                    for v, r in zip(out, row, strict=True):
                        v.append(r)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")
                k = 8 if keep else 7
                yield pa.record_batch([x.column(0), *(pa.array(v, t) for v, t in list(zip(out, kinds, strict=True))[:k])], ["doc_id", *names[:k]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(core.table(spark, sf_dir, "documents"))
