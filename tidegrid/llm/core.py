"""Byte and word primitives that the corpus operators share.

Everything here works on a concatenated UTF-8 buffer and document offsets, a few MB at a time, with polynomial
hashes of 62 bits (a random value for each byte, two bases modulo a prime).
"""

from __future__ import annotations

import atexit
import ctypes
import io
import math
import os
import shutil
import tempfile
import uuid
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one batch of documents holds, about; batches are what replies are sent to.
BATCH_BYTES = 1_500_000
#: Bytes of text for each bucket of hashes.
BUCKET_BYTES = 8_000_000
#: Longest buffer that is hashed at once, and windows that are (small enough for a cache).
CHUNK, STEP = 1 << 19, 1 << 14

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Hashes are polynomials modulo this prime at two bases: no fixed pair of texts, Thue-Morse words included, is equal at both by its form.
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (0x2C1B3C6D, 0x5851F42B)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    if h.ndim == 1 and len(h) > 2 * STEP:
        return np.concatenate([mix(h[i : i + STEP]) for i in range(0, len(h), STEP)])
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _fold(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """x, in place, to a smaller number that is equal to it modulo _PRIME."""
    np.right_shift(x, np.uint64(31), out=spare)
    x &= _PRIME
    x += spare
    return x


def _least(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """x modulo _PRIME, in place, for x below 2**63."""
    _fold(_fold(x, spare), spare)
    x += np.uint64(1)
    _fold(x, spare)
    x -= np.uint64(1)
    return x


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASES[k]**i and its inverse, modulo _PRIME, for i below n."""
    if k not in _tables or len(_tables[k][0]) < n:
        size, out, p = max(1 << 16, 1 << (n - 1).bit_length()), [], int(_PRIME)
        for base in (_BASES[k], pow(_BASES[k], -1, p)):
            t = np.ones(1, np.uint64)
            while len(t) < size:
                t = np.concatenate([t, _least(t * np.uint64(pow(base, len(t), p)), np.empty_like(t))])
            out.append(t)
        _tables[k] = out[0], out[1]
    return _tables[k][0][:n], _tables[k][1][:n]


def _difference(values: np.ndarray, start, end, shift) -> np.ndarray:
    """Both hashes of values[start:end] as one number: differences of prefix sums, moved to the begin by the inverse powers at `shift`."""
    n, both = len(values), []
    sums, spare = np.zeros(n + 1, np.uint64), np.empty(n, np.uint64)
    for k in (0, 1):
        own = values >> np.uint64(33 if k else 2)
        own &= _PRIME
        own *= powers(k, n)[0]
        np.cumsum(_fold(own, spare), out=sums[1:])
        d = sums[end] - sums[start]
        wide = spare[: len(d)] if len(d) <= n else np.empty_like(d)
        _fold(d, wide)
        d *= powers(k, n + 1)[1][shift]
        both.append(_least(d, wide))
    return both[0] | (both[1] << np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 62-bit hash, mixed with the length, of values[start:end] for each pair; starts ascend. Long inputs are taken in chunks."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + 2 * STEP, "left")))
        at, to = int(start[i]), int(end[i:j].max())
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = _difference(values[at:to], s, e, s)
        i = j
    return mix(out ^ (np.asarray(end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = max(STEP, k)
    for at in range(0, n, step):
        to = min(n, at + step)
        out[at:to] = _difference(values[at : to + k - 1], slice(0, to - at), slice(k, k + to - at), slice(0, to - at))
    return mix(out)


def column(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, nulls as empty, and len + 1 offsets."""
    frugal()
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.binary())
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if array.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, off, data = array.buffers()
    offs = np.frombuffer(off, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def pieces(batch: pa.RecordBatch, name: str = "text", most: int = BATCH_BYTES):
    """Slices of a record batch with about `most` bytes of text each; a longer text is alone."""
    _, offs = column(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the index of each document's first word (len(offs))."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    own = ~SPACE[buf]
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1]
    last[:-1] &= ~own[1:]
    full = offs[:-1][offs[1:] > offs[:-1]]
    first[full] = own[full]
    full = offs[1:][offs[1:] > offs[:-1]] - 1
    last[full] = own[full]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offs)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(VALUES[buf], start, end) if len(buf) < CHUNK else _long(buf, start, end)


def _long(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK // 2, "left")))
        at = int(start[i])
        out[i:j] = span_hashes(VALUES[buf[at : int(end[i:j].max())]], start[i:j] - at, end[i:j] - at)
        i = j
    return out


def valid(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n - k + 1 windows of k items lie in one document; first: each document's first item, and n."""
    if n < k:
        return np.zeros(0, bool)
    out = np.ones(n - k + 1, bool)
    cuts = np.unique(first[(first > 0) & (first < n)])
    bad = (cuts[:, None] - np.arange(1, k)).ravel() if len(cuts) * k < 50_000_000 else None
    if bad is None:
        for c in cuts:
            out[max(0, c - k + 1) : c] = False
    else:
        out[bad[(bad >= 0) & (bad < len(out))]] = False
    return out


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive hashes the index of the smallest by its upper half, the first of equals."""
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64)
    if n > 2 * STEP + w:
        return np.concatenate([minimizers(hashes[at : at + STEP + w - 1], w) + at for at in range(0, n - w + 1, STEP)])
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    if span < w:
        keys = np.minimum(keys[: n - w + 1], keys[w - span : n - span + 1])
    return (keys[: n - w + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash's upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def sizes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes, by one small aggregation."""
    got = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return int(got[0]), int(got[1] or 0)


def parts(total: int, each: int, least: int = 16) -> int:
    return max(least, math.ceil(total / each))


def key_column(doc_id: str = "doc_id"):
    """doc_id as a long, null after all others."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))


def fold(doc_id: str = "doc_id"):
    """crc32 of doc_id's text, modulo 5; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on this machine alone gets its own where none is set."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = getattr(sc, "_tidegrid_dir", None) or tempfile.mkdtemp(prefix="tidegrid-")
        sc._tidegrid_dir = at
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def model_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for a model's files in the shared folder; it goes when the driver ends."""
    at = f"{local_path(shared_dir(spark))}/{kind}-{uuid.uuid4().hex}"
    os.makedirs(at, exist_ok=True)
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def remove(spark: SparkSession, at: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(uri: str) -> str:
    """The mount's path of a file: folder. Other stores must be mounted for workers to map files."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped models need a mounted shared folder, not {uri}")
    return uri


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def frugal() -> None:
    """In a worker, once: give freed arrays back to the system. Workers live long, and several share an executor's memory."""
    if _frugal or TaskContext.get() is None:
        return
    _frugal.append(True)
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):  # not glibc: its own way is as good
        return
    mallopt(-3, 1 << 18)  # larger blocks are mapped, and unmapped when freed
    mallopt(-1, 1 << 20)  # trim the heap's end


_frugal: list[bool] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context; Arrow batches are of a few MB."""
    sc = spark.sparkContext
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")):
        spark.conf.set(key, value)
    if getattr(sc, "_tidegrid_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    name = os.path.join(tempfile.mkdtemp(), f"tidegrid_{zlib.crc32(out.getvalue()):08x}.zip")
    Path(name).write_bytes(out.getvalue())
    sc.addPyFile(name)
    sc._tidegrid_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
