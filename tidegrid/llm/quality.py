"""Quality rules: text statistics and language-specific perplexity bands of a Kneser-Ney n-gram model of characters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core
from .lm import _map, discounts

#: Words that a text has at least; percent of words in repeated windows of REPEAT words at most.
LEAST_WORDS, MOST_REPEATED, REPEAT = 10, 20, 5
#: A language's band of log10 perplexity: its quartiles, and FENCE times their distance (SPREAD at least) to both sides.
FENCE, SPREAD = 3.0, 0.002
#: Languages with a broadcast band; more are joined by a shuffle.
MOST_BANDS = 100_000
#: Bins of log10 perplexity per unit, for quartiles by counting.
BINS = 10_000
#: Pieces of text whose counts are summed before they are sent.
HELD = 8
BITS = 7
#: Bits of a code point in a trigram of characters, and the symbol before a text, which is no code point.
WIDE, BORDER = 21, 0x110000
#: Mapped arrays of models of characters at a time, and bytes of a stored trigram.
MAPS, ROW = 20_000, 24
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _classes() -> np.ndarray:
    """128 classes of bytes: 0 for controls and texts' borders, digits alike, A-Z as a-z, lead bytes folded to 3 classes."""
    out, n = np.zeros(256, np.int64), 1
    for b in range(32, 128):
        if chr(b).isdigit() and b > 48:
            out[b] = out[48]
        elif 65 <= b <= 90:
            out[b] = -1
        else:
            out[b], n = n, n + 1
    out[65:91] = out[97:123]
    for b in range(128, 192):
        out[b] = 61 + b - 128
    out[192:224], out[224:240], out[240:] = 125, 126, 127
    return out


CLASS = _classes()


def _triples(c: np.ndarray, offs: np.ndarray, border: int, bits: int) -> np.ndarray:
    """Keys of each symbol and the two before it; before a text stand two borders."""
    one, two = np.r_[0, c[:-1]], np.r_[0, 0, c[:-2]][: len(c)]
    full = offs[:-1][offs[1:] > offs[:-1]]
    one[full] = border
    two[full] = border
    second = full[(offs[1:][offs[1:] > offs[:-1]] - full) > 1] + 1
    two[second] = border
    return (two << 2 * bits) | (one << bits) | c


def grams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """21-bit trigram keys of all bytes by their classes; before a text stand two of class 0."""
    return _triples(CLASS[buf], offs, 0, BITS)


def characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(63-bit trigram keys of all characters as they are, offsets of the texts in them); bytes that are no UTF-8 count as U+FFFD."""
    lead = (buf & 0xC0) != 0x80
    try:
        if not lead[offs[:-1][offs[1:] > offs[:-1]]].all():
            raise ValueError("a text begins within a character")
        text, at = buf.tobytes().decode(), np.r_[0, np.cumsum(lead)][offs]
    except ValueError:
        own = [buf[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(offs, offs[1:], strict=False)]
        text, at = "".join(own), np.r_[0, np.cumsum([len(x) for x in own], dtype=np.int64)]
    return _triples(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64), at, BORDER, WIDE), at


def by_owner(owner: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, places of k in owner) of all k below n that occur."""
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(n + 1))
    return ((k, order[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a)


def kneser_ney(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 probabilities of the seen trigrams, those of all bigrams as a backoff, backoff weights of all contexts)."""
    size = 1 << BITS
    kinds = lambda v: [int((v == k).sum()) for k in (1, 2, 3, 4)]

    def level(n: np.ndarray, context: np.ndarray, contexts: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interpolated probabilities of events with counts n, and each context's weight of the lower order."""
        d = discounts(kinds(n))[np.minimum(n, 3)]
        total = np.bincount(context, n, contexts)
        left = np.bincount(context, d, contexts)
        weight = np.where(total > 0, left / np.maximum(total, 1), 1.0)
        return (n - d) / total[context] + weight[context] * lower, weight

    pairs, types2 = np.unique(keys & ((1 << 2 * BITS) - 1), return_counts=True)
    singles, types1 = np.unique(pairs & (size - 1), return_counts=True)
    p1 = np.full(size, 0.0)
    own, w = level(types1, np.zeros(len(singles), np.int64), 1, np.full(len(singles), 1 / size))
    p1[:] = w[0] / size
    p1[singles] = own
    p2_seen, w2 = level(types2, pairs >> BITS, size, p1[pairs & (size - 1)])
    p2 = (w2[:, None] * p1[None]).ravel()
    p2[pairs] = p2_seen
    p3, w3 = level(counts, keys >> BITS, size * size, p2[keys & ((1 << 2 * BITS) - 1)])
    return np.log10(p3), np.log10(p2), np.log10(w3)


def train(docs: DataFrame) -> tuple[str, DataFrame]:
    """(folder, (lang, name) rows): a model for each language, of all its texts, stored as sorted arrays.

    Tasks count the trigrams that occur and send sums; Spark adds them. A table holds what occurs, so it grows with the corpus.
    """
    spark = docs.sparkSession
    core.ship(spark)
    folder = core.model_folder(spark, "chars")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        langs: dict[str | None, int] = {}

        def sent() -> pa.RecordBatch:
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])
            keys, which = np.unique(keys, return_inverse=True)
            names = pa.array(list(langs), pa.string()).take(pa.array(keys >> 3 * BITS))
            out = pa.record_batch([names, pa.array(keys & ((1 << 3 * BITS) - 1)), pa.array(np.bincount(which, n).astype(np.int64))], ["lang", "gram", "n"])
            held.clear()
            return out

        for batch in batches:
            for x in core.pieces(batch):
                buf, offs = core.column(x.column(1))
                own = np.array([langs.setdefault(v, len(langs)) for v in x.column(0).to_pylist()], np.int64)
                held.append(np.unique(np.repeat(own, np.diff(offs)) << 3 * BITS | grams(buf, offs), return_counts=True))
                if len(held) >= HELD:
                    yield sent()
        if held:
            yield sent()

    def store(key: tuple, t: pa.Table) -> pa.Table:
        keys, counts = t.column("gram").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        p3, p2, w3 = kneser_ney(keys, counts)
        name = uuid.uuid4().hex
        for kind, v in (("keys", keys.astype("<i4")), ("p3", p3.astype("<f4")), ("p2", p2.astype("<f4")), ("w3", w3.astype("<f4"))):
            with open(f"{folder}/{name}-{kind}.npy", "wb") as f:
                np.save(f, v)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "name": pa.array([name])})

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return folder, core.kept(sums.groupBy("lang").applyInArrow(store, "lang string, name string"))


def _level(n: np.ndarray, context: np.ndarray, size: int, cut: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated probabilities of events with counts n, and each context's weight of the lower order."""
    d = cut[np.minimum(n, 3)]
    total = np.bincount(context, n, size)
    weight = np.bincount(context, d, size) / total
    return (n - d) / total[context] + weight[context] * lower, weight


def train_characters(docs: DataFrame) -> tuple[str, DataFrame]:
    """(folder, (lang, name, buckets) rows): a model of character trigrams for each language, of all its texts, as sorted arrays.

    Spark sums the trigrams that tasks count. What a trigram needs of the orders three and two is with those that have its
    middle character, so these are a bucket's work; characters alone (a row each) and counts of counts are a language's.
    """
    core.ship(docs.sparkSession)
    folder = core.model_folder(docs.sparkSession, "chars")
    low, pair, most = (1 << WIDE) - 1, (1 << 2 * WIDE) - 1, core.BUCKET_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        pieces = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(which, np.concatenate([v for _, v in parts])).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for x in core.pieces(batch):
                keys, at = characters(*core.column(x.column(1)))
                langs: dict[str | None, int] = {}
                own = np.array([langs.setdefault(v, len(langs)) for v in x.column(0).to_pylist()], np.int64)
                every = list(langs)
                for k, places in by_owner(np.repeat(own, np.diff(at)), len(langs)):
                    held.setdefault(every[k], []).append(np.unique(keys[places], return_counts=True))
                pieces += 1
                if pieces % HELD == 0:
                    yield from sent()
        yield from sent()

    def singles(key: tuple, t: pa.Table) -> pa.Table:
        level, at, n = (t.column(c).to_numpy() for c in ("level", "at", "n"))
        kinds = lambda k: [int(n[(level == k) & (at == i)].sum()) for i in (1, 2, 3, 4)]
        own = np.flatnonzero(level == 1)
        own = own[np.argsort(at[own])]
        cut = discounts([int((n[own] == k).sum()) for k in (1, 2, 3, 4)])
        # one more than the characters seen: all that were not
        p, w = _level(n[own], np.zeros(len(own), np.int64), 1, cut, np.full(len(own), 1 / (len(own) + 1)))
        name = uuid.uuid4().hex
        _save(folder, name, {"at": at[own], "p1": np.r_[p, w[0] / (len(own) + 1)], "cut": np.stack([discounts(kinds(2)), discounts(kinds(3))])})
        buckets = max(1, -(-int(n[level == 3].sum()) * ROW // most))
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "name": pa.array([name]), "buckets": pa.array([buckets], pa.int64())})

    def store(key: tuple, t: pa.Table) -> pa.Table:
        name, bucket = key[0].as_py(), key[1].as_py()
        at, p1, cut = (np.load(f"{folder}/{name}-{k}.npy") for k in ("at", "p1", "cut"))
        keys, n = t.column("gram").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        pairs, types = np.unique(keys & pair, return_counts=True)
        middles, which = np.unique(pairs >> WIDE, return_inverse=True)
        p2, w2 = _level(types, which, len(middles), cut[0], p1[np.searchsorted(at, pairs & low)])
        contexts, which = np.unique(keys >> WIDE, return_inverse=True)
        p3, w3 = _level(n, which, len(contexts), cut[1], p2[np.searchsorted(pairs, keys & pair)])
        logs = {k: np.log10(v).astype("<f4") for k, v in (("p3", p3), ("p2", p2), ("w3", w3), ("w2", w2))}
        _save(folder, f"{name}-{bucket}", {"keys": keys, "pairs": pairs, "contexts": contexts, "middles": middles} | logs)
        return pa.table({"name": [name]})

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    sums = core.kept(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rows_of = F.count(F.lit(1)).alias("n")
    pairs = sums.groupBy("lang", F.col("gram").bitwiseAND(pair).alias("pair")).agg(F.count(F.lit(1)).alias("types"))
    levels = (pairs.groupBy("lang", F.col("pair").bitwiseAND(low).alias("at")), pairs.groupBy("lang", F.least("types", F.lit(5)).alias("at")), sums.groupBy("lang", F.least("n", F.lit(5)).alias("at")))
    one, two, three = (x.agg(rows_of).select("lang", F.lit(k).cast("long").alias("level"), F.col("at").cast("long").alias("at"), "n") for k, x in enumerate(levels, 1))
    models = core.kept(one.union(two).union(three).groupBy("lang").applyInArrow(singles, "lang string, name string, buckets long"))
    bucket = F.pmod(F.shiftright("gram", WIDE).bitwiseAND(low), F.col("buckets")).alias("bucket")
    core.kept(_named(sums, models).select("name", bucket, "gram", "n").groupBy("name", "bucket").applyInArrow(store, "name string"))
    return folder, models


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    for kind, v in arrays.items():
        with open(f"{folder}/{name}-{kind}.npy", "wb") as f:
            np.save(f, v)


def _named(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows with the columns of their language's model, null where there is none."""
    small = models.count() <= MOST_BANDS
    m = models.withColumnRenamed("lang", "_lang")
    return rows.join(F.broadcast(m) if small else m, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")


_arrays: dict[str, np.ndarray | None] = {}


def _array(path: str) -> np.ndarray | None:
    if path not in _arrays:
        if len(_arrays) >= MAPS:
            _arrays.clear()
        _arrays[path] = _map(path) if os.path.exists(path) else None
    return _arrays[path]


def look_up_characters(folder: str, name: str, buckets: int, keys: np.ndarray) -> np.ndarray:
    """log10 probabilities of character trigrams by a language's mapped arrays: what was not seen backs off to two characters and one."""
    some, which = np.unique(keys, return_inverse=True)
    out = np.zeros(len(some))
    low, pair = (1 << WIDE) - 1, (1 << 2 * WIDE) - 1

    def found(known: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, v), len(known) - 1)
        return known[at] == v, at

    for k, places in by_owner((some >> WIDE & low) % buckets, buckets):
        own = some[places]
        get = lambda kind: _array(f"{folder}/{name}-{k}-{kind}.npy")  # noqa: B023, E731
        if get("keys") is None:
            hit, value = np.zeros(len(own), bool), np.zeros(len(own))
        else:
            hit, at = found(get("keys"), own)
            value = get("p3")[at].astype(float)
        rest = own[~hit]
        if len(rest):
            seen, at = found(_array(f"{folder}/{name}-at.npy"), rest & low)
            p = np.log10(_array(f"{folder}/{name}-p1.npy")[np.where(seen, at, -1)])
            if get("keys") is not None:
                seen, at = found(get("middles"), rest >> WIDE & low)
                p += np.where(seen, get("w2")[at], 0)
                seen, at = found(get("pairs"), rest & pair)
                p = np.where(seen, get("p2")[at], p)
                seen, at = found(get("contexts"), rest >> WIDE)
                p += np.where(seen, get("w3")[at], 0)
            value[~hit] = p
        out[places] = value
    return out[which]


_mapped: dict[str, tuple[np.ndarray, ...]] = {}


def look_up(folder: str, name: str, keys: np.ndarray) -> np.ndarray:
    """log10 probabilities of trigrams by a language's mapped arrays: a search among the sorted keys, else backoff."""
    if name not in _mapped:
        if len(_mapped) >= 64:  # a map holds a file descriptor
            _mapped.clear()
        _mapped[name] = tuple(np.load(f"{folder}/{name}-{k}.npy", mmap_mode="r") for k in ("keys", "p3", "p2", "w3"))
    known, p3, p2, w3 = _mapped[name]
    some, which = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(known, some), len(known) - 1)
    return np.where(known[at] == some, p3[at], w3[some >> BITS] + p2[some & ((1 << 2 * BITS) - 1)])[which]


def statistics(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    start, end, first = core.words(buf, offs)
    docs = len(offs) - 1
    total = lambda v: np.r_[0, np.cumsum(v)]
    lead = total((buf & 0xC0) != 0x80)
    chars = total(lead[end] - lead[start])
    symbols = total(SYMBOLS[buf])
    # lines: between breaks, and between texts
    cut = np.flatnonzero(buf == 10)
    a = np.sort(np.r_[offs[:-1], cut + 1])
    owner = np.searchsorted(offs, a, "right") - 1
    # an empty text's line stands at the next text's begin; only lines with a word matter
    b = np.minimum(np.r_[a[1:], len(buf)], offs[np.minimum(owner + 1, docs)])
    ends_at_break = (b > a) & (b <= len(buf)) & (buf[np.maximum(b - 1, 0)] == 10) if len(buf) else np.zeros(len(a), bool)
    b = b - ends_at_break
    wordy = (np.searchsorted(start, b) > np.searchsorted(start, a)) & (b > a)
    a, b, owner = a[wordy], b[wordy], owner[wordy]
    h = core.mix(core.word_hashes(buf, a, b) + core.mix(owner.astype(np.uint64))) if len(a) else np.zeros(0, np.uint64)
    once = np.zeros(len(h), bool)
    once[np.unique(h, return_index=True)[1]] = True
    lines = np.bincount(owner[~once], minlength=docs)[:docs]
    # words in repeated windows
    words = core.word_hashes(buf, start, end)
    windows = core.window_hashes(words, REPEAT)
    at = np.flatnonzero(core.valid(first, len(words), REPEAT))
    doc = np.searchsorted(first, at, "right") - 1
    h = core.mix(windows[at] + core.mix(doc.astype(np.uint64)))
    _, which, n = np.unique(h, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    again = at[n[which] > 1] if len(at) else at
    np.add.at(edge, again, 1)
    np.add.at(edge, again + REPEAT, -1)
    repeated = total(np.cumsum(edge[:-1]) > 0)
    return {"n_words": np.diff(first), "word_chars": np.diff(chars[first]), "n_symbols": np.diff(symbols[offs]), "n_dup_lines": lines, "n_repeat_words": np.diff(repeated[first])}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, folder: str, models: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, the counts, log_perplexity) of every row; log10 perplexity is null for a text without bytes.

    It is of a character where the models are of characters (they have buckets), else of a byte.
    """
    chars = "buckets" in models.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    name = F.concat("name", F.lit("/"), F.col("buckets").cast("string")) if chars else F.col("name")
    rows = _named(rows, models).select("doc_id", "lang", name.alias("name"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in core.pieces(batch):
                buf, offs = core.column(x.column(3))
                got = statistics(buf, offs)
                keys, at = characters(buf, offs) if chars else (grams(buf, offs), offs)
                n = np.diff(at)
                names = pa.array(x.column(2)).dictionary_encode() if not isinstance(x.column(2), pa.DictionaryArray) else x.column(2)
                code, every = names.indices.fill_null(-1).to_numpy(), names.dictionary.to_pylist()
                p = np.zeros(len(keys))
                for k, places in by_owner(np.repeat(code, n), len(every)):
                    if chars:
                        model, buckets = every[k].split("/")
                        p[places] = look_up_characters(folder, model, int(buckets), keys[places])
                    else:
                        p[places] = look_up(folder, every[k], keys[places])
                sums = np.diff(np.r_[0, np.cumsum(p)][at])
                value = np.where(n > 0, -sums / np.maximum(n, 1), 0)
                yield pa.record_batch([x.column(0), x.column(1), pa.array(np.diff(offs)), *(pa.array(got[c].astype(np.int64)) for c in COUNTS), pa.array(value, mask=n == 0)], ["doc_id", "lang", "n_bytes", *COUNTS, "log_perplexity"])

    return rows.mapInArrow(run, "doc_id long, lang string, n_bytes long, " + ", ".join(f"{c} long" for c in COUNTS) + ", log_perplexity double")


def bands(rows: DataFrame) -> DataFrame:
    """(lang, low, high) of log10 perplexity over all rows with bytes, from counts in bins of 1 / BINS."""
    bins = rows.where("log_perplexity IS NOT NULL").groupBy("lang", F.floor(F.col("log_perplexity") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def one(key: tuple, t: pa.Table) -> pa.Table:
        at, n = t.column("bin").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(at)
        c = np.cumsum(n[order])
        first, third = ((float(at[order][np.searchsorted(c, c[-1] * q)]) + 0.5) / BINS for q in (0.25, 0.75))
        wide = FENCE * max(third - first, SPREAD)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "low": [first - wide], "high": [third + wide]})

    return bins.groupBy("lang").applyInArrow(one, "lang string, low double, high double")


def quality(docs: DataFrame, by_character: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, low, high) of every row.

    base_failed: fewer than 10 words, or over 20 % of them in 5-word windows found twice or more in the text. kept: not
    base_failed, and the perplexity by the language's model within its band (the fences of its quartiles), alike for texts of every length. docs needs doc_id, text and lang; other
    columns are ignored. Null and empty texts have no words and fail; a null lang is a language of its own; repeated
    rows count and are judged each. An empty table gives an empty result. The model is of characters, none folded, with
    by_character, else of 128 classes of bytes.
    """
    folder, models = train_characters(docs) if by_character else train(docs)
    rows = core.kept(measured(docs, folder, models))
    band = core.kept(bands(rows)).withColumnRenamed("lang", "_lang")
    small = band.count() <= MOST_BANDS
    joined = rows.join(F.broadcast(band) if small else band, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    power = lambda c: F.pow(F.lit(10.0), c)
    return joined.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept"),
        power(F.col("log_perplexity")).alias("perplexity"), power(F.col("low")).alias("low"), power(F.col("high")).alias("high"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(core.table(spark, sf_dir, "documents"), by_character=True)
