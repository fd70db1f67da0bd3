"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of an enhanced suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import core, exchange

#: Bytes that a removed string has at least.
LENGTH = 50
#: Left neighbours of an interval's suffixes: none yet, or different ones.
NONE, DIVERSE = -1, -2
#: Suffixes that are sorted together, about.
MOST = 150_000
#: Extents of an anchor, over all batches, beyond which its windows are dealt one by one.
HOT = 4_000


def suffix_array(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes text[at : at + size] and each one's common prefix with the one before it (first: 0)."""
    width = int(size.max()) if len(size) else 0
    padded = np.r_[text, np.zeros(width, np.uint8)]
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[at] if width else np.zeros((len(at), 0), np.uint8)
    rows = np.where(np.arange(width) < size[:, None], rows, 0).astype(np.uint8)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable") if len(at) else np.zeros(0, np.int64)
    common = np.zeros(len(at), np.int64)
    for i in range(1, len(order), 65536):
        a, b = order[i - 1 : i + 65535], order[i : i + 65536]
        a = a[: len(b)]
        differ = rows[a] != rows[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[i : i + len(b)] = np.minimum(first, np.minimum(size[a], size[b]))
    return order, common


def intervals(common: np.ndarray, left: np.ndarray, key: np.ndarray, least: int) -> np.ndarray:
    """Maximal repeats as rows of first rank, last rank, length, smallest key, parent's length or 0: intervals of the tree at
    depth `least` or more whose suffixes have different left neighbours (negative: none known, which counts as its own).

    Trees of one key, and trees whose root has one left neighbour, hold none: a child's suffixes are its root's. Trees
    of one node are read off; the others take a scan with a stack, where an interval that closes hands its left
    neighbours and smallest key to its parent.
    """
    deep = common >= least
    starts, ends = np.flatnonzero(deep & ~np.r_[False, deep[:-1]]), np.flatnonzero(deep & ~np.r_[deep[1:], False])
    if not len(starts):
        return np.zeros((0, 5), np.int64)
    spans, inner = np.stack([starts - 1, ends + 1], 1).ravel(), np.stack([starts, ends + 1], 1).ravel()

    def extremes(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.r_[v, 0]
        return np.minimum.reduceat(v, at)[::2], np.maximum.reduceat(v, at)[::2]

    low, high = extremes(key, spans)
    side_low, side_high = extremes(left, spans)
    flat_low, flat_high = extremes(common, inner)
    several = (low < high) & ((side_low < 0) | (side_low != side_high))
    flat = np.flatnonzero(several & (flat_low == flat_high))
    out = [np.stack([starts[flat] - 1, ends[flat], flat_low[flat], low[flat], np.zeros(len(flat), np.int64)], 1)]
    found: list[tuple[int, int, int, int, int]] = []
    for tree in np.flatnonzero(several & (flat_low != flat_high)).tolist():
        a, z = int(starts[tree]), int(ends[tree])
        depth, chars, keys = common[a : z + 1].tolist(), left[a - 1 : z + 1].tolist(), key[a - 1 : z + 1].tolist()
        stack: list[list[int]] = []  # depth, first rank, left neighbour, smallest key, largest key
        for i in range(len(depth) + 1):
            d = depth[i] if i < len(depth) else 0
            side, small, large, first = (chars[i] if chars[i] >= 0 else DIVERSE), keys[i], keys[i], i
            while stack and stack[-1][0] > d:
                top = stack.pop()
                top[2] = top[2] if top[2] == side else DIVERSE
                top[3], top[4] = min(top[3], small), max(top[4], large)
                if top[2] == DIVERSE and top[3] < top[4]:
                    above = max(stack[-1][0] if stack else 0, d)
                    found.append((a - 1 + top[1], a - 1 + i, top[0], top[3], above if above >= least else 0))
                side, small, large, first = top[2], top[3], top[4], top[1]
            if d >= least:
                if stack and stack[-1][0] == d:
                    top = stack[-1]
                    top[2] = top[2] if top[2] == side else DIVERSE
                    top[3], top[4] = min(top[3], small), max(top[4], large)
                else:
                    stack.append([d, first, side, small, large])
    out.append(np.array(found, np.int64).reshape(-1, 5))
    return np.concatenate(out)


def gram_hashes(buf: np.ndarray, gram: int, places: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of every `gram` bytes, or of those at some places, eight bytes a step."""
    n = max(0, len(buf) - gram + 1) if places is None else len(places)
    if not n:
        return np.zeros(0, np.uint64)
    out, wide = np.empty(n, np.uint64), np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", wide, 0, (1,))
    steps = [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])] if gram >= 8 else [0]
    for at in range(0, n, core.STEP):
        to = min(n, at + core.STEP)
        words = eight[at : to + steps[-1]].copy() if places is None else None
        h = np.full(to - at, 0x9E3779B97F4A7C15, np.uint64)
        for k in steps:
            own = words[k : k + to - at] if places is None else eight[places[at:to] + k]
            h ^= own & np.uint64((1 << 8 * gram) - 1) if gram < 8 else own
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        out[at:to] = core.mix(h)
    return out


class Extents:
    """The windows of some documents, joined where neighbours have one anchor.

    A window of `length` bytes has as anchor its smallest hash of `gram` bytes, so equal windows have equal
    anchors; a run of windows with one anchor, `start` to `end`, is an extent.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
        grams = gram_hashes(buf, gram)
        at = np.flatnonzero(core.valid(offs, len(buf), length))
        anchor = core.minimizers(grams, length - gram + 1)[at] if len(at) else at
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)] if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.start = at[first]
        self.windows = np.diff(np.r_[first, len(at)])
        self.end = self.start + self.windows + length - 1
        self.anchor, self.hash = anchor[first], grams[anchor[first]]
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.grams, self.gram = grams, gram

    def chosen(self, some: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Keep some extents; those on hot anchors become one extent for each window. Returns which are such."""
        length = int(self.end[0] - self.start[0] - self.windows[0]) + 1 if len(self.end) else 0
        n = np.where(hot, self.windows[some], 1)
        which = np.repeat(some, n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        single = np.repeat(hot, n)
        self.start = self.start[which] + step
        self.end = np.where(single, self.start + length, self.end[which])
        self.windows = np.where(single, 1, self.windows[which])
        self.anchor, self.hash, self.doc = self.anchor[which], self.hash[which], self.doc[which]
        return single

    def identity(self) -> np.ndarray:
        """Hashes of the extents' bytes and the anchors' places in them."""
        size = self.end - self.start
        h = core.mix(size.astype(np.uint64) << np.uint64(32) | (self.anchor - self.start).astype(np.uint64))
        last = self.end - self.gram
        for at in range(0, int(size.max()) if len(size) else 0, self.gram):  # grams that cover the extent, no more of them than it takes
            own = core.mix(h + self.grams[np.minimum(self.start + at, last)])
            h = np.where(at < size, own, h)
        return h


def _size_code(n: np.ndarray) -> np.ndarray:
    """Counts in 7 bits: exact below 64, then by steps of a third of a doubling, rounded down."""
    return np.where(n < 64, n, 64 + np.floor(3 * np.log2(np.maximum(n, 64))).astype(np.int64) - 18)


def _size_of(code: np.ndarray) -> np.ndarray:
    return np.where(code < 64, code, np.exp2((code - 46) / 3).astype(np.int64))


def _gram(length: int) -> int:
    return max(1, length - 26)


def first(length: int, buckets: int) -> Callable:
    """A batch's distinct anchors, which of them two of its documents have, and in about how many extents."""

    def say(t: pa.Table, _) -> pa.Table:
        codes, keys, idents = [], [], []
        for rows, buf, offs in exchange.texts(t):
            x = Extents(buf, offs, length, _gram(length))
            codes.append(exchange.short(x.hash, buckets))
            keys.append(rows.column(rows.schema.get_field_index("key")).to_numpy()[x.doc])
            idents.append(x.identity())
        codes, keys, idents = np.concatenate(codes), np.concatenate(keys), np.concatenate(idents)
        if not len(codes):
            return exchange.messages([])
        order = np.argsort(codes)
        new = np.r_[True, codes[order][1:] != codes[order][:-1]]
        twice = np.flatnonzero(~new | ~np.r_[new[1:], True])
        some = order[twice]
        order[twice] = some[np.lexsort((idents[some], codes[some]))]
        codes, keys, idents = codes[order], keys[order], idents[order]
        at = np.flatnonzero(new)
        several = np.minimum.reduceat(keys, at) != np.maximum.reduceat(keys, at)
        many = _size_code(np.add.reduceat((new | np.r_[True, idents[1:] != idents[:-1]]).astype(np.int64), at))
        seen = (2 * many + several).astype(np.uint8)
        codes = codes[at]
        bucket = (codes >> np.uint64(40)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        spans = zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(codes)].tolist(), strict=True)
        b = t.column("b")[0].as_py()
        return exchange.messages([(b, int(bucket[i]), exchange.pack(codes[i:j], 5) + seen[i:j].tobytes()) for i, j in spans])

    return say


def shared(t: pa.Table) -> pa.Table:
    """Of one bucket of anchors: each batch gets back those that several documents have; hot ones are marked.

    Hot: with over HOT extents in all batches together, such as an edge of a passage that very many documents hold.
    """
    bucket = t.column("bucket")[0].as_py()
    data = t.column("data").to_pylist()
    size = [len(d) // 6 for d in data]
    codes = np.concatenate([exchange.unpack(d[: 5 * n], bucket, 5) for d, n in zip(data, size, strict=True)])
    seen = np.concatenate([np.frombuffer(d, np.uint8, n, 5 * n) for d, n in zip(data, size, strict=True)]).astype(np.int64)
    many, several = _size_of(seen >> 1), seen & 1
    order = np.argsort(codes, kind="stable")
    at = np.flatnonzero(np.r_[True, codes[order][1:] != codes[order][:-1]])
    n = np.diff(np.r_[at, len(codes)])
    hit = (n > 1) | (np.maximum.reduceat(several[order], at) > 0)
    hot = np.add.reduceat(many[order], at) > HOT
    found, warm = np.empty(len(codes), bool), np.empty(len(codes), bool)
    found[order], warm[order] = np.repeat(hit, n), np.repeat(hot, n)
    out, start = [], 0
    for b, n_own in zip(t.column("b").to_pylist(), size, strict=True):
        own = slice(start, start + n_own)
        if found[own].any():
            out.append((b, bucket, exchange.pack(codes[own][found[own]], 5) + warm[own][found[own]].tobytes()))
        start += n_own
    return exchange.messages(out)


def second(length: int, buckets: int) -> Callable:
    """A batch's distinct extents on shared anchors: identity, smallest key, whether several keys have it, windows, part, bytes.

    Extents go to their anchor's bucket. On hot anchors every window is an extent of its own and goes where its own
    hash says, so no anchor's documents meet in one place. The hot anchors themselves are sent on to the batch.
    """

    def say(t: pa.Table, replies: pa.Table) -> pa.Table:
        b = t.column("b")[0].as_py()
        back = [(d, len(d) // 6, k) for d, k in zip(replies.column("data").to_pylist(), replies.column("bucket").to_pylist(), strict=True)]
        if not back:
            return exchange.messages([])
        among = np.concatenate([exchange.unpack(d[: 5 * n], k, 5) for d, n, k in back])
        warm = np.concatenate([np.frombuffer(d, np.uint8, n, 5 * n) for d, n, _ in back]).astype(bool)
        among, hot_codes = np.sort(among), np.sort(among[warm])
        got: list[list] = [[], [], [], [], [], []]
        for rows, buf, offs in exchange.texts(t):
            x = Extents(buf, offs, length, _gram(length))
            codes = exchange.short(x.hash, buckets)
            some = np.flatnonzero(exchange.member(codes, among))
            single = x.chosen(some, exchange.member(codes[some], hot_codes))
            ident = x.identity()
            route = exchange.spread(np.where(single, ident, x.hash))
            keys = rows.column(rows.schema.get_field_index("key")).to_numpy()[x.doc]
            raw = buf.tobytes()
            for k, v in enumerate((core.bucket_of(route, buckets).astype(np.int64), ident, keys, x.windows, route & np.uint64(255))):
                got[k].append(v)
            got[5] += [raw[i:j] for i, j in zip(x.start.tolist(), x.end.tolist(), strict=True)]
        bucket, ident, keys, windows, part = (np.concatenate(v) for v in got[:5])
        if not len(ident):
            return exchange.messages([])
        order = np.lexsort((ident, bucket))
        at = np.flatnonzero(np.r_[True, (ident[order][1:] != ident[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])])
        low, high, one = np.minimum.reduceat(keys[order], at), np.maximum.reduceat(keys[order], at), order[at]
        out, cuts, packer = [], np.flatnonzero(np.diff(bucket[one])) + 1, zstandard.ZstdCompressor(level=3)
        for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(one)], strict=True):
            some = one[i:j]
            data = int(j - i).to_bytes(4, "little") + ident[some].tobytes() + low[i:j].astype("<i8").tobytes() + (low[i:j] != high[i:j]).tobytes() + windows[some].astype(np.uint8).tobytes() + part[some].astype(np.uint8).tobytes()
            out.append((b, int(bucket[some[0]]), packer.compress(data + b"".join(got[5][k] for k in some.tolist()))))
        if len(hot_codes):
            out.append((b, -1 - b, hot_codes.tobytes()))
        return exchange.messages(out)

    return say


def repeated(h: np.ndarray, key: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of windows whose hash several keys have, with different left neighbours (negative: none known): a maximal repeat begins at no others."""
    if not len(h):
        return np.zeros(0, np.int64)
    order = np.argsort(h)
    cuts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    size = np.diff(np.r_[cuts, len(h)])
    cuts, several = cuts[size > 1], np.repeat(size > 1, size)
    order, size = order[several], size[size > 1]
    if not len(order):
        return order
    cuts = np.cumsum(size) - size
    key, left = key[order], left[order]
    low, side = np.minimum.reduceat(left, cuts), np.maximum.reduceat(left, cuts)
    good = (np.minimum.reduceat(key, cuts) < np.maximum.reduceat(key, cuts)) & ((low < 0) | (low != side))
    return np.sort(order[np.repeat(good, size)])


def _spread(best: np.ndarray, some: np.ndarray, twice: np.ndarray, key: np.ndarray, n: np.ndarray, first_at: np.ndarray, begin: np.ndarray, size: np.ndarray, text: np.ndarray, length: int) -> None:
    """Lower `best` of the windows of some extents to the smallest key of the maximal repeats that cover them.

    Only suffixes at which a maximal repeat can begin are sorted: those whose first `length` bytes several keys have.
    """
    again = some[twice[some]]
    ext = np.r_[some, again]
    keys = np.r_[key[some], np.where(key[again] < np.iinfo(np.int64).max, key[again] + 1, key[again])]
    many = n[ext]
    owner = np.repeat(np.arange(len(ext)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[ext][owner] + place
    some = repeated(gram_hashes(text, length, at), keys[owner], np.where(place > 0, text[at - 1].astype(np.int64), NONE))
    owner, place, at = owner[some], place[some], at[some]
    order, common = suffix_array(text, at, size[ext][owner] - place)
    left = np.where(place > 0, text[at - 1].astype(np.int64), NONE)[order]
    found = intervals(common, left, keys[owner][order], length)
    if not len(found):
        return
    # a repeat inside a longer one's interval has the smaller key at most: only windows beyond its length are new
    lo, hi, deep, least, above = found.T
    skip = np.where(above, above - length + 1, 0)
    cuts = np.searchsorted(np.cumsum(hi - lo + 1), np.arange(0, int((hi - lo + 1).sum()), MOST)).tolist()
    for i, j in zip(cuts, [*cuts[1:], len(lo)], strict=True):
        a, wide = lo[i:j], (hi - lo + 1)[i:j]
        member = order[np.repeat(a - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())]
        since = np.repeat(skip[i:j], wide)
        reach = np.maximum(0, np.minimum(np.repeat(deep[i:j] - length + 1, wide), many[owner[member]] - place[member]) - since)
        spot = first_at[ext[owner[member]]] + place[member] + since
        target = np.repeat(spot - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
        np.minimum.at(best, target, np.repeat(np.repeat(least[i:j], wide), reach))


def repeats(length: int) -> Callable:
    """Of one bucket: the suffix array of its distinct extents, its maximal repeats, and for each batch's extents
    the smallest key that any repeat gives their windows, as runs (identity, first window, end, key)."""

    def how(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() < 0:
            return exchange.messages([(t.column("b")[0].as_py(), -1, t.column("data")[0].as_py())])
        idents, lows, severals, windows, parts, texts, counts = [], [], [], [], [], [], []
        for d in map(zstandard.ZstdDecompressor().decompress, t.column("data").to_pylist()):
            n = int.from_bytes(d[:4], "little")
            idents.append(np.frombuffer(d, "<u8", n, 4))
            lows.append(np.frombuffer(d, "<i8", n, 4 + 8 * n))
            severals.append(np.frombuffer(d, np.uint8, n, 4 + 16 * n))
            windows.append(np.frombuffer(d, np.uint8, n, 4 + 17 * n).astype(np.int64))
            parts.append(np.frombuffer(d, np.uint8, n, 4 + 18 * n))
            texts.append(np.frombuffer(d, np.uint8, offset=4 + 19 * n))
            counts.append(n)
        ident, low, window, part, text = (np.concatenate(v) for v in (idents, lows, windows, parts, texts))
        size = window + length - 1
        begin = np.cumsum(size) - size
        distinct, one, which = np.unique(ident, return_index=True, return_inverse=True)
        key = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(key, which, low)
        # several documents with one extent: a second suffix with another key, so that the extent repeats by itself
        most = np.full(len(distinct), np.iinfo(np.int64).min)
        np.maximum.at(most, which, low + np.concatenate(severals))
        twice = most > key
        n = window[one]
        first_at = np.cumsum(n) - n
        best = np.full(int(n.sum()), np.iinfo(np.int64).max)
        # equal windows have equal anchors, so equal parts: a few parts at a time, about MOST suffixes together
        order = np.argsort(part[one], kind="stable")
        load = np.cumsum((n * (1 + twice))[order])
        ranks = part[one][order]
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + MOST, "right")))
            to = max(int(np.searchsorted(ranks, ranks[to], "left")) if to < len(ranks) else to, int(np.searchsorted(ranks, ranks[at], "right")))
            _spread(best, order[at:to], twice, key, n, first_at, begin[one], size[one], text, length)
            at = to
        out = []
        at = 0
        for b, own, low_b, sev, count in zip(t.column("b").to_pylist(), idents, lows, severals, counts, strict=True):
            which_b = which[at : at + count]
            at += count
            w = n[which_b]
            spot = np.repeat(first_at[which_b] - np.cumsum(w) + w, w) + np.arange(w.sum())
            value, holder = best[spot], np.repeat(np.arange(count), w)
            new = np.r_[True, (value[1:] != value[:-1]) | (holder[1:] != holder[:-1])] if len(value) else np.zeros(0, bool)
            i = np.flatnonzero(new)
            j = np.r_[i[1:], len(value)]
            base = (np.cumsum(w) - w)[holder[i]]
            useful = (value[i] < low_b[holder[i]]) | ((value[i] == low_b[holder[i]]) & (sev[holder[i]] > 0))
            i, j, base = i[useful], j[useful], base[useful]
            if len(i):
                out.append((b, 0, len(i).to_bytes(4, "little") + own[holder[i]].tobytes() + value[i].astype("<i8").tobytes() + (i - base).astype(np.uint8).tobytes() + (j - base).astype(np.uint8).tobytes()))
        return exchange.messages(out)

    return how


ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(length: int, buckets: int, digest: bool) -> Callable:
    def end(t: pa.Table, replies: pa.Table) -> pa.Table:
        got: list[list] = [[], [], [], []]
        hot = np.zeros(0, np.uint64)
        for d, kind in zip(replies.column("data").to_pylist(), replies.column("bucket").to_pylist(), strict=True):
            if kind < 0:
                hot = np.frombuffer(d, "<u8")
                continue
            n = int.from_bytes(d[:4], "little")
            for k, (kind, at) in enumerate((("<u8", 4), ("<i8", 4 + 8 * n), (np.uint8, 4 + 16 * n), (np.uint8, 4 + 17 * n))):
                got[k].append(np.frombuffer(d, kind, n, at))
        ident, value, i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in got)
        order = np.argsort(ident, kind="stable")
        ident, value, i, j = ident[order], value[order], i[order].astype(np.int64), j[order].astype(np.int64)
        out: list[list] = [[], [], [], [], []]
        for rows, buf, offs in exchange.texts(t):
            edge = np.zeros(len(buf) + 1, np.int64)
            if len(ident):
                x = Extents(buf, offs, length, _gram(length))
                if len(hot):
                    x.chosen(np.arange(len(x.start)), exchange.member(exchange.short(x.hash, buckets), hot))
                own = x.identity()
                lo, many = np.searchsorted(ident, own, "left"), np.zeros(len(own), np.int64)
                some = np.flatnonzero(ident[np.minimum(lo, len(ident) - 1)] == own)
                many[some] = np.searchsorted(ident, own[some], "right") - lo[some]
                hit = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                ext = np.repeat(np.arange(len(own)), many)
                keys = rows.column(rows.schema.get_field_index("key")).to_numpy()[x.doc[ext]]
                later = value[hit] < keys
                hit, ext = hit[later], ext[later]
                np.add.at(edge, x.start[ext] + i[hit], 1)
                np.add.at(edge, x.start[ext] + j[hit] - 1 + length, -1)
            cover = np.cumsum(edge[:-1]) > 0
            total = np.r_[0, np.cumsum(cover)]
            begins = cover & ~np.r_[False, cover[:-1]]
            full = offs[:-1][offs[1:] > offs[:-1]]
            begins[full] = cover[full]
            spans = np.r_[0, np.cumsum(begins)]
            raw = buf.tobytes()
            out[0] += rows.column(rows.schema.get_field_index("id")).to_pylist()
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                out[1].append(b - a)
                out[2].append(int(total[b] - total[a]))
                out[3].append(int(spans[b] - spans[a]))
                left = raw[a:b] if not out[2][-1] else buf[a:b][~cover[a:b]].tobytes()
                out[4].append(hashlib.sha256(left).digest() if digest else left)
        done = pa.table([pa.array(v, f.type) for v, f in zip(out, ARROW, strict=True)], schema=ARROW)
        for name in t.column_names[4:]:
            done = done.append_column(name, t.column(name))
        return done

    return end


def suffix_dedup(docs: DataFrame, length: int = LENGTH, digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): bytes left of each text after removing those covered by a string of
    `length` bytes that also starts in a document with a smaller doc_id.

    docs needs doc_id and text; of other columns those in `carry` are returned too. Null and empty texts have no bytes. Rows of one doc_id do not
    affect each other; a null doc_id counts as larger than all others. Bytes left may end amid a character. An empty
    table gives an empty result. Candidates meet at anchors (every string of `length` bytes has one, chosen
    by its own bytes); there, suffix arrays decide by the bytes themselves.
    """
    rows, buckets = exchange.batched(docs, carry)
    anchors = exchange.answered(exchange.ask(rows, None, first(length, buckets)), shared)
    found = exchange.answered(exchange.ask(rows, anchors, second(length, buckets)), repeats(length))
    more = rows.select(*rows.columns[4:]).schema
    kinds = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", *(f"`{f.name}` {f.dataType.simpleString()}" for f in more)])
    arrow = pa.schema([*ARROW, *to_arrow_schema(more)])
    done = exchange.close(rows, found, _cut(length, buckets, digest), kinds, arrow)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", *(F.col(f.name).alias(name) for f, name in zip(more, carry, strict=True)))


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The maximal repeats of a few texts: (length, all (text, place) occurrences). For reports and tests."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(x) for x in texts])
    doc = np.searchsorted(ends, np.arange(len(text)), "right")
    size = ends[doc] - np.arange(len(text)) if len(text) else np.zeros(0, np.int64)
    order, common = suffix_array(text, np.arange(len(text)), size)
    start = np.r_[0, ends[:-1]][doc] if len(text) else doc
    left = np.where(np.arange(len(text)) > start, np.r_[0, text[:-1]], NONE)[order] if len(text) else order
    found = intervals(common, left, np.arange(len(text))[order], least)
    return [(deep, sorted((int(doc[p]), int(p - start[p])) for p in order[lo : hi + 1])) for lo, hi, deep, *_ in found.tolist()]


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(core.table(spark, sf_dir, "documents"), digest=True).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "lower(hex(kept)) AS kept_sha256")
