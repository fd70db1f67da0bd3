"""Lossless WebP (VP8L): a complete decoder of the format, written from its public description.

Streams of one group of codes without a cache (with prefix codes and references) are read by arrays, many files at once;
those with a cache or several groups symbol by symbol.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Sequence

import numpy as np

# Fixed values of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (dx, dy) of the short distance codes 1 to 120.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD
PREDICT, CROSS, GREEN, PALETTE = range(4)


class Bits:
    """Bits from the low end of each byte on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, 8 * at

    def read(self, n: int) -> int:
        a = self.at >> 3
        v = int.from_bytes(self.data[a : a + 5 + (n >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return v


class Code:
    """A canonical prefix code. Its table holds symbol * 16 + length at every window of `top` bits; one symbol takes no bits."""

    def __init__(self, lengths: Sequence[int]):
        own = np.array(lengths, np.uint8)
        used = own.nonzero()[0]
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.top, self.only = 0, int(used[0])
            self.table = np.array([self.only << 4], np.int32)
            return
        own = own[used]
        order = own.argsort(kind="stable")
        own = own[order]
        self.top, self.only = int(own[-1]), None
        many = _POWERS[self.top - own]
        if int(many.sum()) != 1 << self.top:
            raise ValueError("an incomplete prefix code")
        # by ascending codes each symbol has 2**(top - length) windows in a row, whose first bit is the highest
        self.table = (used[order] << 4 | own).astype(np.int32).repeat(many)[_TURNED[self.top]]


_REVERSED = np.zeros(1 << 15, np.int64)
for _k in range(15):
    _REVERSED |= (np.arange(1 << 15) >> _k & 1) << (14 - _k)
_TURNED = [_REVERSED[: 1 << _k] >> (15 - _k) for _k in range(16)]
_POWERS = 1 << np.arange(16)


@functools.cache
def single(symbol: int) -> Code:
    """The code of one symbol."""
    return Code([0] * symbol + [1])


def canonical_bits(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits as they are written, and lengths, of symbols (ascending) with these lengths above 0, the codes in order of length."""
    order = np.argsort(lengths, kind="stable")
    n = lengths[order].astype(np.int64)
    begin = np.cumsum(1 << (15 - n)) - (1 << (15 - n))  # codes as fractions of 2**15
    out = np.empty(len(n), np.int64)
    out[order] = _REVERSED[begin]
    return out, lengths.astype(np.int64)


def canonical(lengths: Sequence[int]) -> dict[int, tuple[int, int]]:
    """(bits as they are written, length) of each symbol."""
    own = np.asarray(lengths)
    used = np.flatnonzero(own)
    return {s: v for s, *v in zip(used.tolist(), *(x.tolist() for x in canonical_bits(own[used])), strict=True)}


def symbol(bits: Bits, c: Code) -> int:
    at = bits.at >> 3
    e = int(c.table[int.from_bytes(bits.data[at : at + 3], "little") >> (bits.at & 7) & ((1 << c.top) - 1)])
    bits.at += e & 15
    return e >> 4


def _short_table(lengths: list[int]) -> list[int]:
    """The table (see `Code`) of a code of lengths, of 7 bits at most."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return Code(lengths).table.tolist()
    top, windows = used[-1][0], []
    for n, s in used:
        windows += [s << 4 | n] * (1 << (top - n))
    if len(windows) != 1 << top:
        raise ValueError("an incomplete prefix code")
    return [windows[i] for i in _SHORT[top]]


_SHORT = [x.tolist() for x in _TURNED[:8]]


def read_code(bits: Bits, size: int) -> Code:
    """A code's lengths: of one or two symbols plainly, else by a code of lengths with runs."""
    if bits.read(1):
        n, wide = bits.read(1) + 1, bits.read(1)
        first = bits.read(8 if wide else 1)
        if n == 1 or (second := bits.read(8)) == first:
            if first >= size:
                raise ValueError("a symbol beyond the alphabet")
            return single(first)
        lengths = [0] * size
        lengths[first] = lengths[second] = 1
        return Code(lengths)
    lengths, own = [0] * size, [0] * 19
    shown = 4 + bits.read(4)
    given = bits.read(3 * shown)
    for i in range(shown):
        own[LENGTH_ORDER[i]] = given >> 3 * i & 7
    table = _short_table(own)
    most = size
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
    mask, before = len(table) - 1, 8
    byte = bits.at >> 3
    rest = int.from_bytes(bits.data[byte : byte + 2 * size + 16], "little") >> (bits.at & 7)
    at = taken = 0
    while at < size and most > 0:
        most -= 1
        e = table[rest & mask]
        n, s = e & 15, e >> 4
        rest >>= n
        taken += n
        if s < 16:
            lengths[at] = s
            before, at = s or before, at + 1
        else:
            k, value, least = ((2, before, 3), (3, 0, 3), (7, 0, 11))[s - 16]
            n = least + (rest & ((1 << k) - 1))
            rest >>= k
            taken += k
            if at + n > size:
                raise ValueError("a run of lengths beyond the alphabet")
            lengths[at : at + n] = [value] * n
            at += n
    bits.at += taken
    return Code(lengths)


def _extent(bits: Bits, prefix: int) -> int:
    """Lengths and distances by prefix and extra bits."""
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


class Stream:
    """An entropy-coded image whose codes are read and whose symbols are not: where they begin, and what they are read by."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("a colour cache of more than 11 bits")
        self.width, self.height, self.which, self.block, groups = width, height, None, 0, 1
        if main and bits.read(1):
            self.block = bits.read(3) + 2
            self.which = (read_image(bits, -(-width >> self.block), -(-height >> self.block)) >> 8) & 0xFFFF
            groups = int(self.which.max()) + 1
        cache_size = 1 << self.cache_bits if self.cache_bits else 0
        self.codes = [[read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
        self.bits = bits

    @property
    def plain(self) -> bool:
        """One group of codes and no cache, so that what a symbol is doesn't depend on what came before; and pixels take bits."""
        return not self.cache_bits and len(self.codes) == 1 and any(c.only is None for c in self.codes[0][:4])

    def pixels(self) -> np.ndarray:
        """ARGB values, symbol by symbol; of an image of one colour, whose pixels take no bits, at once."""
        only = [c.only for c in self.codes[0][:4]]
        if not self.cache_bits and len(self.codes) == 1 and None not in only and only[0] < 256:
            return np.full((self.height, self.width), only[3] << 24 | only[1] << 16 | only[0] << 8 | only[2], np.uint32)
        got = _read_symbols(self.bits, self.codes, self.which, self.block, self.width, self.width * self.height, self.cache_bits)
        return np.array(got, np.uint32).reshape(self.height, self.width)


def read_image(bits: Bits, width: int, height: int) -> np.ndarray:
    """ARGB values of a small image that a transform or the groups of codes need; bits stand after it."""
    return Stream(bits, width, height, False).pixels()


# Extra bits and least values of lengths and distances by prefix.
_EXTRA = np.array([0] * 4 + [(p - 2) >> 1 for p in range(4, 40)], np.int64)
_LEAST = np.array([1, 2, 3, 4] + [((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(4, 40)], np.int64)
_NEAR = np.array(NEAR, np.int64)
#: Bytes of streams whose bits are looked at together.
SPAN = 1 << 16
#: Bytes of these whose every bit is looked at in one step, few enough for a cache.
LOOK = 1 << 14
#: Bits of a symbol at most, with the extra bits of a reference or the codes of a pixel, and more.
REACH = 128


def read_streams(streams: list[Stream]) -> list[np.ndarray]:
    """ARGB pixels of plain streams, many at once.

    What symbol stands at a bit, and where the next one begins, is looked up for every bit of some streams by arrays; then
    each stream is followed from its first bit. A long stream is taken in spans.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(streams):
        to, size = at, 0
        while to < len(streams) and (to == at or size < SPAN):
            size += len(streams[to].bits.data) - (streams[to].bits.at >> 3)
            to += 1
        out += _read_group(streams[at:to])
        at = to
    return out


def _read_group(streams: list[Stream]) -> list[np.ndarray]:
    parts = [s.bits.data[s.bits.at >> 3 :] for s in streams]
    sizes = np.array([len(p) + 8 for p in parts])
    begin = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(p + b"\0" * 8 for p in parts) + b"\0" * 64, np.uint8).astype(np.uint32)
    window = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    tables = [np.concatenate([s.codes[0][k].table for s in streams]) for k in range(5)]
    masks = [np.array([len(s.codes[0][k].table) - 1 for s in streams], np.uint32) for k in range(5)]
    starts = [np.cumsum(m.astype(np.int64) + 1) - m - 1 for m in masks]
    owner = np.repeat(np.arange(len(streams)), sizes)
    coded = [k for k in (1, 2, 3) if any(s.codes[0][k].only is None for s in streams)]

    def look(k: int, at: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Entries of the k-th codes' tables, or of another table by their places, at some bits."""
        byte = at >> 3
        whose = owner[byte]
        return (tables[k] if table is None else table)[starts[k][whose] + (window[byte] >> (at & 7).astype(np.uint32) & masks[k][whose])]

    def number(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (window[at >> 3] >> (at & 7).astype(np.uint32)).astype(np.int64) & ((1 << n) - 1)

    # bits of a symbol, or of a reference's length and its extra bits (128 more), and of a distance, by the tables' places
    kind = tables[0] >> 4
    wide = ((tables[0] & 15) + np.where(kind < 256, 0, 128 + _EXTRA[np.clip(kind - 256, 0, 39)])).astype(np.uint8)
    far_wide = ((tables[4] & 15) + _EXTRA[np.minimum(tables[4] >> 4, 39)]).astype(np.int32)
    found: list[list[np.ndarray]] = [[], []]  # places and entries of all symbols
    now = np.array([8 * int(b) + (s.bits.at & 7) for b, s in zip(begin, streams, strict=True)])
    ends = 8 * (begin + sizes - 8)
    total = int(sizes.sum())
    last = 8 * total - 1
    for lo in range(0, total, LOOK):
        hi = min(total, lo + LOOK)
        whose = owner[lo:hi]
        at = window[lo:hi, None] >> np.arange(8, dtype=np.uint32)
        at &= masks[0][whose][:, None]
        at += starts[0][whose].astype(np.uint32)[:, None]
        at = at.ravel()
        bits = wide.take(at)
        base, size = 8 * lo, 8 * (hi - lo)
        step = np.arange(size + REACH, dtype=np.int32)  # what begins after the span stays where it is
        step[:size] += bits & 127
        ref = np.flatnonzero(bits > 127)
        spot = np.minimum(step[ref].astype(np.int64) + base, last)
        for k in coded:
            step[:size] += look(k, np.minimum(step[:size].astype(np.int64) + base, last)) & 15
        step[ref] = spot - base + look(4, spot, far_wide)
        # steps of two, four and eight symbols; every eighth symbol is followed one by one, those between come by arrays
        two = step[step]
        four = two[two]
        eight = memoryview(four[four])
        every, cuts = [], [0]
        add, these = every.append, slice(int(owner[lo]), int(owner[hi - 1]) + 1)
        stop = np.minimum(ends[these], 8 * hi) - base
        for p, end in zip((now[these] - base).tolist(), stop.tolist(), strict=True):
            while p < end:
                add(p)
                p = eight[p]
            cuts.append(len(every))
        chain = np.empty((len(every), 8), np.int32)
        chain[:, 0] = every
        chain[:, 4] = four[chain[:, 0]]
        chain[:, 2::4] = two[chain[:, ::4]]
        chain[:, 1::2] = step[chain[:, ::2]]
        inside = chain < np.repeat(stop, np.diff(cuts))[:, None]
        reached = np.r_[0, np.cumsum(inside.sum(axis=1))][cuts]
        chain = chain[inside]
        some = np.flatnonzero(reached[1:] > reached[:-1])
        now[these.start + some] = step[chain[reached[1:][some] - 1]].astype(np.int64) + base
        found[0].append(chain.astype(np.int64) + base)
        found[1].append(tables[0][at[chain]])
    place, entry = (np.concatenate(x) for x in found)
    kind = entry >> 4
    is_ref = kind >= 256
    spot = place[is_ref] + (entry[is_ref] & 15)
    prefix = np.minimum(kind[is_ref] - 256, 39)
    length = _LEAST[prefix] + number(np.minimum(spot, last), _EXTRA[prefix])
    spot = np.minimum(spot + _EXTRA[prefix], last)
    got = look(4, spot)
    prefix = np.minimum(got >> 4, 39)
    distance = _LEAST[prefix] + number(np.minimum(spot + (got & 15), last), _EXTRA[prefix])
    size = np.ones(len(place), np.int64)
    size[is_ref] = length
    reached = np.r_[0, np.cumsum(size)]
    cuts = np.searchsorted(place, np.r_[8 * begin, 8 * total])
    goals = np.array([s.width * s.height for s in streams])
    stop = np.searchsorted(reached, reached[cuts[:-1]] + goals)  # one after the last symbol that counts
    if (stop > cuts[1:]).any() or (reached[stop] != reached[cuts[:-1]] + goals).any() or ((stop == cuts[1:]) & (now > ends)).any():
        raise ValueError("the stream ends early, or a reference is outside the image")
    whose = np.repeat(np.arange(len(streams)), stop - cuts[:-1])
    some = np.arange(len(whose)) + (cuts[:-1] - np.r_[0, np.cumsum(stop - cuts[:-1])[:-1]])[whose]
    r = (np.cumsum(is_ref) - 1)[some[is_ref[some]]]
    place, kind, is_ref, size, length, distance = place[some], kind[some], is_ref[some], size[some], length[r], distance[r]
    x, y = _NEAR[np.minimum(distance, 120) - 1].T
    far = np.where(distance > 120, distance - 120, np.maximum(1, x + y * np.array([s.width for s in streams])[whose[is_ref]]))
    pixel = kind[~is_ref].astype(np.uint32) << np.uint32(8)
    if coded:
        spot = place[~is_ref]
        spot = spot + (look(0, spot) & 15)
    for k, shift in ((1, 16), (2, 0), (3, 24)):
        if k in coded:
            got = look(k, spot)
            pixel |= (got >> 4).astype(np.uint32) << np.uint32(shift)
            spot = spot + (got & 15)
        else:
            pixel |= (np.array([s.codes[0][k].only for s in streams], np.uint32) << np.uint32(shift))[whose[~is_ref]]
    begin = np.cumsum(goals) - goals
    pixel = _copied(pixel, is_ref, size, far, begin[whose[is_ref]])
    return [pixel[a : a + n].reshape(s.height, s.width) for s, a, n in zip(streams, begin.tolist(), goals.tolist(), strict=True)]


def _copied(literal: np.ndarray, is_ref: np.ndarray, size: np.ndarray, far: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Pixels of symbols: literals, and references to what stands `far` before, not before their image's begin.

    Each pixel's source is followed to a literal for all at once, by sources of sources.
    """
    start = np.cumsum(size) - size
    if (start[is_ref] - far < begin).any():
        raise ValueError("a reference outside the image")
    n = int(size.sum())
    back = np.zeros(len(size), np.int32)
    back[is_ref] = far
    source = np.arange(n, dtype=np.int32)
    source -= np.repeat(back, size)
    left = np.flatnonzero(np.repeat(is_ref, size))
    which = np.zeros(n, np.int32)  # of literals, their number
    which[start[~is_ref]] = np.arange(len(literal))
    known = np.ones(n, bool)
    known[left] = False
    while len(left):
        at = source[left]
        further = ~known[at]
        source[left] = source[at]
        left = left[further]
    return literal[which[source]]


def _read_symbols(bits: Bits, codes: list[list[Code]], which, block: int, width: int, total: int, cache_bits: int) -> list[int]:
    out: list[int] = []
    cache, seen = [0] * (1 << cache_bits if cache_bits else 0), 0
    shift = 32 - cache_bits

    def caught_up() -> None:
        nonlocal seen
        if cache_bits:
            for v in out[seen:]:
                cache[(HASH * v & 0xFFFFFFFF) >> shift] = v
        seen = len(out)

    while (at := len(out)) < total:
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
        group = codes[0] if which is None else codes[int(which[(at // width) >> block, (at % width) >> block])]
        s = symbol(bits, group[0])
        if s < 256:
            red, blue, alpha = (symbol(bits, group[k]) for k in (1, 2, 3))
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            n = _extent(bits, s - 256)
            d = _extent(bits, symbol(bits, group[4]))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a reference outside the image")
            if d >= n:
                out += out[at - d : at - d + n]
            else:
                for k in range(n):
                    out.append(out[at - d + k])
        else:
            caught_up()
            out.append(cache[s - 280])
    return out


def _bytes(argb: np.ndarray) -> np.ndarray:
    """... x 4 bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(*argb.shape, 4)


def _average(a, b):
    return (a + b) >> 1


def _predicted(mode: int, left, top, corner, right):
    """One pixel's prediction by channel (lists of four numbers)."""
    if mode == 0:
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        by_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
        return left if by_left < by_top else top
    clamp = lambda v: min(255, max(0, v))
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in ((_average(a, b), c) for a, b, c in zip(left, top, corner, strict=True))]
    pair = {5: lambda a, t, c, r: _average(_average(a, r), t), 6: lambda a, t, c, r: _average(a, c), 7: lambda a, t, c, r: _average(a, t), 8: lambda a, t, c, r: _average(c, t), 9: lambda a, t, c, r: _average(t, r), 10: lambda a, t, c, r: _average(_average(a, c), _average(t, r))}
    f = pair.get(mode)
    if f is None:
        return [0, 0, 0, 255]
    return [f(a, t, c, r) for a, t, c, r in zip(left, top, corner, right, strict=True)]


def predict(argb: np.ndarray, modes: np.ndarray, block: int, inverse: bool = True) -> np.ndarray:
    """Add each pixel's prediction from its decoded neighbours, or (encoding) take it away."""
    height, width = argb.shape
    given = _bytes(argb).tolist()
    known = [[None] * width for _ in range(height)] if inverse else given
    out = [[None] * width for _ in range(height)]
    for y in range(height):
        for x in range(width):
            if x == 0 and y == 0:
                p = [0, 0, 0, 255]
            elif y == 0:
                p = known[0][x - 1]
            elif x == 0:
                p = known[y - 1][0]
            else:
                right = known[y - 1][x + 1] if x + 1 < width else known[y][0]
                p = _predicted(int(modes[y >> block, x >> block] >> 8) & 15, known[y][x - 1], known[y - 1][x], known[y - 1][x - 1], right)
            out[y][x] = [(a + b if inverse else a - b) & 255 for a, b in zip(given[y][x], p, strict=True)]
            if inverse:
                known[y][x] = out[y][x]
    return np.array(out, np.uint8).view("<u4").reshape(height, width)


def cross_colour(argb: np.ndarray, elements: np.ndarray, block: int, inverse: bool = True) -> np.ndarray:
    """Add (or take away) the parts of red and blue that green and red explain."""
    height, width = argb.shape
    e = _bytes(elements)[np.arange(height)[:, None] >> block, np.arange(width)[None] >> block].astype(np.int8).astype(np.int32)
    p = _bytes(argb).astype(np.int32)
    signed = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int32)
    green = signed(p[..., 1])
    sign = 1 if inverse else -1
    red = p[..., 2] + sign * ((e[..., 0] * green) >> 5)
    of = signed(red if inverse else p[..., 2])
    blue = p[..., 0] + sign * (((e[..., 1] * green) >> 5) + ((e[..., 2] * of) >> 5))
    return np.stack([blue & 255, p[..., 1], red & 255, p[..., 3]], -1).astype(np.uint8).view("<u4").reshape(height, width)


def subtract_green(argb: np.ndarray, inverse: bool = True) -> np.ndarray:
    p = _bytes(argb).copy()
    g = p[..., 1] if inverse else (256 - p[..., 1].astype(np.int32)).astype(np.uint8)
    p[..., 0] += g
    p[..., 2] += g
    return p.view("<u4").reshape(argb.shape)


def palette(argb: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Indices, several to a pixel where the table is small, to the table's colours."""
    bits = _palette_bits(len(table))
    index = (argb >> 8) & 255
    if bits:
        each = 8 >> bits
        index = (index[..., None] >> (np.arange(1 << bits) * each)) & ((1 << each) - 1)
        index = index.reshape(len(argb), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def _palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def _opened(data: bytes) -> tuple[Stream, list]:
    """A lossless WebP file's main image, its symbols not yet read, and what undoes the transforms, the last first."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if len(data) < 20 + size:
        raise ValueError("the file ends early")
    bits = Bits(data[20 : 20 + size], 1)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICT, CROSS):
            block = bits.read(3) + 2
            part = read_image(bits, -(-now >> block), -(-height >> block))
            undo.append((lambda v, p=part, b=block: predict(v, p, b)) if kind == PREDICT else (lambda v, p=part, b=block: cross_colour(v, p, b)))
        elif kind == GREEN:
            undo.append(subtract_green)
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_bytes(read_image(bits, n, 1)[0]), axis=0, dtype=np.uint8).view("<u4").ravel()
            undo.append(lambda v, t=table, w=now: palette(v, t, w))
            now = -(-now >> _palette_bits(n))
    return Stream(bits, now, height, True), undo[::-1]


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels, height x width, of lossless WebP files."""
    opened = [_opened(f) for f in files]
    quick = iter(read_streams([s for s, _ in opened if s.plain]))
    out = []
    for stream, undo in opened:
        argb = next(quick) if stream.plain else stream.pixels()
        for f in undo:
            argb = f(argb)
        out.append(argb)
    return out


def decode(data: bytes) -> np.ndarray:
    return decode_all([data])[0]


class Writer:
    def __init__(self):
        self.value, self.n, self.out = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        while self.n >= 8:
            self.out.append(self.value & 255)
            self.value >>= 8
            self.n -= 8



def container(body: bytes) -> bytes:
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
