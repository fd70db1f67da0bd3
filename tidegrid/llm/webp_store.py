"""An encoder of grey images as lossless WebP: Huffman codes, back-references, and the transform that gives fewer bytes.

Grey pixels (red = green = blue) lose red and blue by the subtract-green transform, so each sample is one green symbol.
Images of few grey values are also tried with the palette transform, which lays 2, 4 or 8 samples in a symbol. All
payloads of a batch are matched, coded and written together, by arrays.
"""

from __future__ import annotations

import struct

import numpy as np

from . import webp

#: Samples of a shortest reference, of a longest one, and the farthest distance.
SHORT, LONG, FAR = 5, 4096, (1 << 20) - 120
#: Longest code of a green symbol or a distance.
DEEPEST = 11
#: Samples of an image that are matched together; references don't reach into an earlier block. Images are matched with
#: others up to so many samples, few enough for a cache.
BLOCK, TOGETHER = 1 << 17, 1 << 15
#: Distances from which a reference has to be longer by one to be worth its extra bits.
DEAR = (1 << 13, 1 << 17)
U = np.uint64


def huffman(counts: np.ndarray, deepest: int) -> np.ndarray:
    """Code lengths of each row's symbols with these counts (0: none), `deepest` at most; a single symbol has length 1."""
    used = np.count_nonzero(counts, axis=1)
    out = np.where(used[:, None] == 1, counts > 0, 0).astype(np.int64)
    weight, rows = counts.astype(np.int64), np.flatnonzero(used > 1)
    while len(rows):
        rows = rows[np.argsort(-used[rows], kind="stable")]
        depth = _depths(weight[rows], used[rows])
        fine = depth.max(axis=1) <= deepest
        out[rows[fine]] = depth[fine]
        rows = rows[~fine]
        weight[rows] = np.where(weight[rows] > 0, (weight[rows] >> 1) + 1, 0)
    return out


def _depths(weight: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Depths in each row's Huffman tree, all rows' trees made step by step together; rows by their number of symbols, most first."""
    n, top, none = len(weight), int(used[0]), 1 << 62
    own = np.where(weight > 0, weight, none)
    order = np.argsort(own, axis=1, kind="stable")[:, :top]
    leaves, nodes = np.full((top + 1, n), none), np.full((top + 1, n), none)
    leaves[:top] = np.take_along_axis(own, order, 1).T
    leaf_up, node_up = np.zeros((top + 1, n), np.int64), np.zeros((top + 1, n), np.int64)
    flat = [x.ravel() for x in (leaves, nodes, leaf_up, node_up)]
    row = np.arange(n)
    leaf, node = row.copy(), row.copy()
    live = np.searchsorted(-used, -np.arange(1, top + 1), "right")  # rows with so many symbols or more
    for at in range(top - 1):
        many = live[at + 1]
        x, y, total = leaf[:many], node[:many], 0
        for _ in range(2):
            a, b = flat[0][x], flat[1][y]
            total = total + np.minimum(a, b)
            flat[2][x] = at  # what isn't taken now is written again
            flat[3][y] = at
            first = a <= b
            x += n * first
            y += n * ~first
        nodes[at, :many] = total
    depth = np.zeros((top + 1, n), np.int64)
    deep = depth.ravel()
    for at in range(top - 3, -1, -1):
        many = live[at + 2]
        depth[at, :many] = deep[node_up[at, :many] * n + row[:many]] + 1
    out = np.zeros(weight.shape, np.int64)
    np.put_along_axis(out, order, (deep[leaf_up[:top] * n + row] + 1).T, 1)
    out[weight == 0] = 0
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits as they are written, and their number, of each row's symbols with these lengths; a single symbol takes none."""
    order = np.argsort(np.where(lengths > 0, lengths, 16).astype(np.uint8), axis=1, kind="stable")
    own = np.take_along_axis(lengths, order, 1)
    part = np.where(own > 0, 1 << (15 - own), 0)
    bits = np.zeros(lengths.shape, U)
    np.put_along_axis(bits, order, np.where(own > 0, webp._REVERSED[(np.cumsum(part, 1) - part) & 0x7FFF], 0).astype(U), 1)
    several = np.count_nonzero(lengths, axis=1)[:, None] > 1
    return np.where(several, bits, U(0)), np.where(several, lengths, 0)


_ORDER = np.array(webp.LENGTH_ORDER)


def code_bits(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bits, how many) in order that describe each row's code: of one or two symbols plainly, else by a code of lengths with runs."""
    n, size = lengths.shape
    used = np.count_nonzero(lengths, axis=1)
    first, last = (lengths > 0).argmax(axis=1), size - 1 - (lengths[:, ::-1] > 0).argmax(axis=1)
    plain = (used <= 2) & (last < 256)
    value = 1 | (used - 1) << 1 | 1 << 2 | first << 3 | np.where(used == 2, last << 11, 0)
    short = np.flatnonzero(plain), value[plain].astype(U), np.where(used == 2, 19, 11)[plain]
    rows = np.flatnonzero(~plain)
    if not len(rows):
        return short
    own = lengths[rows]
    edge = np.ones(own.shape, bool)
    edge[:, 1:] = own[:, 1:] != own[:, :-1]
    cut = np.flatnonzero(edge.ravel())
    v, many, of = own.ravel()[cut], np.diff(np.r_[cut, own.size]), cut // size
    # a run of lengths may repeat the last one that wasn't 0, which is the run's before or the one's before that
    before = np.full(len(v), 8)
    for back in (2, 1):
        same = np.flatnonzero((of[back:] == of[:-back]) & (v[:-back] > 0)) + back
        before[same] = v[same - back]
    lead = (v > 0) & (v != before)
    left, most = many - lead, np.where(v > 0, 6, 138)
    full, rest = left // most, left % most
    parts = np.stack([lead, full, rest >= 3, np.where(rest < 3, rest, 0)], 1).ravel()
    run, kind = np.divmod(np.repeat(np.arange(len(parts)), parts), 4)
    v, rest, of = v[run], rest[run], of[run]
    literal, long = (kind == 0) | (kind == 3), np.where(kind == 1, most[run], rest)
    symbol = np.where(literal, v, np.where(v > 0, 16, np.where(long >= 11, 18, 17)))
    extra = np.where(literal, 0, long - np.where(symbol == 18, 11, 3))
    wide = np.where(literal, 0, np.where(symbol == 16, 2, np.where(symbol == 18, 7, 3)))
    by = huffman(np.bincount(of * 19 + symbol, minlength=19 * len(rows)).reshape(-1, 19), 7)
    shown = np.maximum(4, 19 - (by[:, _ORDER[::-1]] > 0).argmax(axis=1))
    # after the code of lengths a bit says that all symbols of the alphabet follow
    head = (shown - 4 << 1).astype(U) | (by[:, _ORDER].astype(U) << (5 + 3 * np.arange(19)).astype(U)).sum(axis=1, dtype=U)
    bits, wides = canonical(by)
    token, taken = bits[of, symbol], wides[of, symbol]
    out = np.r_[short[0], rows, rows[of]], np.r_[short[1], head, token | extra.astype(U) << taken.astype(U)], np.r_[short[2], 6 + 3 * shown, taken + wide]
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


def _pieces(rows: np.ndarray, values: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bits, how many) of whole numbers of any width."""
    own = [(r, value >> at & ((1 << 60) - 1), min(60, many - at)) for r, (value, many) in zip(rows, values, strict=True) for at in range(0, many, 60)]
    a, b, c = zip(*own, strict=True)
    return np.array(a), np.array(b, U), np.array(c)


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits' value and their number of lengths or distances (1 and more)."""
    v = v.astype(np.int64) - 1
    n = np.maximum(np.log2(np.maximum(v, 1)).astype(np.int64) - 1, 0)
    small = v < 4
    return np.where(small, v, 2 * (n + 1) + (v >> n & 1)), np.where(small, 0, v & ((1 << n) - 1)), np.where(small, 0, n)


def references(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy tokens of data, whose images begin at cuts: their places, lengths (1: a literal) and distances (0).

    A sample's last earlier place with the same SHORT samples is its neighbour when both are sorted by them; places in a
    row with one distance make one long reference.
    """
    n, m = len(data), len(data) - SHORT + 1
    if m <= 0:
        return np.arange(n), np.ones(n, np.int64), np.zeros(n, np.int64)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    gram = np.ndarray(m, "<u8", wide, 0, (1,)) & U((1 << 8 * SHORT) - 1)  # eight bytes from each place on
    image = np.repeat(np.arange(len(cuts), dtype=np.int32), np.diff(np.r_[cuts, n]))
    gram |= image[:m].astype(U) << U(8 * SHORT)
    whole = image[:m] == image[SHORT - 1 :]
    bits = U(n.bit_length())
    mixed = gram * U(0x9E3779B97F4A7C15)
    mixed ^= mixed >> U(29)
    mixed *= U(0xBF58476D1CE4E5B9)
    key = np.sort(((mixed >> bits) << bits | np.arange(m, dtype=U))[whole])
    place = (key & ((U(1) << bits) - U(1))).astype(np.int64)
    same = np.flatnonzero((key[1:] >> bits) == (key[:-1] >> bits))
    a, b = place[same], place[same + 1]
    good = (gram[a] == gram[b]) & (b - a <= FAR)
    distance = np.zeros(n, np.int32)
    distance[b[good]] = (b - a)[good]
    at = np.arange(n, dtype=np.int32)
    last = np.where(np.r_[distance[1:] != distance[:-1], True], at, n).astype(np.int32)
    length = np.minimum.accumulate(last[::-1])[::-1] - at + SHORT
    usable = (distance > 0) & (length >= SHORT + (distance >= DEAR[0]) + (distance >= DEAR[1]))
    length = np.minimum(length, LONG).astype(np.int32)
    # the next reference after each that may be one; every eighth is followed one by one, those between come by arrays
    able = np.flatnonzero(usable)
    step = np.r_[np.r_[0, np.cumsum(usable, dtype=np.int32)][able + length[able]], len(able)]
    two = step[step]
    four = two[two]
    eight, now, every = memoryview(four[four]), 0, []
    while now < len(able):
        every.append(now)
        now = eight[now]
    chain = np.empty((len(every), 8), np.int64)
    chain[:, 0] = every
    chain[:, 4] = four[chain[:, 0]]
    chain[:, 2::4] = two[chain[:, ::4]]
    chain[:, 1::2] = step[chain[:, ::2]]
    starts = able[chain[chain < len(able)]]
    edge = np.zeros(n + 1, np.int8)
    edge[starts + 1] = 1
    edge[starts + length[starts]] -= 1
    token = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8) == 0)
    long_of, far_of = np.ones(n, np.int64), np.zeros(n, np.int64)
    long_of[starts], far_of[starts] = length[starts], distance[starts]
    return token, long_of[token], far_of[token]


def _near(width: int) -> np.ndarray:
    """The short code of each distance that has one, else 0."""
    out = np.zeros(7 * width + 9, np.int64)
    for k, (x, y) in reversed(list(enumerate(webp.NEAR))):
        if (d := x + y * width) > 0:
            out[d] = k + 1
    return out


def _streams(images: list[np.ndarray], heads: list[tuple[int, int]], width: int) -> list[bytes]:
    """Bodies of files: the heads' bits, then the codes and symbols of images whose pixels differ in green alone."""
    n = len(images)
    owner, symbol, extra = [], [], []
    # several images to a block, or a long one in several blocks
    blocks: list[list[tuple[int, np.ndarray]]] = [[]]
    held = 0
    for i, x in enumerate(images):
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            if held + len(part) > TOGETHER and blocks[-1]:
                blocks.append([])
                held = 0
            blocks[-1].append((i, part))
            held += len(part)
    near = _near(width)
    far = []
    for block in blocks:
        own = np.array([len(p) for _, p in block])
        data = np.concatenate([p for _, p in block])
        cuts = np.cumsum(own) - own
        place, length, distance = references(data, cuts)
        owner.append(np.array([i for i, _ in block])[np.searchsorted(cuts, place, "right") - 1])
        ref = np.flatnonzero(length > 1)
        sym = data[place].astype(np.int64)
        pre, value, bits = _prefix(length[ref])
        sym[ref] = 256 + pre
        symbol.append(sym)
        d = distance[ref]
        code = np.where(d < len(near), near[np.minimum(d, len(near) - 1)], 0)
        extra.append(np.stack([value, bits]))
        far.append(np.stack(_prefix(np.where(code > 0, code, d + 120))))
    owner, symbol, extra, far = np.concatenate(owner), np.concatenate(symbol), np.concatenate(extra, 1), np.concatenate(far, 1)
    ref = np.flatnonzero(symbol >= 256)
    green = np.bincount(owner * 280 + symbol, minlength=280 * n).reshape(n, 280)
    reach = np.bincount(owner[ref] * 40 + far[0], minlength=40 * n).reshape(n, 40)
    heading, bits_of, size_of = [_pieces(np.arange(n), [(value, at + 2) for value, at in heads])], [], []  # no cache, one group of codes
    for counts in (green, reach):
        counts[~counts.any(axis=1), 0] = 1
        lengths = huffman(counts, DEEPEST)
        heading.append(code_bits(lengths))
        if len(heading) == 2:
            heading.append(_pieces(np.arange(n), [PLAIN] * n))
        for x, own in zip((bits_of, size_of), canonical(lengths), strict=True):
            x.append(own)
    of, head, head_size = (np.concatenate(x) for x in zip(*heading, strict=True))
    order = np.argsort(of, kind="stable")
    of, head, head_size = of[order], head[order], head_size[order]
    began = np.bincount(of, head_size, minlength=n).astype(np.int64)
    token = bits_of[0][owner, symbol]
    size = size_of[0][owner, symbol]
    t, s = token[ref], size[ref]
    for v, b in ((extra[0].astype(U), extra[1]), (bits_of[1][owner[ref], far[0]], size_of[1][owner[ref], far[0]]), (far[1].astype(U), far[2])):
        t = t | v << s.astype(U)
        s = s + b
    token[ref], size[ref] = t, s
    # places of all tokens' bits; each image begins at a word of 64 bits
    total = np.bincount(owner, size, minlength=n).astype(np.int64) + began
    words = (total + 63) // 64
    base = np.cumsum(words) - words
    out = np.zeros(int(words.sum()) + 1, U)
    for i, bits, many, start in ((of, head, head_size, 64 * base), (owner, token, size, 64 * base + began)):
        before = np.cumsum(many) - many
        place = before - before[np.minimum(np.searchsorted(i, np.arange(n)), len(before) - 1)][i] + start[i]
        word, shift = place >> 6, (place & 63).astype(U)
        cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[cut]] += np.add.reduceat(bits << shift, cut)
        over = np.flatnonzero((place & 63) + many > 64)
        out[word[over] + 1] += bits[over] >> (U(64) - shift[over])
    return [out[a : a + k].tobytes()[: -(-t // 8)] for a, k, t in zip(base.tolist(), words.tolist(), total.tolist(), strict=True)]


def _one(symbol: int) -> tuple[int, int]:
    """A code of one symbol, which takes no bits."""
    return 1 | 1 << 2 | symbol << 3, 11


#: Codes of red, blue and alpha: 0, 0 and 255 throughout.
PLAIN = (_one(0)[0] | _one(0)[0] << 11 | _one(255)[0] << 22, 33)


def _palette_head(values: np.ndarray) -> tuple[int, int]:
    """The palette transform's bits: its kind, the number of grey values, and they as an image of differences."""
    value, at = 1 | webp.PALETTE << 1 | (len(values) - 1) << 3, 11
    at += 1  # no cache
    step = np.diff(values.astype(np.int64), prepend=0)
    lengths = huffman(np.bincount(step, minlength=256)[None], 15)[0]
    wide = np.zeros(280, np.int64)
    wide[:256] = lengths
    alpha = np.zeros(256, np.int64)
    alpha[[0, 255] if len(values) > 1 else [255]] = 1
    near = np.zeros(40, np.int64)
    near[0] = 1
    for own in (wide, lengths, lengths, alpha, near):
        _, got, many = code_bits(own[None])
        for x, k in zip(got.tolist(), many.tolist(), strict=True):
            value, at = value | x << at, at + k
    codes, several = webp.canonical(lengths), int((lengths > 0).sum()) > 1
    for k, s in enumerate(step.tolist()):
        if several:
            for _ in range(3):
                value |= codes[s][0] << at
                at += codes[s][1]
        if len(values) > 1:
            value |= (k == 0) << at
            at += 1
    return value, at


def encode_grey(payloads: list[bytes], width: int) -> list[bytes]:
    """Files of grey images `width` samples wide, one for each payload (a multiple of width bytes); of two transforms the smaller."""
    images = [np.frombuffer(p, np.uint8) for p in payloads]
    start = [0x2F | (width - 1) << 8 | (len(x) // width - 1) << 22 for x in images]
    green = [(s | (1 | webp.GREEN << 1) << 40, 44) for s in start]  # one transform, and none after it
    out = _streams(images, green, width) if images else []
    grey = [np.bincount(x, minlength=256).nonzero()[0] for x in images]
    for bits, most in ((3, 2), (2, 4), (1, 16)):
        some, packed, heads = [], [], []
        for i, (x, values) in enumerate(zip(images, grey, strict=True)):
            if len(values) <= most and webp._palette_bits(len(values)) == bits:
                rank = np.zeros(256, np.uint8)
                rank[values] = np.arange(len(values))
                many = 1 << bits
                index = rank[x].reshape(-1, width)
                index = np.pad(index, ((0, 0), (0, -width % many))).reshape(len(index), -1, many)
                packed.append((index << (np.arange(many) * (8 >> bits)).astype(np.uint8)).sum(-1).astype(np.uint8).ravel())
                value, at = _palette_head(values)
                heads.append((start[i] | value << 40, 41 + at))
                some.append(i)
        if some:
            for i, body in zip(some, _streams(packed, heads, -(-width >> bits)), strict=True):
                out[i] = min(out[i], body, key=len)
    return [webp.container(b) for b in out]


def split(files: bytes) -> list[bytes]:
    """The files that stand one after the other."""
    out, at = [], 0
    while at < len(files):
        size = 8 + struct.unpack("<I", files[at + 4 : at + 8])[0]
        out.append(files[at : at + size])
        at += size
    return out
