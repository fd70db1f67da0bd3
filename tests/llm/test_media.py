import hashlib
import random
import sys
import zlib
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pytest

from tests.llm import brute
from tidegrid.llm import media, webp, webp_store


def lengths_of(counts, size):
    """Huffman code lengths (a single symbol: length 1)."""
    heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(counts.items()))]
    heapify(heap)
    out = [0] * size
    if len(heap) == 1:
        out[heap[0][2][0]] = 1
    tie = len(heap)
    while len(heap) > 1:
        a, b = heappop(heap), heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        tie += 1
        heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
    return out


class Slow:
    """An encoder for tests: Huffman codes, references, a colour cache, groups of codes and all transforms."""

    def __init__(self):
        self.w = webp.Writer()

    def lengths(self, lengths):
        w, used = self.w, [s for s, n in enumerate(lengths) if n]
        if len(used) <= 2 and all(s < 256 for s in used):
            w.put(1, 1)
            w.put(len(used) - 1, 1)
            w.put(1, 1)
            w.put(used[0], 8)
            if len(used) == 2:
                w.put(used[1], 8)
            return
        runs, i, before = [], 0, 8
        while i < len(lengths):
            j = i
            while j < len(lengths) and lengths[j] == lengths[i]:
                j += 1
            n, v = j - i, lengths[i]
            if v == 0 and n >= 3:
                k = min(n, 138)
                runs.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
                i += k if k >= 11 else min(k, 10)
            elif v and v == before and n >= 3:
                k = min(n, 6)
                runs.append((16, k - 3, 2))
                i += k
            else:
                runs.append((v, 0, 0))
                before = v or before
                i += 1
        own = lengths_of(Counter(r[0] for r in runs), 19)
        assert max(own) <= 7
        last = max(webp.LENGTH_ORDER.index(s) for s in range(19) if own[s])
        n = max(4, last + 1)
        w.put(0, 1)
        w.put(n - 4, 4)
        for s in webp.LENGTH_ORDER[:n]:
            w.put(own[s], 3)
        w.put(0, 1)
        codes = self.codes(own)
        for s, extra, k in runs:
            w.put(*codes[s])
            w.put(extra, k)

    def codes(self, lengths):
        if sum(1 for n in lengths if n) == 1:
            return {s: (0, 0) for s, n in enumerate(lengths) if n}
        out, value, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            value <<= n - last
            last = n
            out[s] = (int(f"{value:0{n}b}"[::-1], 2), n)
            value += 1
        return out

    def image(self, argb, cache_bits=0, references=False, main=False, groups=1):
        w, flat, (height, width) = self.w, argb.ravel().tolist(), argb.shape
        w.put(int(cache_bits > 0), 1)
        if cache_bits:
            w.put(cache_bits, 4)
        block = 2
        which = np.zeros((-(-height >> block), -(-width >> block)), np.uint32)
        if main:
            w.put(int(groups > 1), 1)
            if groups > 1:
                which = (np.arange(which.size, dtype=np.uint32) % groups).reshape(which.shape)
                w.put(block - 2, 3)
                self.image(which << 8)
        cache, steps, at = [0] * (1 << cache_bits), [], 0
        rng = random.Random(1)
        while at < len(flat):
            g = int(which[(at // width) >> block, (at % width) >> block])
            match = None
            if references and at:
                for d in {1, width, width + 1, 2, at, rng.randint(1, at)} - {0}:
                    n = 0
                    while d <= at and at + n < len(flat) and n < 300 and flat[at + n] == flat[at + n - d]:
                        n += 1
                    if n >= 3 and (match is None or n > match[0]):
                        match = n, d
            if match:
                n, d = match
                near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(webp.NEAR)))}
                steps.append((g, "ref", n, near.get(d, d + 120)))
                new = flat[at : at + n]
            else:
                v = flat[at]
                h = (webp.HASH * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
                steps.append((g, "cache", h) if cache_bits and cache[h] == v and at else (g, "pixel", v))
                new = [v]
            for v in new:
                if cache_bits:
                    cache[(webp.HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
            at += len(new)

        def prefix(value):
            value -= 1
            if value < 4:
                return value, 0, 0
            n = value.bit_length() - 2
            return 2 * (n + 1) + (value >> n & 1), value & ((1 << n) - 1), n

        counts = [[Counter() for _ in range(5)] for _ in range(groups)]
        for s in steps:
            c = counts[s[0]]
            if s[1] == "pixel":
                for k, shift in enumerate((8, 16, 0, 24)):
                    c[k][s[2] >> shift & 255] += 1
            elif s[1] == "cache":
                c[0][280 + s[2]] += 1
            else:
                c[0][256 + prefix(s[2])[0]] += 1
                c[4][prefix(s[3])[0]] += 1
        codes = []
        for c in counts:
            own = []
            for k, size in enumerate((280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)):
                lengths = lengths_of(c[k] or Counter([0]), size)
                self.lengths(lengths)
                own.append(self.codes(lengths))
            codes.append(own)
        for s in steps:
            c = codes[s[0]]
            if s[1] == "pixel":
                for k, shift in enumerate((8, 16, 0, 24)):
                    w.put(*c[k][s[2] >> shift & 255])
            elif s[1] == "cache":
                w.put(*c[0][280 + s[2]])
            else:
                for k, base, value in ((0, 256, s[2]), (4, 0, s[3])):
                    p, extra, n = prefix(value)
                    w.put(*c[k][base + p])
                    w.put(extra, n)

    def file(self, argb, transforms=(), **options):
        w, (height, width) = self.w, argb.shape
        w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
        rng = np.random.default_rng(2)
        for kind in transforms:
            w.put(1, 1), w.put(kind, 2)
            if kind in (webp.PREDICT, webp.CROSS):
                block = 2
                shape = (-(-argb.shape[0] >> block), -(-argb.shape[1] >> block))
                part = rng.integers(0, 14, shape).astype(np.uint32) << 8 if kind == webp.PREDICT else rng.integers(0, 1 << 24, shape).astype(np.uint32)
                w.put(block - 2, 3)
                self.image(part)
                argb = (webp.predict if kind == webp.PREDICT else webp.cross_colour)(argb, part, block, inverse=False)
            elif kind == webp.GREEN:
                argb = webp.subtract_green(argb, inverse=False)
            else:
                table = np.unique(argb)
                index = np.searchsorted(table, argb)
                w.put(len(table) - 1, 8)
                delta = np.diff(webp._bytes(table).astype(np.int16), axis=0, prepend=0).astype(np.uint8).view("<u4").ravel()
                self.image(delta.reshape(1, -1))
                bits = webp._palette_bits(len(table))
                each, many = 8 >> bits, 1 << bits
                index = np.pad(index, ((0, 0), (0, -index.shape[1] % many))).reshape(len(index), -1, many)
                argb = ((index << (np.arange(many) * each)).sum(-1) << 8).astype(np.uint32) | np.uint32(0xFF000000)
        w.put(0, 1)
        self.image(argb, main=True, **options)
        w.put(0, 8)
        return webp.container(b"\x2f" + bytes(w.out))


P, C, G, I = webp.PREDICT, webp.CROSS, webp.GREEN, webp.PALETTE


@pytest.mark.parametrize("colours", [1, 2, 4, 13, 60, 5000])
@pytest.mark.parametrize("transforms", [(), (P,), (C,), (G,), (P, C), (G, P), (I,), (P, C, G)])
@pytest.mark.parametrize("options", [{}, {"cache_bits": 4}, {"references": True}, {"cache_bits": 9, "references": True, "groups": 3}])
def test_round_trip(colours, transforms, options):
    if I in transforms and colours > 256:
        pytest.skip("a palette has 256 colours at most")
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    argb = table[np.sort(rng.integers(0, colours, 19 * 23)) if colours < 5 else rng.integers(0, colours, 19 * 23)].reshape(19, 23)
    argb[5:9] = argb[1:5]
    assert (webp.decode(Slow().file(argb, transforms, **options)) == argb).all()


TEXTS = [b"", b"a", b"ab" * 288, b"x" * 577, b"abc" * 700, bytes(range(17)) * 99, bytes(range(256)) * 9, "Ünïcödé ".encode() * 400, random.Random(4).randbytes(30_000), b"0123456789abcdef" * 5000]


def test_stored_payloads():
    payloads = [media.padded(t) for t in TEXTS]
    for some in (payloads, *([p] for p in payloads)):
        for p, pixels in zip(some, media.load(media.store(some)), strict=True):
            assert media.samples(pixels) == p and len(p) % 576 == 0 and len(p) >= 576 and pixels.shape[2] == 3
            assert (pixels[..., 0] == pixels[..., 1]).all() and (pixels[..., 2] == pixels[..., 1]).all()
    alone = [media.store([p])[0] for p in payloads]
    assert alone == media.store(payloads)  # a text's form doesn't depend on its batch


def test_streams_use_what_the_format_offers():
    rng = random.Random(1)
    prose = " ".join(rng.choice(["water", "sea", "of", "the", "and", "shore", "waves", "Big", "jumps", "quickly", "from", "XYZ", "kept"]) + rng.choice(["", "s"]) for _ in range(4000)).encode()
    few = " ".join(rng.choice(["water", "sea", "of", "the", "and", "shore", "waves"]) for _ in range(4000)).encode()
    stored = media.store([media.padded(t) for t in (prose, few, rng.randbytes(4000))])
    assert len(stored[0]) < 0.4 * len(prose) and len(stored[1]) < 0.4 * len(few)
    kinds = [[f.__name__ if f.__name__ != "<lambda>" else "palette" for f in webp._opened(x)[1]] for x in stored]
    assert kinds == [["subtract_green"], ["palette"], ["subtract_green"]]
    codes = webp._opened(stored[0])[0].codes[0]
    assert codes[0].top > 4 and codes[4].only is None and webp._opened(stored[0])[0].plain


def test_very_long_text_is_several_files():
    payload = media.padded(b"".join(b"long text %d " % i for i in range(800_000)))
    stored = media.store([payload])[0]
    assert len(payload) > 576 * 16384 and len(webp_store.split(stored)) == 2
    assert media.samples(media.load([stored])[0]) == payload


def bits(*fields):
    """(value, bits) fields as bytes, the low bits first."""
    text = "".join(f"{v:0{n}b}"[::-1] for v, n in fields if n)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8][::-1], 2) for i in range(0, len(text), 8))


def file(*fields):
    body = b"\x2f" + bits(*fields)
    return b"RIFF" + (12 + len(body) + len(body) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)


ONE = lambda s: [(1, 1), (0, 1), (1, 1), (s, 8)]  # noqa: E731 a code of one symbol
TWO = lambda a, b: [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


def test_fixed_files():
    """Files laid out by hand from the format's description, and one known from elsewhere."""
    known = bytes.fromhex("524946461a000000574542505650384c0d0000002f00000010071011118888fe0700")
    assert webp.decode(known).tolist() == [[0]]
    head = [(2, 14), (1, 14), (0, 1), (0, 3)]  # 3 x 2 pixels
    # green 10 and 20 by one bit each, red 1, blue 2, alpha 255
    plain = file(*head, (0, 1), (0, 1), (0, 1), *TWO(10, 20), *ONE(1), *ONE(2), *ONE(255), *ONE(0), *[(b, 1) for b in (0, 1, 1, 0, 0, 1)])
    v = lambda g: 255 << 24 | 1 << 16 | g << 8 | 2
    assert webp.decode(plain).tolist() == [[v(10), v(20), v(20)], [v(10), v(10), v(20)]]
    # subtract green: red and blue get green added
    green = file(*head, (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *TWO(10, 250), *ONE(1), *ONE(9), *ONE(255), *ONE(0), *[(b, 1) for b in (0, 1, 1, 0, 0, 1)])
    w = lambda g: 255 << 24 | (1 + g & 255) << 16 | g << 8 | (9 + g & 255)
    assert webp.decode(green).tolist() == [[w(10), w(250), w(250)], [w(10), w(10), w(250)]]
    # predictor 11 in one block of 4 x 4: all residues green 1, others 0: the corner from black, row 0 from the left, column 0 from above
    predict = file(*head, (1, 1), (0, 2), (0, 3), (0, 1), *ONE(11), *ONE(0), *ONE(0), *ONE(255), *ONE(0), (0, 1), (0, 1), (0, 1), *ONE(1), *ONE(0), *ONE(0), *ONE(0), *ONE(0))
    g = (webp.decode(predict) >> 8 & 255).tolist()
    # (1,1): left 2, top 2, corner 1: both as far, so the top; (1,2): left 3, top 3, corner 2
    assert g == [[1, 2, 3], [2, 3, 4]] and (webp.decode(predict) >> 24 == 255).all()
    # cross-colour in one block: green to red 32 (a whole green), green to blue 0, red to blue 0
    cross = file(*head, (1, 1), (1, 2), (0, 3), (0, 1), *ONE(0), *ONE(0), *ONE(32), *ONE(255), *ONE(0), (0, 1), (0, 1), (0, 1), *ONE(7), *ONE(1), *ONE(2), *ONE(255), *ONE(0))
    assert webp.decode(cross).ravel().tolist() == [255 << 24 | 8 << 16 | 7 << 8 | 2] * 6
    # palette of two colours, eight indices to a symbol: 0b101 in row 0, 0b010 in row 1
    table = file(*head, (1, 1), (3, 2), (1, 8), (0, 1), *TWO(5, 6), *ONE(0), *ONE(0), *TWO(0, 255), *ONE(0), (0, 1), (1, 1), (1, 1), (0, 1), (0, 1), (0, 1), (0, 1), *TWO(2, 5), *ONE(0), *ONE(0), *ONE(255), *ONE(0), (1, 1), (0, 1))
    a, b = 255 << 24 | 5 << 8, 255 << 24 | 11 << 8
    assert webp.decode(table).tolist() == [[b, a, b], [a, b, a]]


def test_damaged_files_are_refused():
    good = media.store([media.padded(b"hello " * 50)])[0]
    for bad in (b"", b"RIFF", good[: len(good) // 2], good[:-3], good.replace(b"VP8L", b"VP8 ")):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_awkward_rows(spark):
    rows = brute.awkward(11)
    got = media.media_columns(spark.createDataFrame(rows, brute.SCHEMA), keep=True).collect()
    want = []
    for r in rows:
        t = (r[1] or "").encode()
        p = t + b"\xff" * (-len(t) % 576 if t else 576)
        want.append((r[0], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert brute.ordered([tuple(r)[:5] for r in got]) == brute.ordered(want)
    assert all(r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() for r in got)
    assert media.media_columns(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def test_codes_of_many_images_are_made_together():
    """Rows of counts give each row's own code, whatever stands beside it; lengths that are too long are made again."""
    rng = np.random.default_rng(3)
    counts = np.zeros((40, 280), np.int64)
    for row in counts[1:]:
        some = rng.choice(280, rng.integers(1, 200), replace=False)
        row[some] = np.maximum(1, rng.pareto(0.4, len(some))).astype(np.int64) % 10**9 + 1
    counts[5, :30] = 2 ** np.arange(30)
    got = webp_store.huffman(counts, webp_store.DEEPEST)
    for c, n in zip(counts, got, strict=True):
        assert (webp_store.huffman(c[None], webp_store.DEEPEST)[0] == n).all() and ((n > 0) == (c > 0)).all() and n.max() <= webp_store.DEEPEST
        if (c > 0).sum() > 1:
            assert (0.5 ** n[n > 0]).sum() == 1
        plain = lengths_of(Counter({s: int(k) for s, k in enumerate(c) if k}) or Counter([0]), 280)
        if 1 < (c > 0).sum() and max(plain) <= webp_store.DEEPEST:
            assert (n * c).sum() == sum(x * y for x, y in zip(plain, c.tolist(), strict=True))


def test_calls_of_a_batch_are_few_for_each_image():
    """Codes, symbols and copies of a batch go by arrays; a loop over each image's symbols takes 4100 calls an image here."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(2000)]
    payloads = [media.padded(" ".join(rng.choices(vocabulary, k=300)).encode()) for _ in range(60)]
    calls = [0, 0]
    for k, some in enumerate((payloads[:20], payloads)):
        kept = sys.getprofile()

        def counted(frame, event, arg, k=k):
            calls[k] += event in ("call", "c_call")

        sys.setprofile(counted)
        try:
            media.load(media.store(some))
        finally:
            sys.setprofile(kept)
    assert calls[1] - calls[0] < 40 * 3000, calls
