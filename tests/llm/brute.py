"""Plain versions of the operators, and awkward documents to try them on."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, b string, key string"


def awkward(seed: int = 1, n: int = 60):
    """Documents with copies, near copies, shared passages, nulls, empties, ties and columns of clashing names."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "añb", "ß", "x" * 30, "lo w", "\x85", "Stupid", "worthless"] + [f"w{i}" for i in range(40)]
    make = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(k))
    passage = make(70)
    texts = [make(rng.choice([0, 1, 2, 5, 40, 120])) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] += passage[: rng.choice([60, 400, len(passage)])] + make(8)
    texts += [texts[3], texts[5], texts[5] + "end", make(30) * 3, " \n\t ", "", None, "a" * 400, "a" * 399 + "b", "word " * 300]
    rows = [(i * 3 - 20, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s0", None, "é"]), len(t or ""), "x", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[-3], (None, texts[5], None, None, None, None, None), (None, "only here", None, None, None, None, None), (rows[7][0], "other text of one id", "en", "s1", 3, None, None)]
    return rows


def substring(rows, window):
    seen = Counter()
    docs = [WORD.findall(r[1] or "") for r in rows]
    for w in docs:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, docs, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


def suffix(rows, length):
    best = {}
    order = lambda r: (1 << 63) - 1 if r[0] is None else r[0]
    for r in rows:
        t = (r[1] or "").encode()
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            best[s] = min(best.get(s, order(r)), order(r))
    out = []
    for r in rows:
        t = (r[1] or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if best[t[i : i + length]] < order(r):
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((r[0], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


def simhash(rows, size, bits):
    import xxhash

    prints = []
    for r in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        w = WORD.findall(t)
        grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], f"{p:016x}", min(least[find(i)], default=None)) for i, (r, p) in enumerate(zip(rows, prints, strict=True))]


def similar_rows(rows, size, least):
    """(doc_id, text) of the rows that stay: of each component of texts the smallest doc_id, null last."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    grams, texts = [], sorted({r[1] or "" for r in rows})
    for t in texts:
        w = WORD.findall(lower(t))
        grams.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(texts)))
    holders = defaultdict(list)
    for i, g in enumerate(grams):
        for x in g or {None}:
            holders[x].append(i)
    for i, g in enumerate(grams):
        for j in {j for x in g or {None} for j in holders[x] if j < i}:
            both = len(g & grams[j])
            if not g or both >= least * (len(g) + len(grams[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    first = {}
    for r in rows:
        c = label[texts.index(r[1] or "")]
        own = (r[0] is None, r[0] or 0)
        if c not in first or own < first[c][0]:
            first[c] = own, (r[0], r[1] or "")
    return {v for _, v in first.values()}


def similar(rows, size, least):
    return [k for k, _ in similar_rows(rows, size, least)]


def ordered(rows):
    return sorted(rows, key=repr)
