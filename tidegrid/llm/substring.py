"""Substring dedup: level-wise doubling of repeated word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import core, exchange

#: Words in a window that must not repeat.
WINDOW = 35


def levels(window: int) -> list[int]:
    """Window lengths from about a quarter of `window`, each twice the last, ending at it."""
    out = [window]
    while out[0] > 9:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Tokens:
    """Words of a few documents, their hashes, and the anchors of all windows.

    A window's anchor is its smallest hash of levels[0] words (the first of equals): equal windows have equal
    anchors at equal places, so it is enough to count the anchors at the first level. The next levels
    grow from the anchor to the right where the window has room, else to the left, which again
    depends on the window's own words alone.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lengths: list[int]):
        self.start, self.end, self.first = core.words(buf, offs)
        self.hash = core.word_hashes(buf, self.start, self.end)
        window, short = lengths[-1], lengths[0]
        self.at = np.flatnonzero(core.valid(self.first, len(self.hash), window))
        grams = core.window_hashes(self.hash, short)
        self.anchor = core.minimizers(grams, window - short + 1)[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.lengths, self.grams = lengths, grams

    def codes(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window its hash and place at a level."""
        at = self.anchor
        for k, before in zip(self.lengths[1 : level + 1], self.lengths, strict=False):
            at = np.maximum(np.where(at + k <= self.at + self.lengths[-1], at, at + before - k), self.at)
        if level == len(self.lengths) - 1:
            at = self.at
        hashes = self.grams if level == 0 else core.window_hashes(self.hash, self.lengths[level])
        return hashes[at] if len(at) else np.zeros(0, np.uint64), at


def _distinct(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct codes, and which of them stand at two places or more."""
    if not len(codes):
        return codes, np.zeros(0, bool)
    order = np.lexsort((places, codes))
    codes, places = codes[order], places[order]
    new = np.r_[True, codes[1:] != codes[:-1]]
    other = np.r_[False, (codes[1:] == codes[:-1]) & (places[1:] != places[:-1])]
    return codes[new], np.bitwise_or.reduceat(other, np.flatnonzero(new))


def _codes(h: np.ndarray, level: int, lengths: list[int], buckets: int) -> np.ndarray:
    return h if level == len(lengths) - 1 else exchange.short(h, buckets)


def candidates(level: int, lengths: list[int], buckets: int) -> Callable:
    """The message of a batch at a level: windows whose hash at the level before was repeated."""
    width = 8 if level == len(lengths) - 1 else 5

    def say(t: pa.Table, replies: pa.Table | None) -> pa.Table:
        among = None if replies is None else exchange.received(replies)
        if among is not None and not len(among):
            return exchange.messages([])
        codes, places, base = [], [], 0
        for _, buf, offs in exchange.texts(t):
            x = Tokens(buf, offs, lengths)
            own, at = x.codes(level)
            if among is not None:
                alive = exchange.member(_codes(x.codes(level - 1)[0], level - 1, lengths, buckets), among)
                own, at = own[alive], at[alive]
            once = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
            codes.append(_codes(own[once], level, lengths, buckets))
            places.append(at[once] + base)
            base += len(x.hash) + 1
        codes, several = _distinct(np.concatenate(codes), np.concatenate(places))
        return exchange.messages(exchange.send(t.column("b")[0].as_py(), codes, several, buckets, width))

    return say


def covered(n: int, at: np.ndarray, length) -> np.ndarray:
    """Which of n items lie in a window at `at`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _cut(lengths: list[int], digest: bool) -> Callable:
    def end(t: pa.Table, replies: pa.Table) -> pa.Table:
        among = exchange.received(replies)
        ids, counts, gone, kept = [], [], [], []
        for rows, buf, offs in exchange.texts(t):
            x = Tokens(buf, offs, lengths)
            own, at = x.codes(len(lengths) - 1)
            cover = covered(len(x.hash), at[exchange.member(own, among)], lengths[-1])
            total = np.r_[0, np.cumsum(cover)]
            raw = buf.tobytes()
            ids += rows.column(rows.schema.get_field_index("id")).to_pylist()
            for i in range(rows.num_rows):
                a, b = int(x.first[i]), int(x.first[i + 1])
                counts.append(b - a)
                gone.append(int(total[b] - total[a]))
                if gone[-1] == 0:
                    left = b" ".join(raw[offs[i] : offs[i + 1]].split())
                else:
                    left = b" ".join(raw[s:e] for s, e in zip(x.start[a:b][~cover[a:b]].tolist(), x.end[a:b][~cover[a:b]].tolist(), strict=True))
                kept.append(hashlib.sha256(left).digest() if digest else left)
        return pa.table([pa.array(v, f.type) for v, f in zip((ids, counts, gone, kept), ARROW, strict=True)], schema=ARROW)

    return end


def substring_dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): words left after removing those in a window that also starts elsewhere.

    docs needs doc_id and text; other columns, of whatever name, are ignored. Null and empty texts have no words
    and keep the empty text. Repeated rows are documents of their own, whose windows repeat each other; a null
    doc_id is returned as null. `kept` joins the words left by one space (its SHA-256 if digest). An
    empty table gives an empty result. Candidates travel as 40 bits beside their bucket's; windows of the full
    length are compared by 64-bit hashes.
    """
    rows, buckets = exchange.batched(docs)
    lengths, replies = levels(window), None
    for level in range(len(lengths)):
        replies = exchange.answered(exchange.ask(rows, replies, candidates(level, lengths, buckets)))
    return exchange.close(rows, replies, _cut(lengths, digest), "doc_id long, n_words long, n_removed long, kept binary", ARROW)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(core.table(spark, sf_dir, "documents"), digest=True).selectExpr("doc_id", "n_words", "n_removed", "lower(hex(kept)) AS kept_sha256")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT k, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT k, i, t, md5(string_agg(t, ' ') OVER f) AS g, count(*) OVER f AS n FROM x WINDOW f AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
z AS (SELECT k, i, t, n = 35 AND count(*) OVER (PARTITION BY n = 35, g) > 1 AS again FROM y),
c AS (SELECT k, i, t, max(again) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM z)
SELECT doc_id, count(t) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(t, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c USING (k) GROUP BY k, doc_id
"""
