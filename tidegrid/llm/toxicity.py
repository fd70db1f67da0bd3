"""Toxicity: a linear-chain conditional random field over tokens, trained here."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

#: Labelled rows of each class that are learnt from at most, taken in the order of a hash of doc_id.
SAMPLE = 10_000
#: Bytes of the texts of each class that are learnt from, about (a text that begins below it is whole).
SAMPLE_BYTES = 64_000_000
#: Features that the field has at most, the most significant first.
FEATURES = 20_000
#: Bytes of the token prefixes that are features beside the token itself.
PREFIXES = (4, 5, 6)
#: Sampled documents that the field's weights are fitted to, in the order of the sample; calibration takes all.
FITTED = 3_000
STEPS = 60

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters (ASCII letters and all other bytes of 128 or more), first token by document."""
    other = np.where(_LETTER[buf], buf, 32).astype(np.uint8)
    return core.words(other, offs)


def features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which token, hash) for the lower-cased token and for each of its proper prefixes."""
    low = core.LOWER[buf]
    out = [(np.arange(len(start)), core.word_hashes(low, start, end))]
    for n in PREFIXES:
        which = np.flatnonzero(end - start > n)
        out.append((which, core.mix(core.word_hashes(low, start[which], start[which] + n) ^ np.uint64(n))))
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for x in core.pieces(batch):
        yield (x, *core.column(x.column(x.schema.get_field_index("text"))))


def _significance(n1: np.ndarray, n0: np.ndarray, all1: int, all0: int) -> np.ndarray:
    """Log-likelihood ratio of a feature's document counts, 0 where it isn't more common in toxic documents."""
    n, rate = n1 + n0, all1 / max(1, all1 + all0)
    own = n1 / n
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(n1 > 0, n1 * np.log(own / rate), 0) + np.where(n0 > 0, n0 * np.log((1 - own) / (1 - rate)), 0))
    return np.where(own > rate, g, 0)


@dataclass
class Field:
    """Two states (0 clean, 1 toxic). score: a feature's weight for state 1; base: that of a token without features;
    change: weights of the transitions 0-1, 1-0 and 1-1 (0-0: 0); calibration: of the document's score."""

    hashes: np.ndarray
    score: np.ndarray
    base: float
    change: tuple[float, float, float]
    calibration: tuple[float, float, float]
    rate: float

    def matrices(self):
        a = np.exp(np.array([[0.0, self.change[0]], [self.change[1], self.change[2]]]))
        idle = a * np.array([1.0, np.exp(self.base)])
        half, det = (idle[0, 0] + idle[1, 1]) / 2, idle[0, 0] * idle[1, 1] - idle[0, 1] * idle[1, 0]
        root = np.sqrt(max(half * half - det, 1e-300))
        top, low = half + root, half - root
        first = (idle - low * np.eye(2)) / (top - low)
        return a, top, low / top, first, np.eye(2) - first


def marginals(field: Field, gaps: np.ndarray, last: np.ndarray, extra: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of active tokens, and each document's log partition function.

    Rows are documents, columns active tokens (those with features; extra: the sum of their weights); gaps: tokens
    without features before each, last: after the last. A run of g such tokens is one matrix to the power g,
    taken by its two eigenvalues, so the chain over all tokens is exact at the cost of the active ones.
    """
    a, top, ratio, first, second = field.matrices()
    n, m = mask.shape
    emit = np.where(mask, np.exp(np.clip(field.base + extra, -30, 30)), 1.0).T.copy()
    decay = (ratio ** np.where(mask, gaps, 0)).T.copy()
    masks, ends = mask.T.copy(), ratio**last
    one, two = first @ a, second @ a  # an idle run and then a transition: one + decay * two
    forward = np.zeros((m, n, 2))
    log = (np.where(mask, gaps, 0).sum(1) + last) * np.log(top)
    # before the first token stands state 0
    now = np.tile([1.0, 0.0], (n, 1))
    for t in range(m):
        new = now @ one + decay[t][:, None] * (now @ two)
        new[:, 1] *= emit[t]
        s = new.sum(1)
        now = np.where(masks[t][:, None], new / s[:, None], now)
        log += np.where(masks[t], np.log(s), 0)
        forward[t] = now
    log += np.log((now @ first + ends[:, None] * (now @ second)).sum(1))
    back = first.sum(1) + ends[:, None] * second.sum(1)
    out = np.zeros((m, n))
    for t in range(m - 1, -1, -1):
        both = forward[t] * back
        out[t] = np.where(masks[t], both[:, 1] / both.sum(1), 0)
        back_t = back * np.stack([np.ones(n), emit[t]], 1)
        new = back_t @ one.T + decay[t][:, None] * (back_t @ two.T)
        back = np.where(masks[t][:, None], new / new.sum(1, keepdims=True), back)
    return out.T, log


def _padded(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), int(counts.max()) if len(counts) else 0), values.dtype)
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
    return out


class Active:
    """The active tokens of some documents: those with a feature that the field knows."""

    def __init__(self, hashes: np.ndarray, buf: np.ndarray, offs: np.ndarray):
        self.start, self.end, first = tokens(buf, offs)
        seen = np.zeros(1 << 20, bool)
        seen[hashes >> np.uint64(44)] = True
        which, feature = [], []
        for at, h in features(buf, self.start, self.end):
            some = np.flatnonzero(seen[h >> np.uint64(44)])
            if len(hashes) and len(some):
                k = np.minimum(np.searchsorted(hashes, h[some]), len(hashes) - 1)
                hit = hashes[k] == h[some]
                which.append(at[some][hit])
                feature.append(k[hit])
        self.which = np.concatenate(which) if which else np.zeros(0, np.int64)
        self.feature = np.concatenate(feature) if feature else np.zeros(0, np.int64)
        self.token, self.slot = np.unique(self.which, return_inverse=True)
        self.doc = np.searchsorted(first, self.token, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offs) - 1)
        n = np.diff(first)
        begin = np.r_[True, self.doc[1:] != self.doc[:-1]] if len(self.doc) else np.zeros(0, bool)
        before = np.r_[0, self.token[:-1] + 1] if len(self.token) else self.token
        self.gap = self.token - np.where(begin, first[self.doc], before)
        self.last = n.copy()
        if len(self.doc):
            end = np.r_[begin[1:], True]
            self.last[self.doc[end]] = first[self.doc[end] + 1] - self.token[end] - 1

    def marginals(self, field: Field) -> np.ndarray:
        """P(toxic) of each active token."""
        extra = np.bincount(self.slot, field.score[self.feature], minlength=len(self.token))
        out = np.zeros(len(self.token))
        full = np.flatnonzero(self.count)
        begin = np.cumsum(self.count) - self.count
        for some in np.array_split(full[np.argsort(self.count[full], kind="stable")], max(1, len(full) // 256)):
            if len(some):
                n = self.count[some]
                at = np.repeat(begin[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                got = marginals(field, _padded(n, self.gap[at]), self.last[some], _padded(n, extra[at]), _padded(n, np.ones(len(at), bool)))[0]
                out[at] = got[_padded(n, np.ones(len(at), bool))]
        return out


def document_scores(field: Field, doc: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Of each of n documents, by the expected number of its toxic tokens (its logarithm, without a bound) and the largest marginal."""
    total, most = np.bincount(doc, p, minlength=n), np.zeros(n)
    np.maximum.at(most, doc, p)
    c = field.calibration
    return 1 / (1 + np.exp(-np.clip(c[0] + c[1] * np.log1p(total) + c[2] * most, -30, 30)))


def _fit(hashes: np.ndarray, rows: list, rate: float) -> Field:
    """rows: (toxic, last gap, gaps, count of features by token, features) of each sampled document."""
    field = Field(hashes, np.zeros(len(hashes)), -4.0, (-2.0, 0.0, 0.0), (0.0, 0.0, 0.0), rate)
    toxic = np.array([r[0] for r in rows])
    count = np.array([len(r[2]) for r in rows])
    weight = np.where(toxic == 1, rate / max(1, (toxic == 1).sum()), (1 - rate) / max(1, (toxic == 0).sum())) * len(rows)
    last = np.array([r[1] for r in rows], np.int64)
    gap = np.concatenate([r[2] for r in rows]).astype(np.int64)
    slot = np.repeat(np.arange(len(gap)), np.concatenate([r[3] for r in rows]))
    feature = np.concatenate([r[4] for r in rows]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), count)
    label = toxic[doc].astype(float)  # tokens with significant features are toxic where their document is
    full = np.flatnonzero(count)
    begin = np.cumsum(count) - count
    # documents with active tokens, hashed so that any prefix is as good as another
    full = full[np.argsort(core.mix(full.astype(np.uint64)), kind="stable")[:FITTED]]
    full = full[np.argsort(count[full], kind="stable")]
    shapes = []
    for g in np.array_split(full, max(1, len(full) // 256)):
        if len(g):
            n = count[g]
            at = np.repeat(begin[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shapes.append((g, n, at, _padded(n, gap[at]), _padded(n, np.ones(len(at), bool))))
    fitted = np.zeros(len(rows), bool)
    fitted[full] = True
    use = fitted[doc]
    before = np.r_[0, label[:-1]] * np.r_[False, doc[1:] == doc[:-1]]
    near = gap == 0
    ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
    closes = use[ends] & (label[ends] == 1) & (last[doc[ends]] > 0)

    def passes(f: Field) -> tuple[np.ndarray, float]:
        """Marginals of the fitted documents' active tokens, and the mean loss."""
        extra = np.bincount(slot, f.score[feature], minlength=len(gap))
        p, loss, a = np.zeros(len(gap)), 0.0, f.change
        for g, n, at, gaps, mask in shapes:
            got, log = marginals(f, gaps, last[g], _padded(n, extra[at]), mask)
            p[at] = got[mask]
            loss += float((weight[g] * log).sum())
        # the labelled path: tokens without features are in state 0
        follow = np.where(near & (before == 1), np.where(label == 1, a[2], a[1]), np.where(label == 1, a[0], 0)) + np.where(~near & (before == 1), a[1], 0)
        path = weight[doc] * (label * (f.base + extra) + follow)
        return p, (loss - float(path[use].sum()) - float(weight[doc[ends[closes]]].sum()) * a[1]) / len(rows)

    theta = np.array([field.base, *field.change])
    moment = [np.zeros(len(hashes) + 4), np.zeros(len(hashes) + 4)]

    def at(x: np.ndarray, score: np.ndarray) -> Field:
        return Field(hashes, score, float(x[0]), tuple(map(float, x[1:4])), field.calibration, rate)

    score, slope = field.score, np.zeros(4)
    for step in range(1, STEPS + 1):
        p, loss = passes(at(theta, score))
        push = weight[doc] * (p - label) * use
        grad = np.bincount(feature, push[slot], minlength=len(hashes)) / len(rows) + 1e-4 * score
        if step % 3 == 1:  # the four scalars by differences
            slope = np.array([(passes(at(theta + 1e-4 * np.eye(4)[k], score))[1] - loss) / 1e-4 for k in range(4)])
        g = np.r_[grad, slope + 1e-3 * theta]
        moment[0] = 0.9 * moment[0] + 0.1 * g
        moment[1] = 0.99 * moment[1] + 0.01 * g * g
        move = 0.25 * moment[0] / (1 - 0.9**step) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        score, theta = score - move[:-4], theta - move[-4:]
    field = at(theta, score)
    extra = np.bincount(slot, score[feature], minlength=len(gap))
    p = np.zeros(len(gap))
    every = np.flatnonzero(count)
    for g in np.array_split(every[np.argsort(count[every], kind="stable")], max(1, len(every) // 256)):
        if len(g):
            n = count[g]
            spot = np.repeat(begin[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            mask = _padded(n, np.ones(len(spot), bool))
            p[spot] = marginals(field, _padded(n, gap[spot]), last[g], _padded(n, extra[spot]), mask)[0][mask]
    total, most = np.bincount(doc, p, minlength=len(rows)), np.zeros(len(rows))
    np.maximum.at(most, doc, p)
    x = np.stack([np.ones(len(rows)), np.log1p(total), most], 1)
    c = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        w = weight * np.maximum(q * (1 - q), 1e-6)
        c -= np.linalg.solve((x * w[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (weight * (q - toxic)) + 1e-2 * c)
    field.calibration = tuple(map(float, c))
    return field


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from documents whose fold isn't 0, at most `sample` of each class and SAMPLE_BYTES of their texts.

    Labels are of documents, so token labels are made up from them: every token with a significant feature has its
    document's label, all others are clean. The field has at most FEATURES features, the most significant first; this bounds
    the model, not the rows that are scored.

    Features are tokens and prefixes significantly more common in toxic documents (log-likelihood ratio above twice the
    logarithm of the number of features, plus 4); tokens that have one are labelled as their document. Nulls and repeated
    rows of labels: rows without doc_id or toxic are left out, of repeated ones the larger label counts.
    """
    spark = docs.sparkSession
    core.ship(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).where(core.fold() != 0)
    sizes = dict(known.groupBy("toxic").count().collect())
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    nothing = Field(np.zeros(0, np.uint64), np.zeros(0), -4.0, (-2.0, 0.0, 0.0), (float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), 0.0, 0.0), rate)
    if not sizes.get(1) or not sizes.get(0):
        return nothing
    of = lambda k: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = of(0).union(of(1))  # 2 * sample rows of 12 bytes, whatever the input
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = core.kept(texts.join(F.broadcast(chosen), "doc_id").select("toxic", F.xxhash64("doc_id").alias("k"), "text"))
    # the sample's bytes have a bound too: what goes beyond it, in the order of the hash, is left out; 2 * sample numbers reach the driver
    cut, held = {}, {0: 0, 1: 0}
    for r in sorted(rows.groupBy("toxic", "k").agg(F.sum(F.octet_length("text")).alias("n")).collect()):
        if held[r.toxic] < SAMPLE_BYTES:
            cut[r.toxic] = r.k
        held[r.toxic] += r.n
    rows = rows.where(F.col("k") <= F.when(F.col("toxic") == 1, F.lit(cut.get(1))).otherwise(F.lit(cut.get(0)))).select("toxic", "text")
    n1, n0 = (rows.where(F.col("toxic") == k).count() for k in (1, 0))
    if not n1 or not n0:
        return nothing
    buckets = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, buf, offs in _texts(batch):
                toxic = x.column(0).to_numpy()
                start, end, first = tokens(buf, offs)
                doc = np.searchsorted(first, np.arange(len(start)), "right") - 1
                pairs = [np.stack([h, doc[at].astype(np.uint64)], 1) for at, h in features(buf, start, end)]
                pairs = np.concatenate(pairs)
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                h, d = pairs[order, 0], pairs[order, 1].astype(np.int64)
                new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
                h, is1 = h[new], toxic[d[new]]
                at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                if not len(at):
                    continue
                k1, k = np.add.reduceat(is1.astype(np.int64), at), np.diff(np.r_[at, len(h)])
                h = h[at]
                b = core.bucket_of(h, buckets).astype(np.int64)
                cuts = np.searchsorted(b, np.arange(buckets + 1))
                yield pa.record_batch([pa.array(range(buckets), pa.int64()), pa.array([h[i:j].tobytes() + k1[i:j].astype("<i4").tobytes() + k[i:j].astype("<i4").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["bucket", "data"])

    def choose(t: pa.Table) -> pa.Table:
        data = [(d, len(d) // 16) for d in t.column("data").to_pylist()]
        h = np.concatenate([np.frombuffer(d, "<u8", n) for d, n in data])
        k1 = np.concatenate([np.frombuffer(d, "<i4", n, 8 * n) for d, n in data])
        k = np.concatenate([np.frombuffer(d, "<i4", n, 12 * n) for d, n in data])
        h, where = np.unique(h, return_inverse=True)
        k1, k = np.bincount(where, k1, minlength=len(h)), np.bincount(where, k, minlength=len(h))
        g = _significance(k1, k - k1, n1, n0)
        some = g > 2 * np.log(max(2, len(h) * buckets)) + 4
        return pa.table({"hash": pa.array(h[some].view(np.int64), pa.int64()), "g": pa.array(g[some], pa.float64())})

    got = rows.mapInArrow(count, "bucket long, data binary").groupBy("bucket").applyInArrow(choose, "hash long, g double").orderBy(F.desc("g"), "hash").limit(FEATURES).collect()
    if not got:
        return nothing
    hashes = np.sort(np.array([r[0] for r in got], np.int64).view(np.uint64))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, buf, offs in _texts(batch):
                a = Active(hashes, buf, offs)
                order = np.argsort(a.slot, kind="stable")
                many = np.bincount(a.slot, minlength=len(a.token))
                cut = np.r_[0, np.cumsum(a.count)]
                cut2 = np.r_[0, np.cumsum(many)][cut]
                feats = a.feature[order]
                pick = lambda v, c, kind: pa.array([v[i:j].astype(kind).tobytes() for i, j in zip(c[:-1], c[1:], strict=True)], pa.binary())
                yield pa.record_batch([x.column(0).cast(pa.int64()), pa.array(a.last), pick(a.gap, cut, "<i8"), pick(many, cut, "<i8"), pick(feats, cut2, "<i8")], ["toxic", "last", "gaps", "many", "feats"])

    small = rows.mapInArrow(shrink, "toxic long, last long, gaps binary, many binary, feats binary").collect()
    return _fit(hashes, [(r[0], r[1], *(np.frombuffer(r[k], "<i8") for k in (2, 3, 4))) for r in sorted(small)], rate)


def toxicity(docs: DataFrame, field: Field, spans: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, spans if asked) for every row: spans are (start, end, p) of tokens that are toxic by p > 0.5, in bytes.

    docs needs doc_id and text; of other columns those in `carry` are returned. Null and empty texts are scored as texts
    without tokens. Repeated rows are scored alike. Nothing but the text is an input of the score.
    """
    core.ship(docs.sparkSession)
    kinds = docs.select(*carry).schema if carry else None
    out = "doc_id long, score double" + ", spans array<struct<start:long,end:long,p:double>>" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = field  # small: FEATURES weights at most
        for batch in batches:
            for x, buf, offs in _texts(batch):
                a = Active(f.hashes, buf, offs)
                p = a.marginals(f)
                cols = [x.column(0), pa.array(document_scores(f, a.doc, p, x.num_rows))]
                names = ["doc_id", "score"]
                if spans:
                    at, k = a.start[a.token] - offs[a.doc], np.flatnonzero(p > 0.5)
                    to = a.end[a.token] - offs[a.doc]
                    cut = np.searchsorted(a.doc[k], np.arange(x.num_rows + 1))
                    cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(at[k], pa.int64()), pa.array(to[k], pa.int64()), pa.array(p[k], pa.float64())], ["start", "end", "p"])))
                    names.append("spans")
                yield pa.record_batch([*cols, *x.columns[2:]], [*names, *x.schema.names[2:]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    if kinds is not None:
        out += "".join(f", c{i} {f.dataType.simpleString()}" for i, f in enumerate(kinds))
    done = rows.mapInArrow(run, out)
    return done.select("doc_id", "score", *["spans"] * spans, *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.table(spark, sf_dir, "documents")
    field = train(docs, core.table(spark, sf_dir, "labels"))
    rows = toxicity(docs, field, spans=True)
    return rows.select("doc_id", (core.fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
