"""Toxicity by a linear-chain conditional random field over words.

The field has two labels, plain and toxic.  A word's score sums weights of its
hashed features (the word, prefixes of its bytes); two more weights rate label
changes.  Labels of tokens come from labelled documents: features that are far
more frequent in toxic than in clean documents mark toxic tokens, and the field
is fitted on these sequences by gradient ascent of its likelihood.  Forward and
backward passes give each word's marginal; a logistic model on the sum of a
document's marginals, their density and its length gives the document's score.
It is fitted on marginals that come from fields fitted on other documents.

Fitting uses a bounded sample of labelled rows (``SAMPLE`` of each label, chosen
by a hash of the id; labelled texts of more than ``SAMPLE_CHARS`` bytes are left
out of it, whole, so that no text is cut), in one task.  Scoring reads
every whole text, in NumPy over all words of a batch: a step of the passes
covers one word of each document.

Defined results: null and empty texts have no words and get the score of a
document without toxic words; documents without labels are scored like others;
labels that are null or of another value are left out, of repeated labels the
highest counts, of a labelled id's texts the least; without labels of both kinds every score is 0; repeated rows
stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

SAMPLE, SAMPLE_CHARS = 1_200, 16_000
BITS, PREFIXES = 18, (4, 5, 6, 7, 8)
SPAN_AT, FOLDS, SEGMENT = 0.5, 3, 512
#: Bytes of text scored at once.
SLICE = 1 << 20
#: A feature marks toxic tokens if it is LIFT times as frequent in toxic documents, with a log-likelihood ratio of
#: SIGNIFICANT over documents; of one document so many occurrences count.
LIFT, SIGNIFICANT, PER_DOC = 12.0, 20.0, 3
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Words:
    """The words of some documents: byte spans in ``data``, and their features."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    features: np.ndarray  # a row a feature; 0 is none


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(texts: list[str]) -> Words:
    raw = [lowered(t).encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(16), np.uint8)
    is_word = _WORD[data]
    edge = np.flatnonzero(np.diff(is_word, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    limits = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    doc = np.searchsorted(limits, starts, side="right")
    length = ends - starts
    window = np.lib.stride_tricks.sliding_window_view(data, 16)[starts] if len(starts) else np.zeros((0, 16), np.uint8)
    window = np.where(np.arange(16) < length[:, None], window, np.uint8(0))
    lo, hi = np.ascontiguousarray(window).view("<u8").T if len(starts) else (np.zeros(0, np.uint64),) * 2
    rows = [_slot(lo ^ (hi * _MIX[1]) ^ length.astype(np.uint64), 0)]
    for k in PREFIXES:
        mask = np.uint64((1 << 8 * k) - 1)
        rows.append(np.where(length >= k, _slot(lo & mask, k), 0))
    return Words(data, starts, ends, doc, np.array(rows))


def _slot(x: np.ndarray, salt: int) -> np.ndarray:
    h = (x + np.uint64(salt)) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return (h >> np.uint64(64 - BITS)).astype(np.int32) | 1  # never the empty slot


class Packed:
    """Sequences side by side: step t covers word t of every document that has one, longest documents first."""

    def __init__(self, doc: np.ndarray, n_docs: int) -> None:
        counts = np.bincount(doc, minlength=n_docs)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(n_docs, np.int64)
        rank[order] = np.arange(n_docs)
        first = np.cumsum(counts) - counts
        step = np.arange(len(doc)) - first[doc]
        self.sizes = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), side="left")
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.place = self.offsets[step] + rank[doc] if len(doc) else np.zeros(0, np.int64)


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    change: np.ndarray  # weights of plain→toxic, toxic→plain, toxic→toxic; plain→plain is 0

    def emissions(self, w: Words) -> np.ndarray:
        out = np.full(w.features.shape[1], self.bias)
        for row in w.features:
            out += self.weights[row]
        return np.clip(out, -30, 30)

    def passes(self, w: Words, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Packed]:
        """Toxic-to-plain ratios: of words, of the forward and of the backward pass, in packed order."""
        at = Packed(w.doc, n_docs)
        e = np.empty(len(w.doc))
        e[at.place] = np.exp(self.emissions(w))
        into, back, stay = np.exp(self.change)
        fwd, bwd = np.empty_like(e), np.ones_like(e)
        for t, (o, n) in enumerate(zip(at.offsets, at.sizes, strict=True)):
            if t:
                r = fwd[p : p + n]  # noqa: F821
                fwd[o : o + n] = np.clip(e[o : o + n] * (into + r * stay) / (1 + r * back), 1e-30, 1e30)
            else:
                fwd[o : o + n] = e[o : o + n] * into
            p = o
        for t in range(len(at.sizes) - 2, -1, -1):
            o, n, q = at.offsets[t], at.sizes[t + 1], at.offsets[t + 1]
            s = e[q : q + n] * bwd[q : q + n]
            bwd[o : o + n] = np.clip((back + stay * s) / (1 + into * s), 1e-30, 1e30)
        return e, fwd, bwd, at

    def context(self) -> int:
        """Words after which the passes have forgotten their start to 1e-12, whatever the words (Birkhoff's bound)."""
        ratio = self.change[2] - self.change[0] - self.change[1]
        rate = np.tanh(abs(ratio) / 4)
        return int(np.ceil(np.log(1e-12) / np.log(max(rate, 0.05)))) if rate < 0.999 else SEGMENT

    def marginals(self, w: Words, n_docs: int) -> np.ndarray:
        """Of each word; long documents go in overlapping segments, whose inner words are kept."""
        counts = np.bincount(w.doc, minlength=n_docs)
        if counts.max(initial=0) <= 2 * SEGMENT:
            return self._marginals(w, n_docs)
        first, reach = np.cumsum(counts) - counts, self.context()
        source, inner, part = [], [], []
        for d in range(n_docs):
            n = max(1, -(-counts[d] // SEGMENT)) if counts[d] > 2 * SEGMENT else 1
            size = -(-counts[d] // n)
            for k in range(n):
                lo, hi = k * size, min((k + 1) * size, counts[d])
                at = np.arange(max(0, lo - reach), min(counts[d], hi + reach))
                source.append(first[d] + at)
                inner.append((at >= lo) & (at < hi))
                part.append(len(at))
        src, use = np.concatenate(source), np.concatenate(inner)
        cut = Words(w.data, w.starts[src], w.ends[src], np.repeat(np.arange(len(part)), part), w.features[:, src])
        out = np.empty(len(w.doc))
        out[src[use]] = self._marginals(cut, len(part))[use]
        return out

    def _marginals(self, w: Words, n_docs: int) -> np.ndarray:
        _, fwd, bwd, at = self.passes(w, n_docs)
        odds = (fwd * bwd)[at.place]
        return odds / (1 + odds)


def token_labels(w: Words, toxic: np.ndarray) -> np.ndarray:
    """Labels of words from labels of documents."""
    in_toxic = toxic[w.doc]
    marked = np.zeros(len(w.doc), bool)
    n_toxic, n_clean = max(1, in_toxic.sum()), max(1, (~in_toxic).sum())
    share = max(1e-9, toxic.mean())
    for row in w.features:
        # Occurrences count up to PER_DOC a document, so that one long repetition marks nothing.
        pairs, times = np.unique(row.astype(np.int64) << 32 | w.doc, return_counts=True)
        feature, of_toxic = pairs >> 32, toxic[pairs & 0xFFFFFFFF]
        times = np.minimum(times, PER_DOC)
        a = np.bincount(feature[of_toxic], times[of_toxic], minlength=1 << BITS)
        b = np.bincount(feature[~of_toxic], times[~of_toxic], minlength=1 << BITS)
        d1 = np.bincount(feature[of_toxic], minlength=1 << BITS)
        d0 = np.bincount(feature[~of_toxic], minlength=1 << BITS)
        both = np.maximum(d1 + d0, 1)
        gain = 2 * (d1 * np.log(np.maximum(d1, 1e-9) / (both * share)) + d0 * np.log(np.maximum(d0, 1e-9) / np.maximum(both * (1 - share), 1e-9)))
        good = (gain >= SIGNIFICANT) & ((a + 0.5) / n_toxic >= LIFT * (b + 0.5) / n_clean)
        good[0] = False
        marked |= good[row]
    return marked & in_toxic


def fit_field(w: Words, n_docs: int, labels: np.ndarray, rounds: int = 25, rate: float = 0.3, penalty: float = 1e-3) -> Field:
    """Gradient ascent of the likelihood (Adam steps)."""
    f = Field(np.zeros(1 << BITS), -4.0, np.zeros(3))
    at = Packed(w.doc, n_docs)
    y = np.empty(len(labels), bool)
    y[at.place] = labels
    m = [np.zeros(1 << BITS), 0.0, np.zeros(3)]
    v = [np.zeros(1 << BITS), 0.0, np.zeros(3)]
    follows = [(o, q, n) for o, q, n in zip(at.offsets[:-1], at.offsets[1:], at.sizes[1:], strict=True)]
    prev = np.concatenate([np.arange(o, o + n) for o, _, n in follows]) if follows else np.zeros(0, int)
    here = np.concatenate([np.arange(q, q + n) for _, q, n in follows]) if follows else np.zeros(0, int)
    for step in range(1, rounds + 1):
        e, fwd, bwd, _ = f.passes(w, n_docs)
        odds = fwd * bwd
        d = (y - odds / (1 + odds))[at.place]
        into, back, stay = np.exp(f.change)
        r, s = fwd[prev], e[here] * bwd[here]
        parts = np.array([into * s, r * back, r * stay * s])
        parts /= 1 + parts.sum(axis=0)
        seen = np.array([(~y[prev] & y[here]).sum(), (y[prev] & ~y[here]).sum(), (y[prev] & y[here]).sum()])
        g_w = sum(np.bincount(row, d, minlength=1 << BITS) for row in w.features) - penalty * f.weights
        g_w[0] = 0
        grads = [g_w, d.sum(), seen - parts.sum(axis=1)]
        values = [f.weights, f.bias, f.change]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            values[i] = values[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        f = Field(values[0], float(values[1]), np.clip(values[2], -8, 8))
    return f


def document_features(p: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    total = np.bincount(doc, p, minlength=n_docs)
    n = np.bincount(doc, minlength=n_docs)
    return np.array([np.log1p(total), np.minimum(np.sqrt(100 * total / np.maximum(n, 20)), 4), np.log1p(n) / 5, np.ones(n_docs)]).T


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 50, penalty: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - penalty * w)
    return w


@dataclass
class Model:
    field: Field | None
    scorer: np.ndarray | None

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Scores, and the spans of toxic words (code points, end exclusive, mean marginal)."""
        if self.field is None:
            return np.zeros(len(texts)), [[] for _ in texts]
        w = words_of(texts)
        p = self.field.marginals(w, len(texts))
        z = document_features(p, w.doc, len(texts)) @ self.scorer
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        hot = np.flatnonzero(p >= SPAN_AT)
        if len(hot):
            # Code points before a byte: those that don't continue one.
            heads = np.cumsum((w.data & 0xC0) != 0x80)
            first = np.cumsum([0] + [len(t) + 1 for t in texts])
            for i in np.split(hot, np.flatnonzero((np.diff(hot) > 1) | (np.diff(w.doc[hot]) > 0)) + 1):
                d = int(w.doc[i[0]])
                spans[d].append((int(heads[w.starts[i[0]]] - 1 - first[d]), int(heads[w.ends[i[-1]] - 1] - first[d]), float(p[i].mean())))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def fit(texts: list[str], labels: list[int]) -> Model:
    """Fits the field on all rows, and the scorer on marginals by fields that have not seen the row."""
    y = np.array(labels, bool)
    folds = [np.arange(len(y)) % FOLDS == i for i in range(FOLDS)]
    if any(y[~f].all() or not y[~f].any() for f in folds):
        return Model(None, None)

    def part(use: np.ndarray) -> tuple[Words, int]:
        return words_of([t for t, u in zip(texts, use, strict=True) if u]), int(use.sum())

    x = np.zeros((len(y), 4))
    for other in folds:
        w, n = part(~other)
        field_ = fit_field(w, n, token_labels(w, y[~other]))
        w, n = part(other)
        x[other] = document_features(field_.marginals(w, n), w.doc, n)
    w, n = part(np.ones(len(y), bool))
    return Model(fit_field(w, n, token_labels(w, y)), fit_scorer(x, y.astype(float)))


def sampled(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, toxic, text`` of at most ``sample`` documents of each label; ``keep`` is on labels.doc_id."""
    spark = docs.sparkSession
    known = labels.filter(keep & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    picked = [r for y in (0, 1) for r in known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    ids = spark.createDataFrame(picked, "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs, "text")).filter(F.octet_length("text") <= SAMPLE_CHARS)
    # One text of an id, however often it is repeated.
    return rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def in_order(rows: list[tuple[int, int, bytes]]) -> tuple[list[str], list[int]]:
    """Texts and labels by label, then hash of the id: the folds get like shares."""
    rows = sorted(rows, key=lambda r: (r[1], r[0] * 2654435761 % 2**32, bytes(r[2])))
    return [bytes(r[2]).decode("utf-8", "replace") for r in rows], [r[1] for r in rows]


def training_rows(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """The rows of ``sampled``, which reach the driver, in order."""
    return in_order([tuple(r) for r in sampled(docs, labels, keep, sample).collect()])


def fit_in_task(rows: DataFrame) -> Model:
    """``fit`` of a bounded table (``sampled``) in one task, so that the driver holds neither texts nor features, but the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(*in_order(found)))], pa.binary())], names=["model"])

    made = rows.select("doc_id", "toxic", "text").coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else Model(None, None)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, spans`` of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 2**BITS weights: 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for b in slices(batches, "text", SLICE):
            scores, spans = sent.value.score([t.decode("utf-8", "replace") for t in b.column(1).to_pylist()])
            found = [[{"start": s, "end": e, "p": p} for s, e, p in x] for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(found, kind)], names=["doc_id", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with remainder 1 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return fit_in_task(sampled(docs, labels, remainder(F.col("doc_id")) != 1))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, model: Model | None = None) -> DataFrame:
    out = score(docs, model or fitted(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, as they are; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE):
            scores, _ = sent.value.score([t or "" for t in part.column(at).to_pylist()])
            yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
