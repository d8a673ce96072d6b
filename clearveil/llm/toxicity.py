"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic function of hashed words
and word beginnings; the document's is the noisy-or of its sentences', and that is what is fitted to
document labels, so the sentences at fault are found without a label of their own.

Training reads the first labelled documents of each class by a hash of their id, at most
``per_class`` of them and at most ``train_bytes`` bytes in all, whole, on the driver; weights are one
table of 2**18 numbers.
Scoring is one pass over whole texts without an exchange.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, within_bytes
from .kernel import SLICE_BYTES, U, Texts, byte_set, lower_ascii, slices, span_hashes, trim, word_bounds

BITS = 18
PREFIXES = (4, 5, 6, 7, 8, 10)
THRESHOLD = 0.3
PER_CLASS = 3000
TRAIN_BYTES = 24 << 20
FOLDS, HELD_OUT = 4, 2
#: Words are digits, letters and everything beyond ASCII.
SEPARATORS = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
ENDS = byte_set((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))


class Model(NamedTuple):
    weights: np.ndarray  # float32, 2**BITS; zero: the feature says nothing
    known: np.ndarray  # bool, 2**BITS
    bias: float


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word: its sentence's number in the slice, document, start, end; and features x words."""
    t = Texts(t.first, lower_ascii(t.data), t.offs)
    starts, ends, docs = word_bounds(t, SEPARATORS)
    mask = (1 << BITS) - 1
    rows = [span_hashes(t.data, starts, ends) & U(mask)]
    for n in PREFIXES:
        cut = np.minimum(starts + n, ends)
        h = (span_hashes(t.data, starts, cut) ^ U(n * 0x51ED27)) & U(mask)
        rows.append(np.where(ends - starts > n, h, U(mask + 1)))  # the last place: no such beginning
    stops = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(ENDS[t.data], out=stops[1:])
    key = stops[starts] + docs  # grows by one at least at every end of a sentence or document
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (docs[1:] != docs[:-1])
    return np.cumsum(new) - 1, docs, starts, ends, np.stack(rows).astype(np.int64)


def fit(texts: list[str], labels: list[int], *, rounds: int = 300, rate: float = 0.25, shrink: float = 1e-3) -> Model:
    """Noisy-or likelihood by gradient descent with Adam's steps.  Without both classes the model is empty."""
    size = 1 << BITS
    empty = Model(np.zeros(size + 1, np.float32), np.zeros(size + 1, bool), -6.0)
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return empty
    column = pa.array(texts, pa.string())
    with_, bad = np.zeros(size), np.zeros(size)
    for t in slices(column, SLICE_BYTES // 2):  # in how many documents, and bad documents, a feature is
        _, d, _, _, rows = _features(t)
        pairs = np.unique((rows * t.n + d)[rows < size])
        f, d = pairs // t.n, pairs % t.n + t.first
        with_ += np.bincount(f, minlength=size)
        bad += np.bincount(f, y[d], size)
    n1, n0 = y.sum(), len(y) - y.sum()
    rate0, rate1 = (with_ - bad + 0.5) / (n0 + 1), (bad + 0.5) / (n1 + 1)
    pool = with_ / len(y)
    z = (rate1 - rate0) / np.sqrt(np.maximum(pool * (1 - pool), 1e-9) * (1 / n1 + 1 / n0))
    use = (np.abs(z) >= 3.0) & (with_ >= 4) & ~((rate1 > rate0) & (bad < 3))
    if not use.any():
        return empty
    index = np.cumsum(use) - 1
    doc, sentence, feature, base = [], [], [], 0
    for t in slices(column, SLICE_BYTES // 2):
        s, d, _, _, rows = _features(t)
        for row in rows:
            keep = np.flatnonzero(np.append(use, False)[row])
            doc.append(d[keep] + t.first)
            sentence.append(s[keep] + base)
            feature.append(index[row[keep]])
        base += (s[-1] + 1) if len(s) else 0
    d, s, f = map(np.concatenate, (doc, sentence, feature))
    u = np.unique(s * int(use.sum()) + f)
    at = np.unique(s, return_index=True)
    names, owner = at[0], d[at[1]]
    s, f = np.searchsorted(names, u // int(use.sum())), u % int(use.sum())
    w = np.log(rate1 / rate0)[use] * 0.5
    b = -3.0
    grads = [np.zeros(len(w) + 1), np.zeros(len(w) + 1)]
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    for step in range(1, rounds + 1):
        x = np.bincount(s, w[f], len(names)) + b
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        q = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of no sentence at fault
        none = np.exp(np.minimum(q, -1e-9))
        slope = weight * np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)
        g = p * slope[owner]
        full = np.append(np.bincount(f, g[s], len(w)) + shrink * np.sign(w) / 10, g.sum())
        grads[0] = 0.9 * grads[0] + 0.1 * full
        grads[1] = 0.999 * grads[1] + 0.001 * full**2
        move = rate * (0.2 + 0.8 * (1 - step / rounds)) * grads[0] / (1 - 0.9**step) / (np.sqrt(grads[1] / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights, known = np.zeros(size + 1, np.float32), np.zeros(size + 1, bool)
    weights[:-1][use] = w
    known[:-1] = use
    return Model(weights, known, float(b))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, train_bytes: int = TRAIN_BYTES, hold_out: bool = True) -> Model:
    """Fit on a bounded sample of labelled documents: of each class the first ``per_class`` by a hash
    of the id, as far as their texts together have at most ``train_bytes`` bytes.

    Rows without id, label or text are not read.  An id with labels 0 and 1 is toxic; of rows with one
    id the smallest text is read.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    if hold_out:
        known = known.where(fold(F.col("_id")) != HELD_OUT)
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = [known.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # 2 * per_class rows at most, so its broadcast is bounded
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).where("_text is not null")
    rows = texts.join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).withColumn("_h", F.xxhash64("_id"))
    rows = within_bytes(rows, "_text", ["_h", "_id"], train_bytes, ["_y"]).orderBy("_id").select("_text", "_y").toArrow()
    return fit(rows["_text"].to_pylist(), rows["_y"].to_pylist())


def _sentences(t: Texts, m: Model):
    """Sentences with evidence: document, first byte, last byte, probability."""
    s, docs, starts, ends, f = _features(t)
    if not len(s):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(float)
    x = np.zeros(len(s))
    any_ = np.zeros(len(s), bool)
    for row in f:
        x += m.weights[row]
        any_ |= m.known[row]
    first = np.flatnonzero(np.diff(s, prepend=-1))
    last = np.append(first[1:], len(s)) - 1
    total = np.add.reduceat(x, first)
    some = np.logical_or.reduceat(any_, first)
    p = 1 / (1 + np.exp(-np.clip(total + m.bias, -30, 30)))
    return docs[first][some], starts[first][some], ends[last][some], p[some]


def scored(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score``, ``predicted``, and the worst sentence's ``worst_start``, ``worst_end`` (bytes).

    A sentence without any known feature has probability 0; so have null and empty texts, whose
    worst sentence is null.  Every row is scored by its text alone; repeated rows and null ids stay.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    names = ["doc_id", "score", "predicted", "worst_start", "worst_end"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()], strict=True)))

    def run(batches):
        trim()
        m = sent.value
        for batch in batches:
            for t in slices(batch.column(1), SLICE_BYTES):
                d, a, b, p = _sentences(t, m)
                none = np.bincount(d, np.log1p(-np.minimum(p, 1 - 1e-12)), t.n)
                score = np.clip(-np.expm1(none), 0.0, 1.0)
                worst = np.full((t.n, 2), -1, np.int64)
                order = np.argsort(p, kind="stable")
                worst[d[order]] = np.stack([a[order] - t.offs[d[order]], b[order] - t.offs[d[order]]], axis=1)
                lost = worst[:, 0] < 0
                cols = [batch.column(0).slice(t.first, t.n), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(worst[:, 0], mask=lost), pa.array(worst[:, 1], mask=lost)]
                yield pa.record_batch(cols, schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, score double, predicted int, worst_start long, worst_end long")


def without_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        trim()
        for batch in batches:
            for t in slices(batch.column(at), SLICE_BYTES):
                d, _, _, p = _sentences(t, sent.value)
                score = -np.expm1(np.bincount(d, np.log1p(-np.minimum(p, 1 - 1e-12)), t.n))
                yield batch.slice(t.first, t.n).filter(pa.array(score < threshold))

    numbered = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])  # names may hold anything
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def offending_sentences(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, probability) of every sentence of probability ``least`` or more; bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches):
        trim()
        for batch in batches:
            for t in slices(batch.column(1), SLICE_BYTES):
                d, a, b, p = _sentences(t, sent.value)
                ok = p >= least
                d, a, b, p = d[ok], a[ok], b[ok], p[ok]
                yield pa.record_batch([batch.column(0).slice(t.first, t.n).take(pa.array(d)), pa.array(a - t.offs[d]), pa.array(b - t.offs[d]), pa.array(p)], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, start long, end long, probability double")
