"""Quality by weak labels.

Heuristic labellers vote good, bad or nothing on each document.  Their accuracies are not known:
expectation-maximisation estimates, for each labeller, how it votes on good and on bad documents,
from the counts of vote patterns over the whole corpus (at most 3 ** labellers numbers).  Posterior
labels then train a linear scorer on hashed byte trigrams, which scores every whole text.

The scorer is fitted on the first documents by a hash of id and text, at most ``sample`` of them and
at most ``train_bytes`` bytes in all, whole; votes, pattern counts and scores cover all rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import within_bytes, written
from .kernel import SLICE_BYTES, Texts, byte_set, lower_ascii, slices, trim, word_hashes

BITS = 14
SAMPLE = 4000
TRAIN_BYTES = 32 << 20
KEEP_FROM = 0.5
#: Trigrams that a text is taken to have besides its own and that say nothing: a short text tells little.
SHORT = 60

#: In the order of their columns; the thresholds are in ``_votes``.
LABELLERS = ("symbols", "marked_words", "plain_bytes", "small_letters", "shouting", "exclaiming", "repeating", "runs", "top_word", "word_length")
_SYMBOLS = byte_set((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_UPPER, _LETTER = byte_set((0x41, 0x5A)), byte_set((0x41, 0x5A), (0x61, 0x7A))
_SMALL = byte_set((0x61, 0x7A), (0x80, 0xFF))
_BANG = byte_set((0x21, 0x21))
_MARK = _SYMBOLS | byte_set((0x21, 0x21), (0x7C, 0x7C))
_BANG_OR_END = byte_set((0x21, 0x22), (0x2C, 0x2E), (0x3F, 0x3F))
_PLAIN = _LETTER | _SMALL | byte_set((0x09, 0x0D), (0x20, 0x20), (0x22, 0x22), (0x27, 0x29), (0x2C, 0x3B), (0x3F, 0x3F))


def _per_document(t: Texts, chosen: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(chosen, out=sums[1:])
    return np.diff(sums[t.offs]).astype(float)


def _votes(t: Texts) -> np.ndarray:
    """documents x labellers: 1 good, -1 bad, 0 nothing."""
    size = np.maximum(np.diff(t.offs), 1)
    words, docs, starts, ends = word_hashes(Texts(t.first, lower_ascii(t.data), t.offs))
    n = np.bincount(docs, minlength=t.n)
    least = np.maximum(n, 1)
    owner, often = _distinct_words(docs, words)
    distinct = np.bincount(owner, minlength=t.n)
    top = np.zeros(t.n)
    np.maximum.at(top, owner, often)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (docs[1:] == docs[:-1])
    letters = np.maximum(_per_document(t, _LETTER[t.data]), 1)
    small = _per_document(t, _SMALL[t.data])
    marked = _MARK[t.data[ends - 1]] & ~_BANG_OR_END[t.data[ends - 1]] | _BANG[t.data[ends - 1]]
    mean = np.bincount(docs, ends - starts, t.n) / least

    def rising(x, good_to, bad_from):
        return np.where(x >= bad_from, -1, np.where(x <= good_to, 1, 0))

    # the expected number of distinct words of ordinary text falls with its length
    variety = distinct / np.minimum(least, 6 * least**0.7)
    out = [
        rising(_per_document(t, _MARK[t.data]) / size, 0.01, 0.03),
        rising(np.bincount(docs, marked, t.n) / least, 0.03, 0.12),
        rising(_per_document(t, ~_PLAIN[t.data]) / size, 0.02, 0.05),
        rising(1 - small / size, 0.3, 0.45),
        rising(_per_document(t, _UPPER[t.data]) / letters, 0.15, 0.5),
        rising(_per_document(t, _BANG[t.data]) / least, 0.02, 0.15),
        -rising(variety, 0.35, 0.55),
        rising(np.bincount(docs, same, t.n) / least, 0.05, 0.15),
        rising(top / least, 0.12, 0.2),
        np.where(mean > 20, -1, np.where((mean > 3) & (mean < 10), 1, 0)),
    ]
    votes = np.stack(out, axis=1).astype(np.int8)
    votes[n < 20] = np.where(votes[n < 20] > 0, 0, votes[n < 20])  # a few words say nothing good
    votes[n < 5] = 0
    votes[n == 0] = -1
    return votes


def _distinct_words(docs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and count of every distinct word of every document."""
    order = np.lexsort((words, docs))
    d, w = docs[order], words[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    return d[first], np.diff(np.append(first, len(d)))


class LabelModel(NamedTuple):
    good: float  # share of good documents
    votes: np.ndarray  # class (bad, good) x labeller x vote (bad, good): probabilities of votes cast


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, belief: float = 0.2) -> LabelModel:
    """EM on vote patterns (rows of -1, 0, 1).

    It starts from the belief that one bad vote makes a document bad, and that bad votes are rare on
    good ones; the belief counts as much as a share ``belief`` of the documents, so the classes stay
    the right way round and a labeller that sees only one kind of fault keeps its say."""
    m = patterns.shape[1]
    if not len(counts):
        return LabelModel(0.5, np.full((2, m, 2), 0.5))
    post = np.where((patterns < 0).any(axis=1), 0.05, 0.95)
    onehot = patterns[:, :, None] == np.array([-1, 1])
    total = counts.sum()
    prior = np.broadcast_to(np.array([[0.45, 0.55], [0.01, 0.99]])[:, None, :], (2, m, 2)) * (belief * total + 1)
    for _ in range(rounds):
        good = np.clip((post * counts).sum() / total, 1e-3, 1 - 1e-3)
        votes = np.stack([np.tensordot((1 - post) * counts, onehot, 1), np.tensordot(post * counts, onehot, 1)]) + prior
        votes /= votes.sum(axis=2, keepdims=True)
        new = posterior(LabelModel(good, votes), patterns)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return LabelModel(float(good), votes)


def posterior(model: LabelModel, patterns: np.ndarray) -> np.ndarray:
    """Probability of good for each row of votes."""
    weight = np.log(model.votes[1]) - np.log(model.votes[0])  # of a bad and of a good vote
    diff = np.where(patterns < 0, weight[:, 0], np.where(patterns > 0, weight[:, 1], 0.0)).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(diff + np.log(model.good / (1 - model.good)), -500, 500)))


def _trigrams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams that lie within one document, and their documents."""
    if len(t.data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = t.data.astype(np.uint32)
    code = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
    owner = np.repeat(np.arange(t.n), np.diff(t.offs))
    ok = owner[:-2] == owner[2:]
    h = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    return h[ok], owner[:-2][ok]


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float


def fit_scorer(texts: list[str], soft: np.ndarray, *, rounds: int = 250, rate: float = 2.0, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on shares of trigrams against posterior labels."""
    size = 1 << BITS
    if not texts:
        return Scorer(np.zeros(size, np.float32), 0.0)
    row, col, val, base = [], [], [], 0
    for t in slices(pa.array(texts, pa.string())):
        h, d = _trigrams(t)
        key, n = np.unique(d * size + h, return_counts=True)
        total = np.maximum(np.bincount(d, minlength=t.n), 1)
        row.append(key // size + base)
        col.append(key % size)
        val.append(np.sqrt(n / (total[key // size] + SHORT)))
        base += t.n
    row, col, val = map(np.concatenate, (row, col, val))
    w, b = np.zeros(size), 0.0
    g2, gb2 = np.full(size, 1e-8), 1e-8
    share = np.clip(soft.mean(), 0.02, 0.98)
    weight = soft + (1 - soft) * np.sqrt(share / (1 - share))
    for _ in range(rounds):
        x = np.bincount(row, w[col] * val, base) + b
        err = weight * (1 / (1 + np.exp(-np.clip(x, -30, 30))) - soft) / base
        g = np.bincount(col, err[row] * val, size) + ridge * w / size
        g2 += g * g
        gb2 += err.sum() ** 2
        w -= rate * g / np.sqrt(g2) * 0.1
        b -= rate * err.sum() / np.sqrt(gb2) * 0.1
    return Scorer(w.astype(np.float32), float(b))


def _scores(t: Texts, s: Scorer) -> np.ndarray:
    h, d = _trigrams(t)
    total = np.bincount(d, minlength=t.n)
    # the square root of a share is a sum over a document's distinct trigrams
    order = np.argsort(d * (1 << BITS) + h, kind="stable") if len(h) else np.zeros(0, np.int64)
    key = (d * (1 << BITS) + h)[order]
    first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    k = key[first] if len(key) else key
    own = k >> BITS
    x = np.bincount(own, s.weights[k & ((1 << BITS) - 1)] * np.sqrt(n / (total[own] + SHORT)), t.n) + s.bias
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


_VOTES = ", ".join(f"v_{n} int" for n in LABELLERS)


def votes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, a hash of the row (``_row``) and one column ``v_<labeller>`` for each labeller."""
    schema = pa.schema([("doc_id", pa.int64()), ("_row", pa.int64()), *[(f"v_{n}", pa.int32()) for n in LABELLERS]])

    def run(batches):
        trim()
        for batch in batches:
            for t in slices(batch.column(1), SLICE_BYTES):
                v = _votes(t).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(t.first, t.n), batch.column(2).slice(t.first, t.n), *[pa.array(v[:, i]) for i in range(v.shape[1])]], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text), F.xxhash64(F.col(doc_id), F.col(text))).mapInArrow(run, f"doc_id long, _row long, {_VOTES}")


def classified(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, train_bytes: int = TRAIN_BYTES, keep_from: float = KEEP_FROM) -> DataFrame:
    """``doc_id``, ``posterior`` (of the label model), ``score`` (of the scorer), ``keep`` (the mean of both
    is ``keep_from`` or more) and the votes.

    Null and empty texts get bad votes from all, texts of fewer than five words none.  Every row is judged by its text; repeated
    rows and null ids stay.  In an empty table nothing is learnt and nothing returned.
    """
    spark = docs.sparkSession
    cast = written(votes(docs, doc_id=doc_id, text=text), "votes")
    names = [f"v_{n}" for n in LABELLERS]
    seen = cast.groupBy(*names).count().toArrow()
    patterns = np.stack([seen[n].to_numpy() for n in names], axis=1)
    labels = fit_labels(patterns, seen["count"].to_numpy().astype(float))
    # a bounded sample of rows, found by their hash, gives the scorer its texts
    rows = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("_row"), F.col(text).alias("_text")).where("_text <> ''")
    first = F.broadcast(rows.select("_row").distinct().orderBy("_row").limit(sample))  # ``sample`` numbers at most
    rows = rows.join(first, "_row").groupBy("_row").agg(F.min("_text").alias("_text"))
    picked = within_bytes(rows, "_text", ["_row"], train_bytes).orderBy("_row").select("_text").toArrow()["_text"]
    v = []
    for t in slices(picked):
        v.append(_votes(t))
    soft = posterior(labels, np.concatenate(v)) if v else np.zeros(0)
    sent = spark.sparkContext.broadcast((labels, fit_scorer(picked.to_pylist(), soft)))
    schema = pa.schema([("doc_id", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_()), *[(n, pa.int32()) for n in names]])

    def run(batches):
        trim()
        labels, scorer = sent.value
        for batch in batches:
            for t in slices(batch.column(1), SLICE_BYTES):
                v = _votes(t)
                p, s = posterior(labels, v), _scores(t, scorer)
                yield pa.record_batch([batch.column(0).slice(t.first, t.n), pa.array(p), pa.array(s), pa.array((p + s) / 2 >= keep_from), *[pa.array(v[:, i].astype(np.int32)) for i in range(v.shape[1])]], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, f"doc_id long, posterior double, score double, keep boolean, {_VOTES}")

