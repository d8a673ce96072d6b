"""Scoring by prediction by partial matching (PPM, escape method C, with symbol exclusion).

A trie of byte contexts up to ORDER bytes is counted over all training texts.  A byte's probability
comes from the longest context that has been seen; where the byte is new there, the escape estimate
d / (n + d) is paid and the next shorter context is asked, without the bytes already excluded.  A
text ends with an end mark, which is coded too, and begins in a context of end marks.

The trie is fixed once counted (pretrained), so a context's totals without the excluded bytes are
numbers of that context: excluded bytes are just those of the next longer context, because every
byte seen in a context has been seen in the shorter one.  That makes scoring table look-ups on whole
arrays.  ``adaptive_bits`` is the textbook coder that learns as it goes, for single texts.

The trie is spread over the cluster and holds every gram of the training texts.  A place's
probability depends on its longest gram alone: each group of documents asks once for each of its
distinct grams and tells how often its training texts have it.  The sums by gram are dealt out by
the last NEAR bytes of the context, so a part has all that longer contexts of its grams need; what
shorter contexts need is counted by at most NEAR bytes, 256**NEAR numbers whatever the corpus, and
sent to all.  The probabilities go back the way the requests came.

The base score needs the corpus count of every word of every document, which is asked for in the
same way; nothing of the vocabulary comes to the driver.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, group_count, in_groups, written
from .kernel import U, Mail, Texts, lower_ascii, mix, slices, trim, word_hashes

#: Smaller than elsewhere: each byte has several numbers of eight bytes here.
SLICE_BYTES = 1 << 20
ORDER = 5
#: Last bytes of a context by which grams are dealt out; levels below are sent to all.
NEAR = 3
FOLDS, HELD_OUT = 7, 2
#: Never a byte of UTF-8: the end mark.
END = 0xFF


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _grams(t: Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order bytes before and the byte itself at every place of every text and its end, as
    numbers with the oldest byte highest; and the document of each."""
    lens = np.diff(t.offs)
    doc = np.repeat(np.arange(t.n), lens)
    stream = np.full(len(t.data) + order * (t.n + 1), END, np.uint8)
    stream[np.arange(len(t.data)) + order * (doc + 1)] = lower_ascii(t.data)
    code = np.zeros(len(stream) - order, np.uint64)
    for i in range(order + 1):
        code = (code << U(8)) | stream[i : len(stream) - order + i].astype(np.uint64)
    # code[j] is of stream place j + order; a text's places are its bytes and the mark after them
    owner = np.repeat(np.arange(t.n), lens + order)
    place = np.arange(len(owner)) - np.repeat(t.offs[:-1] + order * np.arange(t.n), lens + order)
    ok = place <= lens[owner]
    return code[: len(owner)][ok], owner[ok]


class Trie(NamedTuple):
    """Level j has grams of j context bytes and a symbol, sorted; contexts by their first gram."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    total: list[np.ndarray]  # n of a context
    kinds: list[np.ndarray]  # d of a context
    rest: list[np.ndarray]  # n of the shorter context without this context's symbols (level 0: 0)
    rest_kinds: list[np.ndarray]


_MULT = U(0x9E3779B97F4A7C15)
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    bits = max(4, int(math.ceil(math.log2(max(1, len(keys)) * 2))))
    shift = 64 - bits
    k, v = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.float32)
    at, left = ((keys * _MULT) >> U(shift)).astype(np.int64), np.arange(len(keys))
    while len(left):
        free = k[at] == _EMPTY
        _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
        put = first[free[first]]
        k[at[put]], v[at[put]] = keys[left[put]], values[left[put]]
        stay = np.ones(len(left), bool)
        stay[put] = False
        left, at = left[stay], (at[stay] + 1) & ((1 << bits) - 1)
    return k, v, shift


def build(levels: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
    """levels[j]: grams with j context bytes and their counts."""
    grams, counts, contexts, total, kinds, rest, rest_kinds = ([] for _ in range(7))
    for j, (g, c) in enumerate(levels):
        order = np.argsort(g)
        g, c = g[order].astype(np.uint64), c[order].astype(np.int64)
        ctx, first = np.unique(g >> U(8), return_index=True)
        n = np.add.reduceat(c, first) if len(g) else np.zeros(0, np.int64)
        d = np.diff(np.append(first, len(g)))
        if j and len(g):
            mask = U((1 << (8 * j)) - 1)
            at = np.searchsorted(grams[j - 1], g & mask)
            lower = counts[j - 1][at]
            up = np.searchsorted(contexts[j - 1], ctx & (mask >> U(8)))
            rest.append(total[j - 1][up] - np.add.reduceat(lower, first))
            rest_kinds.append(kinds[j - 1][up] - d)
        else:
            rest.append(np.zeros(len(ctx), np.int64))
            rest_kinds.append(np.zeros(len(ctx), np.int64))
        for out, x in zip((grams, counts, contexts, total, kinds), (g, c, ctx, n, d), strict=True):
            out.append(x)
    return Trie(grams, counts, contexts, total, kinds, rest, rest_kinds)


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def _escaped(trie: Trie, code: np.ndarray) -> np.ndarray:
    """log10 probabilities of longest grams, whether or not they are in the trie."""
    out = np.zeros(len(code))
    open_ = np.arange(len(code))
    above = np.full(len(code), -1)  # the longer context whose symbols are excluded
    for j in range(len(trie.grams) - 1, -1, -1):
        if not len(open_):
            return out
        mask = U((1 << (8 * (j + 1))) - 1)
        g = code[open_] & mask
        at, seen = _find(trie.contexts[j], g >> U(8))
        gram, has = _find(trie.grams[j], g)
        up = above[open_]
        n, d = (trie.total[j][at], trie.kinds[j][at]) if len(trie.contexts[j]) else (np.zeros(len(g)), np.zeros(len(g)))
        if j + 1 < len(trie.grams):
            ex = up >= 0
            n = np.where(ex, trie.rest[j + 1][np.maximum(up, 0)] if len(trie.rest[j + 1]) else 0, n)
            d = np.where(ex, trie.rest_kinds[j + 1][np.maximum(up, 0)] if len(trie.rest[j + 1]) else 0, d)
        hit = seen & has
        with np.errstate(divide="ignore", invalid="ignore"):
            coded = np.log10(trie.counts[j][gram] / (n + d)) if len(trie.grams[j]) else np.zeros(len(g))
            escape = np.where(seen & (d > 0), np.log10(d / (n + d)), 0.0)
        out[open_] += np.where(hit, coded, escape)
        above[open_] = np.where(seen, at, -1)
        open_ = open_[~hit]
    # nothing seen: any of the bytes that no text has had is as likely
    used = int(trie.kinds[0].sum()) if len(trie.kinds[0]) else 0
    out[open_] -= math.log10(max(1, 256 - used))
    return out


def log10_probabilities(known: tuple[np.ndarray, np.ndarray, int], t: Texts, order: int = ORDER) -> np.ndarray:
    """One number for each text of a slice, whose grams are all in the hash table ``known``."""
    keys, values, shift = known
    code, owner = _grams(t, order)
    at = ((code * _MULT) >> U(shift)).astype(np.int64)
    p = values[at].astype(np.float64)
    open_ = np.flatnonzero(keys[at] != code)
    at = at[open_]
    while len(open_):
        at = (at + 1) & (len(keys) - 1)
        hit = keys[at] == code[open_]
        p[open_[hit]] = values[at[hit]]
        open_, at = open_[~hit], at[~hit]
    return np.bincount(owner, p, t.n)


def adaptive_bits(text: str, order: int = ORDER) -> float:
    """Code length in bits of one text by a trie that starts empty and learns every byte."""
    counts: dict[bytes, dict[int, int]] = {}
    past, bits = bytes([END]) * order, 0.0
    for b in lower_ascii(np.frombuffer(text.encode(), np.uint8)).tobytes() + bytes([END]):
        excluded: set[int] = set()
        for j in range(order, -1, -1):
            seen = counts.get(past[len(past) - j :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in excluded}
            n, d = sum(left.values()), len(left)
            if b in left:
                bits -= math.log2(left[b] / (n + d))
                break
            if d:
                bits -= math.log2(d / (n + d))
            excluded |= seen.keys()
        else:
            bits += math.log2(256 - len(excluded))
        for j in range(order + 1):
            c = counts.setdefault(past[len(past) - j :], {})
            c[b] = c.get(b, 0) + 1
        past = (past + bytes([b]))[1:] if order else b""
    return bits


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and the sums of their counts."""
    g = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    if not len(g):
        return g, np.zeros(0, np.int64)
    order = np.argsort(g)
    g, c = g[order], np.concatenate([p[1] for p in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.add.reduceat(c.astype(np.int64), first)


def _counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else np.zeros(1, np.int64)
    return code[cuts[:-1]], np.diff(cuts)


def group_grams(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a group's texts, sorted, and how often its training texts have each."""
    learns, parts = ~table.column("_held").to_numpy().astype(bool), []
    for t in slices(table.column("_text"), SLICE_BYTES):
        code, owner = _grams(t, order)
        own = learns[t.first : t.first + t.n][owner]
        parts.append(_counted(code[own]))
        u, _ = _counted(code[~own])
        parts.append((u, np.zeros(len(u), np.int64)))
        if sum(len(u) for u, _ in parts) > 1 << 21 and len(parts) > 8:
            parts = [_added(parts)]
    return _added(parts)


def _mask(level: int) -> np.uint64:
    return U((1 << (8 * (level + 1))) - 1)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as their number of bytes and then all first bytes, all second ones and so on:
    most of the high ones are equal, which any codec stores in next to nothing."""
    wide = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([wide]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def _whole(message: bytes) -> np.ndarray:
    planes = np.frombuffer(message, np.uint8, offset=1).reshape(message[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : message[0]] = planes.T
    return out.view("<u8").ravel()


def _posted(mail: Mail, values: np.ndarray) -> list[bytes]:
    v = values[mail.order]
    return [_planes(v[a:b]) for a, b in zip(mail.cuts[:-1], mail.cuts[1:], strict=True)]


def _messages(column) -> list[np.ndarray]:
    return [_whole(x) for x in column.to_pylist()]


def _counts(column) -> list[np.ndarray]:
    return [x.astype(np.int64) for x in _messages(column)]


_SUMS = pa.schema([("_bucket", pa.int32()), ("_part", pa.int32()), ("_grams", pa.binary()), ("_n", pa.binary())])
_KNOWN = pa.schema([("_bucket", pa.int32()), ("_grams", pa.binary()), ("_p", pa.binary())])


def gram_sums(requests: DataFrame, order: int, parts: int) -> DataFrame:
    """Each distinct gram once with its count in all training texts, in messages from its bucket to its part."""
    near = min(NEAR, order)

    def add(table: pa.Table) -> pa.Table:
        trim()
        bucket = table.column("_bucket")[0].as_py()
        grams, counts = _messages(table.column("_hash")), _counts(table.column("_n"))
        u, c = _added(list(zip(grams, counts, strict=True)))
        mail = Mail(mix((u >> U(8)) & U((1 << (8 * near)) - 1)), parts)
        return pa.table([pa.array([bucket] * len(mail.buckets), pa.int32()), pa.array(mail.buckets.tolist(), pa.int32()), pa.array(_posted(mail, u), pa.binary()), pa.array(_posted(mail, c), pa.binary())], schema=_SUMS)

    return requests.groupBy("_bucket").applyInArrow(add, "_bucket int, _part int, _grams binary, _n binary")


def short_levels(sums: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams of less than ``near`` context bytes and their counts: bounded by the number of byte values."""
    near = min(NEAR, order)
    if not near:
        return []
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        trim()
        for batch in batches:
            u, c = _added([(g & _mask(near - 1), n) for g, n in zip(_messages(batch.column(0)), _counts(batch.column(1)), strict=True)])
            yield pa.record_batch([pa.array(u.astype(np.int64)), pa.array(c)], schema=schema)

    rows = sums.select("_grams", "_n").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    g, c = rows["gram"].to_numpy().astype(np.uint64), rows["n"].to_numpy()
    return [_added([(g & _mask(j), c)]) for j in range(near)]


def gram_probabilities(sums: DataFrame, order: int, buckets: int) -> DataFrame:
    """log10 probabilities of all distinct grams, in messages back to their buckets."""
    short = sums.sparkSession.sparkContext.broadcast(short_levels(sums, order))

    def run(table: pa.Table) -> pa.Table:
        trim()
        grams = np.concatenate(_messages(table.column("_grams")))
        n = np.concatenate(_counts(table.column("_n")))
        learnt = grams[n > 0], n[n > 0]
        levels = [*short.value, *[_added([(learnt[0] & _mask(j), learnt[1])]) for j in range(min(NEAR, order), order + 1)]]
        mail = Mail(mix(grams), buckets)
        p = _escaped(build(levels), grams).astype(np.float32)
        return pa.table([pa.array(mail.buckets.tolist(), pa.int32()), pa.array(_posted(mail, grams), pa.binary()), pa.array(mail.packed(p), pa.binary())], schema=_KNOWN)

    return sums.select("_part", "_grams", "_n").groupBy("_part").applyInArrow(run, "_bucket int, _grams binary, _p binary")


def gram_replies(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Answers to the groups: the probabilities of the grams of each request, in its order."""

    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        trim()
        grams = np.concatenate(_messages(told.column("_grams")))
        order = np.argsort(grams)
        grams, p = grams[order], np.concatenate([np.frombuffer(x, np.float32) for x in told.column("_p").to_pylist()])[order]
        back = [p[np.searchsorted(grams, x)].tobytes() for x in _messages(asked.column("_hash"))]
        return pa.table([asked.column("_grp"), asked.column("_bucket"), pa.array(back, pa.binary())], names=["_grp", "_bucket", "_n"])

    return requests.select("_bucket", "_grp", "_hash").groupBy("_bucket").cogroup(known.groupBy("_bucket")).applyInArrow(run, "_grp int, _bucket int, _n binary")


_REQUEST = pa.schema([("_gram", pa.bool_()), ("_bucket", pa.int32()), ("_grp", pa.int32()), ("_hash", pa.binary()), ("_n", pa.binary())])
_REPLY = pa.schema([("_grp", pa.int32()), ("_bucket", pa.int32()), ("_n", pa.binary()), ("_kinds", pa.int64()), ("_total", pa.int64())])


def _words(table: pa.Table):
    got = []
    for t in slices(table.column("_text"), SLICE_BYTES):
        lowered = Texts(t.first, lower_ascii(t.data), t.offs)
        h, docs, _, _ = word_hashes(lowered)
        got.append((t, h, docs))
    all_ = np.concatenate([h for _, h, _ in got]) if got else np.zeros(0, np.uint64)
    return got, *np.unique(all_, return_inverse=True)


def scored(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Base and PPM scores of every row, learnt from rows of other folds than the held-out one.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score`` (log10 probabilities) and ``bits_per_byte``.  A null text is empty: its end is its one
    token.  A null id is held out of nothing and learns; repeated rows count as often as they come.
    Without training rows every count is 0 and the trie is empty: bytes are equally likely.
    """
    groups = group_count(docs, text)
    buckets = max(64, groups // 2)
    held = F.coalesce(fold(F.col(doc_id)) == HELD_OUT, F.lit(False))
    base = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), held.alias("_held"))
    by_group = in_groups(base, groups, "_id", "_text", "_held").groupBy("_grp")

    def ask(table: pa.Table) -> pa.Table:
        trim()
        grp = table.column("_grp")[0].as_py()
        got, u, inv = _words(table)
        learns = ~table.column("_held").to_numpy().astype(bool)
        weight = np.concatenate([learns[t.first : t.first + t.n][docs] for t, _, docs in got]) if got else np.zeros(0)
        n = np.bincount(inv, weight, len(u)).astype(np.int64)
        g, c = group_grams(table, order)
        out = []
        for gram, mail, key, count in ((False, Mail(u, buckets), u, n), (True, Mail(mix(g), buckets), g, c)):
            k = len(mail.buckets)
            out.append(pa.table([pa.array([gram] * k, pa.bool_()), pa.array(mail.buckets.tolist(), pa.int32()), pa.array([grp] * k, pa.int32()), pa.array(_posted(mail, key), pa.binary()), pa.array(_posted(mail, count), pa.binary())], schema=_REQUEST))
        return pa.concat_tables(out)

    def total(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        hashes = _messages(table.column("_hash"))
        u, inv = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.bincount(inv, np.concatenate(_counts(table.column("_n"))), len(u)).astype(np.int64)
        back, cuts = c[inv], np.cumsum([0] + [len(h) for h in hashes])
        rows = table.num_rows
        once = [int((c > 0).sum())] + [0] * (rows - 1), [int(c.sum())] + [0] * (rows - 1)
        return pa.table([table.column("_grp"), table.column("_bucket"), pa.array([back[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), pa.array(once[0], pa.int64()), pa.array(once[1], pa.int64())], schema=_REPLY)

    requests = written(by_group.applyInArrow(ask, "_gram boolean, _bucket int, _grp int, _hash binary, _n binary"), "requests")
    words, grams = (requests.where(c).drop("_gram") for c in ("not _gram", "_gram"))
    replies = written(words.groupBy("_bucket").applyInArrow(total, "_grp int, _bucket int, _n binary, _kinds long, _total long"), "word-counts")
    dealt = written(gram_sums(grams, order, max(64, buckets // 16)), "gram-sums")
    told = written(gram_replies(grams, gram_probabilities(dealt, order, buckets)), "gram-replies")
    dropped(requests, dealt)
    sums = replies.agg(F.sum("_kinds").alias("v"), F.sum("_total").alias("n")).first()
    ends = base.where("not _held").count()
    kinds, tokens = (sums["v"] or 0) + (ends > 0), (sums["n"] or 0) + ends
    log_n, log_end = math.log10(tokens + kinds + 1), math.log10(ends + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kinds_ = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        out = [[] for _ in names]
        if left.num_rows:
            got, u, inv = _words(left)
            of_gram = right.column("_gram")
            word, gram = right.filter(pc.invert(of_gram)), right.filter(of_gram)
            c = Mail(u, buckets).replies(word.column("_bucket").to_pylist(), word.column("_n").to_pylist(), np.int64)[inv]
            g, _ = group_grams(left, order)
            known = _table(g, Mail(mix(g), buckets).replies(gram.column("_bucket").to_pylist(), gram.column("_n").to_pylist(), np.float32))
            at = 0
            for t, h, docs in got:
                own = c[at : at + len(h)]
                at += len(h)
                n = np.bincount(docs, minlength=t.n) + 1
                p = log10_probabilities(known, t, order)
                out[2].append(n)
                out[3].append(np.bincount(docs, own > 0, t.n).astype(np.int64) + (ends > 0))
                out[5].append(np.bincount(docs, np.log10(own + 1.0), t.n) + log_end - n * log_n)
                out[6].append(p)
                out[7].append(-p * math.log2(10) / np.maximum(np.diff(t.offs), 1))
        cat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        cols = [left.column("_id") if left.num_rows else [], left.column("_held") if left.num_rows else [], cat[2].astype(np.int64), cat[3].astype(np.int64), np.full(len(cat[2]), tokens), *cat[5:]]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, k) for x, k in zip(cols, kinds_, strict=True)], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    both = replies.select(F.lit(False).alias("_gram"), "_grp", "_bucket", "_n").union(told.select(F.lit(True), "_grp", "_bucket", "_n"))
    return by_group.cogroup(both.groupBy("_grp")).applyInArrow(score, schema)
