"""Removal of repeated passages by fixed-block anchors.

Every document is cut into non-overlapping blocks of B words, which are the index; every rolling
window of B words of every document probes it.  With windows of W words and B = (W + 1) // 2, a
repeated window holds a whole block of the document it repeats.  Around hits the windows of W words
are compared by two independent hashes, 128 bits in all, and the covered words form maximal repeats.

Distribution.  Documents go to groups of about 4 MB by a hash of the row (one exchange, used by all
passes).  A group asks only once for each of its distinct hashes, so a window that fills a third of
the corpus costs one entry a group; hashes are dealt to buckets, where one task sees each hash's
entries and answers with one bit each.  Nothing is sampled, capped or sent to the driver, and no
pairs of documents are formed.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_count, in_groups, named
from .kernel import SLICE_BYTES, Mail, Texts, U, one_document, rolling, slices, trim, word_hashes

WINDOW = 13
REQUEST = "_kind int, _bucket int, _grp int, _hash binary, _ids binary"
REPLY = "_grp int, _kind int, _bucket int, _bits binary"
_REQUEST = pa.schema([("_kind", pa.int32()), ("_bucket", pa.int32()), ("_grp", pa.int32()), ("_hash", pa.binary()), ("_ids", pa.binary())])
_REPLY = pa.schema([("_grp", pa.int32()), ("_kind", pa.int32()), ("_bucket", pa.int32()), ("_bits", pa.binary())])
_NO_ID = np.iinfo(np.int64).max


class _Slice:
    """Hashes of one slice of a group's documents."""

    def __init__(self, t: Texts, ids: np.ndarray, window: int, block: int) -> None:
        self.t = t
        self.words, self.docs, _, _ = word_hashes(t)
        self.ids = ids[t.first : t.first + t.n]
        n = len(self.words)
        self.first = np.searchsorted(self.docs, np.arange(t.n + 1))
        small = rolling(self.words, block)
        ok = one_document(self.docs, block) & (self.ids[self.docs[: len(small)]] != _NO_ID)
        self.at = np.flatnonzero(ok)
        self.block_hash = small[self.at]
        self.aligned = (self.at - self.first[self.docs[self.at]]) % block == 0
        self.n, self.window, self.block = n, window, block

    def candidates(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and two hashes of the windows with a block that the index repeats."""
        w, b = self.window, self.block
        if self.n < w:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        marks = np.zeros(self.n + 1, np.int64)
        marks[self.at[hit] + 1] = 1
        sums = np.cumsum(marks)
        starts = np.arange(self.n - w + 1)
        ok = one_document(self.docs, w) & (sums[starts + w - b + 1] > sums[starts])
        starts = starts[ok]
        return starts, rolling(self.words, w)[starts], rolling(self.words, w, second=True)[starts]


def _read(table: pa.Table, window: int, block: int) -> list[_Slice]:
    ids = table.column("_id").fill_null(_NO_ID).to_numpy().astype(np.int64)
    return [_Slice(t, ids, window, block) for t in slices(table.column("_text"), SLICE_BYTES)]


def _unique(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_ = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return np.unique(all_, return_inverse=True)


def _block_request(got: list[_Slice], buckets: int) -> tuple[Mail, np.ndarray, np.ndarray]:
    u, inv = _unique([s.block_hash for s in got])
    mail = Mail(u, buckets)
    aligned = np.bincount(inv, np.concatenate([s.aligned for s in got]) if got else None, len(u)) > 0 if len(u) else np.zeros(0, bool)
    twice = np.bincount(inv, minlength=len(u)) > 1
    return mail, inv, ((u >> U(32)).astype(np.uint32) & np.uint32(0xFFFFFFFC)) | (aligned.astype(np.uint32) << 1) | twice


def _window_request(got: list[_Slice], hits: np.ndarray, buckets: int):
    """The group's distinct candidate windows (first hash, second hash, smallest document), each
    candidate's window and document, and the starts by slice."""
    starts, first, second, owners, at = [], [], [], [], 0
    for s in got:
        a, x, y = s.candidates(hits[at : at + len(s.at)])
        at += len(s.at)
        starts.append(a)
        first.append(x)
        second.append(y)
        owners.append(s.ids[s.docs[a]])
    none = np.zeros(0, np.uint64)
    x, y = (np.concatenate(v) if v else none for v in (first, second))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.lexsort((owner, y, x))
    new = np.ones(len(order), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    inv = np.empty(len(order), np.int64)
    inv[order] = np.cumsum(new) - 1
    least = order[new]
    return Mail(x[least], buckets), x[least], y[least], owner[least], inv, owner, starts


def _sent(kind: int, grp: int, mail: Mail, hashes: list[bytes], ids: list[bytes | None]) -> pa.Table:
    n = len(hashes)
    return pa.table([pa.array([kind] * n, pa.int32()), pa.array(mail.buckets.tolist(), pa.int32()), pa.array([grp] * n, pa.int32()), pa.array(hashes, pa.binary()), pa.array(ids, pa.binary())], schema=_REQUEST)


def _replied(table: pa.Table, kind: int) -> tuple[list[int], list[bytes]]:
    t = table.filter(pa.compute.equal(table.column("_kind"), kind))
    return t.column("_bucket").to_pylist(), t.column("_bits").to_pylist()


def _answers(table: pa.Table, kind: int, decide) -> pa.Table:
    """One bit for each requested hash; requests without a set bit get no reply."""
    table = table.combine_chunks()
    hashes = table.column("_hash").to_pylist()
    kinds = np.uint32 if kind == 0 else np.uint64
    sizes = [len(h) // np.dtype(kinds).itemsize for h in hashes]
    ids = np.frombuffer(b"".join(x or b"" for x in table.column("_ids").to_pylist()), np.int64)
    bits = decide(np.frombuffer(b"".join(hashes), kinds), ids)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    rows = [(g, b, np.packbits(x).tobytes()) for g, b, lo, hi in zip(table.column("_grp").to_pylist(), table.column("_bucket").to_pylist(), cuts[:-1], cuts[1:], strict=True) if (x := bits[lo:hi]).any()]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=_REPLY)


def _repeated_block(keys: np.ndarray, _: np.ndarray) -> np.ndarray:
    """Held by the index, and read at two places at least."""
    u, inv = np.unique(keys >> np.uint32(2), return_inverse=True)
    seen = np.bincount(inv, (keys & np.uint32(1)) + 1, len(u))
    indexed = np.bincount(inv, (keys >> np.uint32(1)) & np.uint32(1), len(u))
    return ((seen > 1) & (indexed > 0))[inv]


def _earlier_elsewhere(keys: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Whether another group has the window in a smaller document; ``told``: ids and second hashes by turns."""
    ids, second = told[::2], told[1::2]
    order = np.lexsort((ids, second, keys))
    k, l = keys[order], second[order]
    start = np.ones(len(k), bool)
    start[1:] = (k[1:] != k[:-1]) | (l[1:] != l[:-1])
    least = ids[order][start][np.cumsum(start) - 1]
    out = np.empty(len(k), bool)
    out[order] = least < ids[order]
    return out


def mark_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, window: int = WINDOW, keep: tuple[str, ...] = (), kept_text: bool = False) -> DataFrame:
    """Words covered by a window that also starts in a document with a smaller id are removed.

    Returns for each row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, with ``kept_text``
    the remaining words joined by one space (the text itself where nothing was removed), and the
    columns named in ``keep`` as fields of one struct, ``kept``, so that no name clashes.  A null text has no words.  A null id neither gives nor loses
    words.  Rows with equal ids are the same document to each other.  Texts shorter than the window
    are never changed.  Other columns of ``docs`` are not read, so their names cannot clash.
    """
    block = (window + 1) // 2
    groups = group_count(docs, text)
    buckets = max(64, groups // 2)
    extra = [named(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    base = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), *extra)
    corpus = in_groups(base, groups, "_id", "_text", *[f"_keep{i}" for i in range(len(keep))])

    def ask_blocks(table: pa.Table) -> pa.Table:
        trim()
        grp = table.column("_grp")[0].as_py()
        mail, _, keys = _block_request(_read(table, window, block), buckets)
        return _sent(0, grp, mail, mail.packed(keys), [None] * len(mail.buckets))

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        if not left.num_rows:
            return _REQUEST.empty_table()
        grp = left.column("_grp")[0].as_py()
        got = _read(left, window, block)
        mail, inv, _ = _block_request(got, buckets)
        hits = mail.replies(*_replied(right, 0), bool)[inv]
        mail, x, y, least, _, _, _ = _window_request(got, hits, buckets)
        return _sent(1, grp, mail, mail.packed(x), mail.packed(np.stack([least, y.view(np.int64)], axis=1)))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if kept_text else "")
    kinds = [(f.name, f.dataType.simpleString()) for f in corpus.schema.fields if f.name.startswith("_keep")]
    schema += "".join(f", {n} {k}" for n, k in kinds)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        got = _read(left, window, block) if left.num_rows else []
        mail, inv, _ = _block_request(got, buckets)
        hits = mail.replies(*_replied(right, 0), bool)[inv]
        mail, _, _, least, inv, owner, starts = _window_request(got, hits, buckets)
        gone = mail.replies(*_replied(right, 1), bool)[inv] | (owner > least[inv])
        n_words, n_removed, digest, texts, at = [], [], [], [], 0
        for s, a in zip(got, starts, strict=True):
            cover = np.zeros(s.n + 1, np.int64)
            a_gone = a[gone[at : at + len(a)]]
            at += len(a)
            np.add.at(cover, a_gone, 1)
            np.add.at(cover, a_gone + window, -1)
            covered = np.cumsum(cover)[:-1] > 0
            for i in range(s.t.n):
                lo, hi = s.first[i], s.first[i + 1]
                lost = covered[lo:hi]
                k = int(lost.sum())
                raw = s.t.raw(i)
                words = raw.split()
                kept = b" ".join(compress(words, (~lost).tolist()) if k else words)
                n_words.append(int(hi - lo))
                n_removed.append(k)
                digest.append(hashlib.sha256(kept).hexdigest())
                if kept_text:
                    texts.append((kept if k else raw).decode())
        out = [left.column("_id") if left.num_rows else pa.array([], pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if kept_text:
            null = left.column("_text").is_null().to_pylist()
            out.append(pa.array([None if z else x for x, z in zip(texts, null, strict=True)], pa.string()))
            names.append("kept_text")
        return pa.table([*out, *[left.column(n) for n, _ in kinds]], names=[*names, *[n for n, _ in kinds]])

    def answer(kind: int, decide):
        return lambda table: _answers(table, kind, decide)

    by_group = corpus.groupBy("_grp")
    blocks = by_group.applyInArrow(ask_blocks, REQUEST).groupBy("_bucket").applyInArrow(answer(0, _repeated_block), REPLY)
    windows = by_group.cogroup(blocks.groupBy("_grp")).applyInArrow(ask_windows, REQUEST).groupBy("_bucket").applyInArrow(answer(1, _earlier_elsewhere), REPLY)
    result = by_group.cogroup(blocks.unionByName(windows).groupBy("_grp")).applyInArrow(remove, schema)
    if not keep:
        return result
    own = [f.split()[0] for f in schema.split(", ")[: 5 if kept_text else 4]]
    return result.select(*own, F.struct(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)]).alias("kept"))
