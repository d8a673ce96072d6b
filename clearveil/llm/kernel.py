"""NumPy kernels on the bytes of many documents at once.

Documents arrive as Arrow string arrays; their UTF-8 buffer is used as it is.  All loops are over
documents or over slices of a few megabytes, never over bytes or words.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; the temporaries take about 40 times this.
SLICE_BYTES = 1 << 20

#: Bytes of a span that are mixed eight at a time; longer spans are hashed whole by ``hashlib``.
LONG_SPAN = 64
_SEED, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_LEFT = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks, beside the executor."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None


class Texts(NamedTuple):
    first: int  # index of the first document in the column
    data: np.ndarray  # uint8
    offs: np.ndarray  # int64, one more than documents

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def slices(column, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column (nulls: empty) into runs of whole documents of about ``most`` bytes."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for chunk in chunks:
        if chunk.null_count:
            chunk = pc.fill_null(chunk, "")
        chunk = chunk.cast(pa.large_binary())
        _, ob, db = chunk.buffers()
        offs = np.frombuffer(ob, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int64)
        data = np.frombuffer(db, np.uint8) if db is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
            j = min(j, len(chunk))
            yield Texts(first + i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            i = j
        first += len(chunk)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))


def word_bounds(t: Texts, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and document of every word."""
    n = len(t.data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[t.data]
    cut = np.zeros(n + 1, bool)
    cut[t.offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    docs = np.searchsorted(t.offs, starts, "right") - 1
    return starts, ends, docs


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes anywhere.

    Eight bytes a step go through a bijection of 64 bits, so there is no polynomial whose roots some
    family of texts could hit.
    """
    n = ends - starts
    h = mix(n.astype(np.uint64) + _SEED)
    if not len(n):
        return h
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(h ^ (eight[starts] & _LEFT[np.minimum(n, 8)]))
    live = np.flatnonzero((n > 8) & (n <= LONG_SPAN))
    for at in range(8, LONG_SPAN, 8):
        if not len(live):
            break
        left = n[live] - at
        h[live] = mix(h[live] * _STEP ^ (eight[starts[live] + at] & _LEFT[np.minimum(left, 8)]))
        live = live[left > 8]
    for i in np.flatnonzero(n > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(t: Texts, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, docs = word_bounds(t, separators)
    return span_hashes(t.data, starts, ends), docs, starts, ends


def _both(first: np.ndarray, then: np.ndarray, salt: np.uint64) -> np.ndarray:
    """One hash for two neighbouring ones; the order counts."""
    return mix(first * salt + then)


def rolling(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of words[i:i+k] for every i that has k words after it, by doubling: pairs, fours, eights
    and so on, put together as the bits of ``k`` say.  ``second`` gives one that is independent."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    salt = U(0xA0761D6478BD642F) if second else U(0xE7037ED1A0B428DB)
    power, size, out, covered = words, 1, None, 0
    while True:
        if k & size:
            part = power[covered : covered + len(words) - k + 1]
            out = part if out is None else _both(out, part, salt + U(2 * k))
            covered += size
        if covered == k:
            return mix(out + salt)
        power, size = _both(power[: len(power) - size], power[size:], salt + U(2 * size)), 2 * size


def one_document(docs: np.ndarray, k: int) -> np.ndarray:
    """Whether words i .. i+k-1 belong to the same document."""
    return docs[k - 1 :] == docs[: len(docs) - k + 1] if len(docs) >= k else np.zeros(0, bool)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Mail:
    """Requests that a group of documents sends to buckets of hashes, and the replies' order.

    ``hashes`` must be distinct.  Bucket and payload come from different bits.
    """

    def __init__(self, hashes: np.ndarray, buckets: int) -> None:
        self.to = ((hashes & U(0xFFFFFFFF)) % U(buckets)).astype(np.int32)
        self.order = np.argsort(self.to, kind="stable")
        self.n = len(hashes)
        at = self.to[self.order]
        self.cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if self.n else np.zeros(1, np.int64)
        self.buckets = at[self.cuts[:-1]] if self.n else at

    def packed(self, values: np.ndarray) -> list[bytes]:
        v = values[self.order]
        return [v[a:b].tobytes() for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def replies(self, buckets: list[int], payloads: list[bytes], kind) -> np.ndarray:
        """Put replies (bits where kind is bool) back to the order of ``hashes``; no reply: zeros."""
        got = dict(zip(buckets, payloads, strict=True))
        out = np.zeros(self.n, kind)
        for b, lo, hi in zip(self.buckets.tolist(), self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            if (p := got.get(b)) is not None:
                out[self.order[lo:hi]] = np.unpackbits(np.frombuffer(p, np.uint8), count=hi - lo) if kind is bool else np.frombuffer(p, kind)
        return out
