"""Best-fit packing by a linear grouping scheme.

Documents become pieces of at most CAPACITY tokens.  The plan is made from the exact histogram of
piece lengths, at most CAPACITY numbers whatever the corpus:

1. large lengths (over a share of CAPACITY) are cut, in falling order, into groups of equal cardinality
   and rounded up to the largest of their group;
2. configurations of these few sizes are optimised by column generation (a knapsack prices each
   new configuration), and the whole parts of the solution are taken;
3. the actual lengths replace the rounded ones, slot by slot in falling order;
4. everything else, the small ones last, goes by best fit into the room that is left; sequences
   that rounding has left with room are opened and go through this step once more.

The steps are done for each share of LARGE_OVERS, and the plan with the fewest sequences is kept.
All steps work on runs of equal sequences, so their work does not grow with the corpus.  A
piece then finds its place from its rank among pieces of its length; ranks come from counts by
length and salt, so a length that a third of all pieces have is not one task's work.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, written
from .kernel import trim

CAPACITY = 2048
GROUPS = 64
#: Shares of the capacity beyond which a length is large: each gives a plan, and the best is taken.
#: From a half on each configuration has one large piece; with less, several large lengths share one.
LARGE_OVER = 1 / 2
LARGE_OVERS = (LARGE_OVER, 1 / 3, 1 / 4, 1 / 6)
#: Sequences with more room than this share of the capacity are opened again after step 4.
OPEN_OVER = 1 / 1024


def _ranked(path: str):
    """Ids of one piece by ranks, or None if the file's ids are not in the order of its merges."""
    import tiktoken

    from .bpe_count import byte_symbols

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary = spec["model"]["vocab"]
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or (merged and merged[0] < 256):
        return None
    byte = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {b"".join(byte[c] for c in w): i for w, i in vocabulary.items() if w not in special}
    return tiktoken.Encoding("file", pat_str=r" ?\p{L}+|[^\p{L}]", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder(dict):
    """Token ids of whole texts as the file's own library gives them.

    Its pieces never run across a space between two other characters that are no white space, so each
    stretch of text from one such space up to the next is encoded once, and its ids (as bytes) are
    remembered: a bounded number of short stretches, of which those not met again for as long are forgotten.
    Letters of a short stretch are one piece; its merges are done by the faster library, by the same
    file's ranks, where these are the order of the file's merges.
    """

    REMEMBERED, SHORT = 400_000, 40

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        self.piece = _ranked(path)
        self.before: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.feed = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str, lead: str) -> bytes:
        """Ids of a stretch without white space after ``lead``: letters and the marks behind them are two pieces."""
        m = _WORD.fullmatch(word) if self.piece is not None and len(word) <= self.SHORT else None
        if m is None:
            return self._ids(lead + word)
        ids = np.array(self.piece(lead + m[1]), "<u4").tobytes()
        if m[2]:
            if m[2] not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                self.marks[m[2]] = self._ids(m[2])
            ids += self.marks[m[2]]
        return ids

    def __missing__(self, stretch: str) -> bytes:
        ids = self.before.pop(stretch, None)
        if ids is None and "\n" in stretch and _LINES.fullmatch(stretch):
            # one line feed between two words is a piece, and so is what stands behind it
            first, *rest = stretch.split("\n")
            return self[first] + b"".join([self.feed + self._word(x, "") for x in rest])
        if ids is None:
            ids = self._word(stretch, " ")
        if len(stretch) <= self.SHORT:
            if len(self) >= self.REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[stretch] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        if "\0" in text:  # the mark below
            return np.frombuffer(self._ids(text), "<u4")
        stretches = _WIDE.sub("\0", text).split("\0") if _RUN.search(text) else text.split(" ")
        return np.frombuffer((self._ids(stretches[0]) if stretches[0] else b"") + b"".join(map(self.__getitem__, stretches[1:])), "<u4")


#: White space next to white space, where a space need not begin a piece; and the spaces that do.
_RUN = re.compile(r"\s\s")
_WIDE = re.compile(r"(?<=\S) (?=\S)")
#: Letters in every version of Unicode, and marks of ASCII but the apostrophe behind them.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-^`{-~]*)")
_LINES = re.compile(r"\S+(?:\n\S+)+")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones at the end, the first may be shorter."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(a, capacity) for a in range(head, n, capacity)]


class Run(NamedTuple):
    """``count`` equal sequences; each content is (length, copies in a sequence, first rank)."""

    count: int
    room: int
    content: tuple[tuple[int, int, int], ...]

    def split(self, at: int) -> tuple[Run, Run]:
        rest = tuple((n, k, rank + at * k) for n, k, rank in self.content)
        return self._replace(count=at), Run(self.count - at, self.room, rest)

    def add(self, length: int, copies: int, rank: int) -> Run:
        return Run(self.count, self.room - length * copies, (*self.content, (length, copies, rank)))


class _Rooms:
    """Runs by the room they have left."""

    def __init__(self) -> None:
        self.by: dict[int, list[Run]] = {}
        self.keys: list[int] = []

    def put(self, run: Run) -> None:
        if run.count:
            if run.room not in self.by:
                bisect.insort(self.keys, run.room)
                self.by[run.room] = []
            self.by[run.room].append(run)

    def take(self, least: int) -> Run | None:
        """A run of the smallest room that is enough."""
        i = bisect.bisect_left(self.keys, least)
        if i == len(self.keys):
            return None
        room = self.keys[i]
        run = self.by[room].pop()
        if not self.by[room]:
            del self.by[room], self.keys[i]
        return run

    def all(self) -> list[Run]:
        return [r for k in self.keys for r in self.by[k]]


def best_fit(rooms: _Rooms, lengths: list[list[int]], capacity: int) -> None:
    """Put [length, count, first rank] into rooms, longest first, each into the least room that holds it."""
    for length, count, rank in sorted(lengths, reverse=True):
        while count:
            run = rooms.take(length)
            if run is None:
                k = capacity // length
                whole = count // k
                if whole:
                    rooms.put(Run(whole, capacity, ()).add(length, k, rank))
                    rank += whole * k
                    count -= whole * k
                if count:
                    rooms.put(Run(1, capacity, ()).add(length, count, rank))
                    count = 0
                continue
            k = run.room // length
            whole = min(run.count, count // k)
            if whole:
                run, rest = run.split(whole) if whole < run.count else (run, None)
                rooms.put(run.add(length, k, rank))
                rank += whole * k
                count -= whole * k
            else:
                rest = run
            if count and rest is not None:  # fewer than k are left
                one, rest = rest.split(1) if rest.count > 1 else (rest, None)
                rooms.put(one.add(length, count, rank))
                count = 0
            if rest is not None:
                rooms.put(rest)


def grouped(lengths: list[list[int]], groups: int) -> list[list[list[int]]]:
    """Groups of equal cardinality in falling order of length; one for each length if these are not more."""
    if len(lengths) <= groups:
        return [[x] for x in sorted(lengths, reverse=True)]
    total = sum(c for _, c, _ in lengths)
    size, out, room = max(1, -(-total // groups)), [], 0
    for length, count, rank in sorted(lengths, reverse=True):
        while count:
            if not room:
                out.append([])
                room = size
            n = min(room, count)
            out[-1].append([length, n, rank])
            rank, count, room = rank + n, count - n, room - n
    return out


def _best_configuration(sizes: np.ndarray, value: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of most value, by an unbounded knapsack over the capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    by_size, by_value = sizes[order], value[order]
    for c in range(int(by_size[0]), capacity + 1):
        n = np.searchsorted(by_size, c, "right")
        got = best[c - by_size[:n]] + by_value[:n]
        i = int(np.argmax(got))
        if got[i] > best[c - 1]:
            best[c], last[c] = got[i], order[i]
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
            continue
        out[last[c]] += 1
        c -= sizes[last[c]]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, rounded down: the cutting-stock relaxation by
    column generation on a basis of as many configurations as sizes."""
    n = len(sizes)
    if not n:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    used = demand / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        new = _best_configuration(sizes, np.maximum(price, 0), demand, capacity)
        if new @ price <= 1 + 1e-7:
            break
        way = inverse @ new
        rising = way > 1e-9
        ratio = np.full(n, np.inf)
        ratio[rising] = np.maximum(used[rising], 0) / way[rising]
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        used = used - ratio[out] * way
        used[out] = ratio[out]
        basis[:, out] = new
    return [(basis[:, i].astype(int), int(used[i] + 1e-6)) for i in range(n) if used[i] >= 1 - 1e-6]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_over: float = LARGE_OVER) -> list[Run]:
    """Runs of sequences that hold ``histogram[length]`` pieces of each length, ranks from 0."""
    rooms = _Rooms()
    lengths = [[n, c, 0] for n, c in histogram.items() if c]
    done = [Run(c, 0, ((n, 1, 0),)) for n, c, _ in lengths if n == capacity]
    lengths = [x for x in lengths if x[0] < capacity]
    large = [x for x in lengths if x[0] > large_over * capacity]
    rest = [x for x in lengths if x[0] <= large_over * capacity]
    waiting = grouped(large, groups)
    # groups that round to the same length are one size
    merged: dict[int, list[list[int]]] = {}
    for g in waiting:
        merged.setdefault(g[0][0], []).extend(g)
    sizes = np.array(sorted(merged, reverse=True), int)
    demand = np.array([sum(c for _, c, _ in merged[s]) for s in sizes], float)
    queues = [merged[s][::-1] for s in sizes]

    def draw(i: int, n: int) -> list[list[int]]:
        out = []
        while n and queues[i]:
            length, count, rank = queues[i].pop()
            k = min(n, count)
            out.append([length, k, rank])
            n -= k
            if k < count:
                queues[i].append([length, count - k, rank + k])
        return out

    for slots, times in configurations(sizes, demand, capacity):
        times = min([times, *[sum(c for _, c, _ in queues[i]) // int(k) for i, k in enumerate(slots) if k]])
        runs = [Run(times, capacity, ())] if times else []
        for i, k in enumerate(slots):
            for _ in range(int(k)):
                filled, pending = [], runs[::-1]
                for length, n, rank in draw(i, times):
                    while n:
                        run = pending.pop()
                        if run.count > n:
                            run, later = run.split(n)
                            pending.append(later)
                        filled.append(run.add(length, 1, rank))
                        rank, n = rank + run.count, n - run.count
                runs = filled
        for r in runs:
            rooms.put(r)
    best_fit(rooms, [x for q in queues for x in q] + rest, capacity)
    # what rounding has left open is opened again and goes by best fit, if that saves sequences
    first = rooms.all()
    kept = [r for r in first if r.room <= OPEN_OVER * capacity]
    loose = [[n, k * r.count, rank] for r in first if r.room > OPEN_OVER * capacity for n, k, rank in r.content]
    again = _Rooms()
    best_fit(again, loose, capacity)
    second = kept + again.all()
    return done + min(first, second, key=lambda runs: sum(r.count for r in runs))


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """The plan with the fewest sequences over all of LARGE_OVERS; none is tried after one that no plan can beat."""
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best: list[Run] | None = None
    for over in LARGE_OVERS:
        runs = plan(histogram, capacity, groups, over)
        if best is None or sum(r.count for r in runs) < sum(r.count for r in best):
            best = runs
        if sum(r.count for r in best) <= least:
            break
    return best


def pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every document's tokens and one ``end_id``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *[(n, pa.int64()) for n in names[2:]]])

    def run(batches):
        trim()
        ids = encoder(tokenizer).ids
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                all_ = np.append(ids(x or ""), end).astype("<u4")
                rows += [(doc, i, a, n, zlib.crc32(all_[a : a + n].tobytes())) for i, (a, n) in enumerate(cut(len(all_), capacity))]
            yield pa.record_batch([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(5)], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Places(NamedTuple):
    key: np.ndarray  # length * 2**40 + first rank, rising
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def places(runs: list[Run]) -> _Places:
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length, copies, rank in run.content:
            rows.append(((length << 40) + rank, copies, sequence, offset))
            offset += length * copies
        sequence += run.count
    rows.sort()
    return _Places(*(np.array([r[i] for r in rows], np.int64) for i in range(4)))


def packed(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; sequences are gapless from offset 0.

    A null text is empty: one piece of the end token.  Repeated rows and null ids are pieces like
    any other.  Other columns are not read.  An empty table has no sequence.
    """
    spark = docs.sparkSession
    cut_ = written(pieces(docs, tokenizer, doc_id=doc_id, text=text, capacity=capacity), "pieces")
    salts = max(8, shuffle_partitions(spark))
    salted = cut_.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = written(salted.groupBy("length", "_salt").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(best_plan(histogram, capacity, groups)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    ranked = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(first, ["length", "_salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_nth") - 1).alias("_rank"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *[(n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")]])

    def run(batches):
        trim()
        p = where.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            key = (length.astype(np.int64) << 40) + rank
            at = np.searchsorted(p.key, key, "right") - 1
            nth = key - p.key[at]
            sequence = p.sequence[at] + nth // p.copies[at]
            offset = p.offset[at] + nth % p.copies[at] * length
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
