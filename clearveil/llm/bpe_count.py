"""Token counts by heap-and-linked-list byte-pair merging.

The lowest-ranked adjacent pair is popped from a heap and merged in a linked list until no pair has
a rank; the count is initial symbols minus merges, and no identifier is ever looked up.  Merges
never cross white space, so the counts of white-space-free runs are remembered within a worker (a
bounded number of them).
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
#: Remembered runs in a worker; the memory starts anew beyond that.
REMEMBERED = 600_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Counter(dict):
    """Counts of white-space-free runs, by the rules of a tokenizer file with word ends."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.end = model.get("end_of_word_suffix") or ""
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], regex.V1)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.symbols = byte_symbols()
        self.vocabulary = model["vocab"]
        self.pieces: dict[str, int] = {}
        self.remembered = remembered

    def merged(self, piece: str) -> int:
        """Tokens of one piece."""
        sym = [self.symbols[b] for b in piece.encode()]
        sym[-1] += self.end
        n = len(sym)
        if n == 1:
            return 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one side has been merged meanwhile
            sym[i], sym[j] = a + b, ""
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            if (h := before[i]) >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return count

    def __missing__(self, run: str) -> int:
        s = unicodedata.normalize("NFC", run)
        # letter by letter: a final sigma is no special case
        s = "".join(c.lower() for c in s) if "Σ" in s else s.lower()
        total = 0
        for piece in self.pattern.findall(s):
            n = self.pieces.get(piece)
            if n is None:
                n = self.merged(piece)
                if len(piece) <= 40:
                    self.pieces[piece] = n
            total += n
        if len(run) <= 60:
            self[run] = total
        return total

    def count(self, text: str) -> int:
        if len(self) > self.remembered or len(self.pieces) > self.remembered:
            self.clear()
            self.pieces.clear()
        parts, total = [text], 0
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            # str.split() also parts at U+001C to U+001F, which are no white space to the tokenizer
            runs = regex.split(r"[\t-\r\x85\p{Z}]+", part) if _ODD.search(part) else part.split()
            total += sum(map(self.__getitem__, runs))
        return total


_ODD = regex.compile("[\x1c-\x1f]")
_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for every row; a null text is empty.

    ``tokenizer`` is the file's path, the same on every machine.  One pass without an exchange; rows
    do not influence each other, so repeated rows, null ids and other columns need no rule.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        count = counter(tokenizer).count
        for batch in batches:
            n = np.array([count(x) if x else 0 for x in batch.column(1).to_pylist()], np.int64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], schema=schema)

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).cast("long"), F.col(text), size).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
