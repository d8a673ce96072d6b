"""Near-duplicate classes by DartMinHash signatures and banded joining.

Elements are shingles of five words, weighted by how often the document has them.  Darts fall on
the plane of weight by rank of each element, at places fixed by hashes; those below the element's
weight count, each belongs to one of K coordinates, and the earliest of each coordinate is the
signature: two documents agree in a coordinate with their weighted Jaccard similarity.  One pass
throws only about K log K useful darts for a document, whatever its length.

Equal word sequences are one text from the start.  Texts that share a band of R coordinates are
candidates; every candidate link is checked exactly on the weighted shingle sets.  In each band a
text is first compared with the band's pivot.  Bands whose texts then still lie in different
classes are compared in full across these classes: as pairs where these are few for the size of the
band, else in blocks of texts, of which only the links come out.  So no link between different
classes that share a band is lost, while the members of one class never meet in pairs.
Classes are connected components, found by label
propagation with pointer jumping in DataFrames; nothing about the corpus comes to the driver but
counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, joined, named, written
from .kernel import SLICE_BYTES, U, mix, rolling, slices, trim, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
_LEVELS = 40
#: A band with at most so many pairs across classes a text is compared by pairs, others by blocks.
_FEW = 4
#: Texts in a block.
_BLOCK = 256


def _seed(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x ^ U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def weighted_shingles(words: np.ndarray, docs: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, shingle and count, sorted by document and shingle; a short document is one shingle."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.searchsorted(docs, np.arange(n + 1))
    counts = np.diff(first)
    hashes, owners = [], []
    if len(words) >= size:
        whole = rolling(words, size)
        ok = docs[size - 1 :] == docs[: len(docs) - size + 1]
        hashes.append(whole[ok])
        owners.append(docs[: len(whole)][ok])
    for k in range(1, size):
        own = np.flatnonzero(counts == k)
        if len(own):
            hashes.append(_seed(rolling(words, k)[first[own]], 77 + k))
            owners.append(own)
    h, d = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h)))


def _throw(docs: np.ndarray, cells: np.ndarray, below: np.ndarray, level: int, k: int):
    """Darts of one rank level on unit cells of weight: document, coordinate, rank, name.

    Level 0 spans ranks [0, 1), level l > 0 spans [2**(l-1), 2**l); each unit of area has a Poisson
    number of darts with mean 1.  ``below``: ranks from there on are not needed.
    """
    out = []
    lo, parts = (0, 1) if level == 0 else (2 ** (level - 1), 2 ** (level - 1))
    for part in range(parts):
        cell = _seed(cells, 1 + lo + part)
        number = np.searchsorted(_POISSON, _unit(_seed(cell, 3)), "right")
        at = np.repeat(np.arange(len(cell)), number)
        if not len(at):
            continue
        nth = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
        dart = mix(cell[at] + (nth.astype(np.uint64) + U(1)) * U(0xBF58476D1CE4E5B9))
        rank = lo + part + _unit(_seed(dart, 5))
        ok = rank < below[docs[at]]
        dart = dart[ok]
        out.append((docs[at][ok], (_seed(dart, 7) % U(k)).astype(np.int64), rank[ok], dart))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(float), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(docs: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k names of the earliest darts; rows of documents without elements are zero.

    ``weights`` are positive integers: an element of weight w has w unit cells.
    """
    sig = np.zeros((n, k), np.uint64)
    total = np.bincount(docs, weights, n)
    open_ = total > 0
    enough = (k * math.log(k) + 6 * k) / np.maximum(total, 1)
    at = np.repeat(np.arange(len(docs)), weights)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(weights) - weights, weights)
    owner = docs[at]
    cells = mix(elements[at] + nth.astype(np.uint64) * U(0xD1B54A32D192ED03))
    filled = np.zeros((n, k), bool)
    for level in range(_LEVELS):
        if not open_.any():
            break
        live = open_[owner]
        owner, cells = owner[live], cells[live]
        # long documents need only their smallest ranks; a coordinate left empty is looked for again
        for below in (np.maximum(enough, 0), np.full(n, np.inf)) if level == 0 else (np.full(n, np.inf),):
            sel = open_[owner]
            d, c, r, name = _throw(owner[sel], cells[sel], below, level, k)
            if len(d):
                key = d * k + c
                order = np.lexsort((r, key))
                key = key[order]
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                key, name = key[first], name[order][first]
                new = ~filled.ravel()[key]
                sig.ravel()[key[new]] = name[new]
                filled.ravel()[key[new]] = True
            open_ &= ~filled.all(axis=1)
    return sig


def _signed(batches, bands: int, rows: int, size: int, wanted: pa.Schema):
    trim()
    for batch in batches:
        ids = batch.column(0)
        for t in slices(batch.column(1), SLICE_BYTES):
            words, docs, _, _ = word_hashes(t)
            n_words = np.bincount(docs, minlength=t.n)
            first = np.searchsorted(docs, np.arange(t.n + 1))
            d, h, w = weighted_shingles(words, docs, t.n, size)
            sig = signatures(d, h, w, t.n, bands * rows)
            # of the whole word sequence, by two polynomials
            whole = []
            for second in (False, True):
                sums = np.zeros(len(words) + 1, np.uint64)
                place = (np.arange(len(words)) - first[docs]).astype(np.uint64)
                np.cumsum(mix(words + place * U(0x9E3779B97F4A7C15) + U(second)), out=sums[1:])
                whole.append(mix(sums[first[1:]] - sums[first[:-1]] + n_words.astype(np.uint64)))
            cols = [ids.slice(t.first, t.n), pa.array(n_words, pa.int64()), *[pa.array(x.view(np.int64)) for x in whole]]
            for b in range(bands):
                x = np.full(t.n, U(b + 1))
                for r in range(rows):
                    x = mix(x * U(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
                cols.append(pa.array(x.view(np.int64)))
            yield pa.record_batch(cols, schema=wanted)


def signed(docs: DataFrame, doc_id: str, text: str, *, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """_id, _words, _key1, _key2 and one hash for each band."""
    names = ["_id", "_words", "_key1", "_key2", *[f"_b{i}" for i in range(bands)]]
    wanted = pa.schema([(n, pa.int64()) for n in names])
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lambda it: _signed(it, bands, rows, size, wanted), ", ".join(f"{n} long" for n in names))


def _shingle_rows(batches, size: int):
    trim()
    schema = pa.schema([("_id", pa.int64()), ("_set", pa.binary()), ("_count", pa.binary())])
    for batch in batches:
        for t in slices(batch.column(1), SLICE_BYTES):
            words, docs, _, _ = word_hashes(t)
            d, h, w = weighted_shingles(words, docs, t.n, size)
            first = np.searchsorted(d, np.arange(t.n + 1)).tolist()
            w = w.astype(np.uint32)
            yield pa.record_batch([batch.column(0).slice(t.first, t.n), pa.array([h[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary()), pa.array([w[a:b].tobytes() if (w[a:b] != 1).any() else b"" for a, b in zip(first, first[1:], strict=False)], pa.binary())], schema=schema)


def weighted_jaccard(a: bytes, aw: bytes, b: bytes, bw: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    xw = np.frombuffer(aw, np.uint32).astype(np.int64) if aw else np.ones(len(x), np.int64)
    yw = np.frombuffer(bw, np.uint32).astype(np.int64) if bw else np.ones(len(y), np.int64)
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    common = int(np.minimum(xw[both], yw[at[both]]).sum())
    return common / (int(xw.sum()) + int(yw.sum()) - common)


def _similar(batches, least: float):
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(6)]
        rows = [(x, y) for x, y, a, aw, b, bw in zip(*cols, strict=True) if weighted_jaccard(a, aw, b, bw) >= least]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], schema=schema)


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(x, y) of the pairs (a, b, x, y) of texts whose weighted Jaccard similarity is ``least`` or more.

    Pairs go to the sets where a counted size allows it, so that only sets that are compared move.
    """
    left = joined(sets.select(F.col("_id").alias("a"), F.col("_set").alias("_sa"), F.col("_count").alias("_ca")), pairs, "a", "inner", 64)
    right = joined(sets.select(F.col("_id").alias("b"), F.col("_set").alias("_sb"), F.col("_count").alias("_cb")), pairs.select("a", "b"), "b", "inner", 64)
    both = left.join(right, ["a", "b"]).select("x", "y", "_sa", "_ca", "_sb", "_cb")
    return both.mapInArrow(lambda it: _similar(it, least), "x long, y long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(_id, _class) for every end of an edge: the smallest id reachable.  ``edges`` has x and y.

    Each round takes the smallest label among neighbours and then that label's own label; rounds
    grow with the logarithm of the longest path.  Hot nodes are pre-aggregated before the exchange
    and their joins are split by adaptive execution.
    """
    both = written(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).union(edges.select("y", "x")).distinct(), "edges")
    before = [first := written(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_id"), F.least("a", "_m").alias("_class")), "labels")]
    labels = first.select("_id", "_class")
    while True:
        near = both.join(labels.select(F.col("_id").alias("b"), "_class"), "b").groupBy(F.col("a").alias("_id")).agg(F.min("_class").alias("_near"))
        near = labels.join(near, "_id").select("_id", F.col("_class").alias("_was"), F.least("_class", "_near").alias("_class"))
        jump = labels.select(F.col("_id").alias("_class"), F.col("_class").alias("_next"))
        new = written(near.join(jump, "_class", "left").select("_id", F.least("_class", F.coalesce("_next", "_class")).alias("_class"), "_was"), "labels")
        changed = new.where("_class <> _was").limit(1).count()
        dropped(*before)
        before, labels = [new], new.select("_id", "_class")
        if not changed:
            dropped(both)
            return labels


def _mixed(member: DataFrame, found: DataFrame) -> DataFrame:
    """Texts of bands with several classes: _rep, _band, _class, size of the class in the band, of
    the band, of its small classes, and the number of pairs across classes."""
    named = member.join(found.withColumnRenamed("_id", "_rep"), "_rep", "left").select("_rep", "_band", F.coalesce("_class", "_rep").alias("_class"))
    named = written(named, "named")
    counts = written(named.groupBy("_band", "_class").agg(F.count("*").alias("_of_class")), "sizes")
    n, c = F.sum("_of_class"), F.col("_of_class")
    bands = counts.groupBy("_band").agg(n.alias("_n"), ((n * n - F.sum(c * c)) / 2).alias("_across"), F.sum(F.when(c < _BLOCK // 2, c).otherwise(0)).alias("_small"))
    bands = written(bands.where("_across > 0"), "bands")
    sizes = written(counts.join(bands, "_band"), "sizes")
    left = written(named.join(sizes, ["_band", "_class"]), "left")
    dropped(named, counts, bands, sizes)
    return left


def _all_across(left: DataFrame) -> DataFrame:
    x = left.select(F.col("_rep").alias("_x"), "_band", F.col("_class").alias("_cx"))
    y = left.select(F.col("_rep").alias("_y"), "_band", F.col("_class").alias("_cy"))
    return x.join(y, "_band").where("_cx < _cy").select(F.col("_x").alias("a"), F.col("_y").alias("b"), F.col("_cx").alias("x"), F.col("_cy").alias("y")).distinct()


def _pack(table: pa.Table) -> pa.Table:
    """One row for a block of texts."""
    sets, counts = table.column("_set").to_pylist(), table.column("_count").to_pylist()
    cells = []
    for h, w in zip(sets, counts, strict=True):
        x = np.frombuffer(h, np.uint64)
        if w:  # the n-th of equal shingles is an element of its own
            n = np.frombuffer(w, np.uint32).astype(np.int64)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x = mix(np.repeat(x, n) + nth.astype(np.uint64) * U(0xD1B54A32D192ED03))
        else:
            x = mix(x)
        cells.append(x)
    lens = np.array([len(x) for x in cells], np.int64)
    one = [table.column(c)[0].as_py() for c in ("_band", "_chunk", "_pure")]
    packed = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("_rep", "_class")]
    row = [*one, *packed, lens.tobytes(), np.concatenate(cells).tobytes()]
    return pa.table([pa.array([v], t) for v, t in zip(row, [*[pa.int64()] * 3, *[pa.binary()] * 4], strict=True)], names=_PACKED)


_PACKED = ["_band", "_chunk", "_pure", "_reps", "_classes", "_lens", "_cells"]


def _block_links(x: list[bytes], y: list[bytes], least: float) -> list[tuple[int, int]]:
    """Pairs of classes with a link between two blocks, by one exact matrix product of memberships."""
    ids_x, cls_x, len_x, ids_y, cls_y, len_y = (np.frombuffer(v, np.int64) for v in (*x[:3], *y[:3]))
    cx, cy = np.frombuffer(x[3], np.uint64), np.frombuffer(y[3], np.uint64)
    shared = np.intersect1d(cx, cy)
    common = np.zeros((len(ids_x), len(ids_y)), np.float32)
    if len(shared):
        at = []
        for c, n in ((cx, len_x), (cy, len_y)):
            place = np.minimum(np.searchsorted(shared, c), len(shared) - 1)
            ok = shared[place] == c
            at.append((np.repeat(np.arange(len(n)), n)[ok], place[ok], len(n)))
        for lo in range(0, len(shared), 4096):
            m = []
            for row, col, n in at:
                sel = (col >= lo) & (col < lo + 4096)
                dense = np.zeros((n, min(4096, len(shared) - lo)), np.float32)
                dense[row[sel], col[sel] - lo] = 1
                m.append(dense)
            common += m[0] @ m[1].T
    alike = (common >= least * (len_x[:, None] + len_y[None, :] - common) - 1e-3) & (cls_x[:, None] != cls_y[None, :])
    i, j = np.nonzero(alike)
    ok = common[i, j].astype(np.float64) / (len_x[i] + len_y[j] - common[i, j].astype(np.float64)) >= least
    i, j = i[ok], j[ok]
    return sorted(set(zip(cls_x[i].tolist(), cls_y[j].tolist(), strict=True)))


def _compare_blocks(batches, least: float):
    trim()
    for batch in batches:
        rows = [r for v in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True) for r in _block_links(v[:4], v[4:], least)]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["x", "y"])


def _by_blocks(left: DataFrame, sets: DataFrame, least: float) -> tuple[list[DataFrame], DataFrame]:
    """The written blocks, and the links of all pairs across classes of each band, compared in blocks
    of about _BLOCK texts: what is exchanged is blocks, what comes out is links.  Blocks of one and
    the same class don't meet."""
    big = F.col("_of_class") >= _BLOCK // 2
    part = F.pmod(F.xxhash64("_rep"), F.ceil(F.when(big, F.col("_of_class")).otherwise(F.col("_small")) / _BLOCK).cast("long"))
    dealt = left.select("_rep", "_band", "_class", F.xxhash64(F.when(big, F.col("_class")), part).alias("_chunk"), F.when(big, F.col("_class")).alias("_pure"))
    kinds = "_band long, _chunk long, _pure long, _reps binary, _classes binary, _lens binary, _cells binary"
    packed = written(dealt.join(sets.withColumnRenamed("_id", "_rep"), "_rep").groupBy("_band", "_chunk").applyInArrow(_pack, kinds), "blocks")
    x = packed.select("_band", *[F.col(c).alias(f"x{c}") for c in _PACKED[1:]])
    y = packed.select("_band", *[F.col(c).alias(f"y{c}") for c in _PACKED[1:]])
    met = x.join(y, "_band").where("x_chunk <= y_chunk and (x_pure is null or y_pure is null or x_pure <> y_pure)")
    met = met.select(*[f"{s}{c}" for s in "xy" for c in _PACKED[3:]])
    met = met.repartition(F.expr("xxhash64(x_reps, y_reps)"))
    return [packed], met.mapInArrow(lambda it: _compare_blocks(it, least), "x long, y long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each document row: ``doc_id``, ``class_id``, ``n_words``, ``is_kept``.

    ``class_id`` is the smallest id of the class, ``is_kept`` marks the row of that id.  Words are
    separated by white space; texts of fewer than ``size`` words are one shingle of all their words.
    Null, empty and blank texts have no shingle and are classes of their own.  Rows with the same
    id are one document in the result's classes; of those only rows of the class's smallest id are
    kept.  A null id is its own class (null).  Other columns are not read.
    """
    sigs = written(signed(docs, doc_id, text, bands=bands, rows=rows, size=size), "signatures")
    real = sigs.where("_words > 0 and _id is not null")
    firsts = [F.first(f"_b{i}").alias(f"_b{i}") for i in range(bands)]
    reps = written(real.groupBy("_key1", "_key2").agg(F.min("_id").alias("_rep"), *firsts), "representatives")
    banded = reps.select("_rep", F.explode(F.array(*[F.col(f"_b{i}") for i in range(bands)])).alias("_band"))
    # buckets of two different texts or more
    shared = written(banded.groupBy("_band").agg(F.min("_rep").alias("_pivot"), F.max("_rep").alias("_last")).where("_pivot <> _last").select("_band", "_pivot"), "buckets")
    members = written(banded.join(shared, "_band").select("_rep", "_band", "_pivot"), "members")
    pairs = members.where("_rep <> _pivot").select(F.col("_pivot").alias("a"), F.col("_rep").alias("b"), F.col("_pivot").alias("x"), F.col("_rep").alias("y"))
    pairs = written(pairs.distinct(), "pairs")
    member = members.select("_rep", "_band")
    wanted = written(member.select(F.col("_rep").alias("_id")).distinct(), "wanted")
    texts = joined(docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")), wanted, "_id", "inner", 64)
    sets = texts.mapInArrow(lambda it: _shingle_rows(it, size), "_id long, _set binary, _count binary")
    if real.groupBy("_id").count().where("count > 1").limit(1).count():
        sets = sets.groupBy("_id").agg(F.min(F.struct("_set", "_count")).alias("s")).select("_id", "s._set", "s._count")
    sets = written(sets, "shingles")
    first_links = written(_checked(pairs, sets, similarity), "links")
    found = components(first_links)
    left = _mixed(member, found)
    dropped(shared, members, wanted, first_links)
    # few pairs across classes for the band's size: compared as pairs; else in blocks
    few = left.where(f"_across <= {_FEW} * _n")
    more = written(_all_across(few).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    links = _checked(more, sets, similarity)
    many, blocks = left.where(f"_across > {_FEW} * _n"), []
    if many.limit(1).count():
        blocks, between = _by_blocks(many, sets, similarity)
        links = links.unionByName(between)
    links = written(links, "links")
    dropped(left, pairs, more, sets, *blocks)
    if links.limit(1).count():  # between classes, which are joined in turn
        wider = components(links).select(F.col("_id").alias("_class"), F.col("_class").alias("_wider"))
        all_ = found.select("_id", "_class").union(wider.select("_class", "_class").join(found.select("_id"), F.col("_class") == F.col("_id"), "left_anti"))
        found = written(all_.join(wider, "_class", "left").select("_id", F.coalesce("_wider", "_class").alias("_class")), "classes")

    classes = written(joined(reps.select("_key1", "_key2", F.col("_rep").alias("_id")), found, "_id", "left", 64).select("_key1", "_key2", F.coalesce("_class", "_id").alias("_class")), "classes")
    dropped(reps, links, found)
    out = sigs.select("_id", "_words", F.when(F.col("_words") > 0, F.col("_key1")).alias("_key1"), "_key2").join(classes, ["_key1", "_key2"], "left")
    cls = F.coalesce("_class", "_id")
    return out.select(F.col("_id").alias("doc_id"), cls.alias("class_id"), F.col("_words").alias("n_words"), F.coalesce(F.col("_id") == cls, F.lit(True)).alias("is_kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of each class's smallest id; of repeated rows one."""
    found = near_duplicates(docs, doc_id, text).select("doc_id", "is_kept", "class_id")
    kept = written(found.where("is_kept and doc_id is not null").groupBy("doc_id").count(), "kept")
    out = joined(docs, kept.select(F.col("doc_id").alias(doc_id)), doc_id, "left_semi", 64).select(*map(named, docs.columns))
    if kept.where("count > 1").limit(1).count():
        out = out.dropDuplicates([doc_id])
    return out.unionByName(docs.where(F.col(doc_id).isNull()))
