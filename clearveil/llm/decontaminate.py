"""Benchmark decontamination by winnowing, in DataFrame operations only.

The smallest k-gram hash of every window of w = t - k + 1 consecutive k-grams is kept as a
fingerprint, so any span of t words that a document shares with an item has a fingerprint at the
same place in both.  Fingerprints of documents are joined with those of items; around each hit the
windows of t words are compared as text, and their union is what is hit.  Items of fewer than t
words are one window of their own length each; documents are probed with windows of just those
lengths (at most t - 1 of them).

The document side is never exchanged for the fingerprint join while the item side fits a broadcast
whose size is counted first; beyond that it is an ordinary equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, named, written

SPAN = 10
GRAM = 4
#: Everything up to / is a separator, then those between digits, letters and the byte 0x7F.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column computed once: the optimiser does not merge it into the lambdas that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _all_grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("_w") - F.lit(n - 1)), lambda i: F.struct(F.xxhash64(F.slice("_w", i, n)).alias("_fp"), i.alias("_pos")))


def _fingerprints(words: DataFrame, key: str, span: int, gram: int) -> DataFrame:
    """(key, fp, pos): a fingerprint holds 32 bits of the hash above the place, right-most first."""
    n = F.size("_w")
    places = F.when(n >= span, F.sequence(F.lit(1), n - F.lit(gram - 1)))
    grams = F.transform(places, lambda i: F.xxhash64(F.slice("_w", i, gram)).bitwiseAND(F.lit(-4294967296)) + (F.lit(4294967295) - i.cast("long")))
    hashed = _bound(words.where(n >= span), "_g", grams)
    wide = span - gram + 1
    least = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_g") - F.lit(wide - 1)), lambda i: F.array_min(F.slice("_g", i, wide))))
    out = hashed.select(key, F.explode(least).alias("_f"))
    return out.select(key, F.shiftright("_f", 32).alias("_fp"), (F.lit(4294967295) - F.col("_f").bitwiseAND(F.lit(4294967295))).cast("int").alias("_pos"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, span: int = SPAN, gram: int = GRAM, with_row: bool = False) -> DataFrame:
    """Hit words of every document row and the items they come from.

    Returns ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.  A
    null or empty text has no words; a null or empty item has no window.  Equal items and repeated
    rows count as they are: each item id once.  A null item id stands for no item, its windows still
    hit.  Other columns are not read.  ``with_row`` adds ``row_hash``, xxhash64 of id and text.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    # rows are told apart by id and text, so rows that share an id keep their own hits
    keyed = base.select("doc_id", F.xxhash64("doc_id", "_text").alias("_row"), "_text")
    words = _bound(keyed.select("_row", "_text"), "_w", words_of(F.col("_text"))).select("_row", "_w")

    item_words = _bound(items.select(F.col(item_id).cast("string").alias("_item"), F.col(item_text).alias("_text")), "_w", words_of(F.col("_text"))).select("_item", "_w").where(F.size("_w") > 0)
    n = F.size("_w")
    starts = F.when(n >= span, F.sequence(F.lit(1), n - F.lit(span - 1))).otherwise(F.array(F.lit(1)))
    spans = item_words.select("_item", F.least(n, F.lit(span)).alias("_len"), F.explode(F.transform(starts, lambda s: F.array_join(F.slice("_w", s, span), " "))).alias("_win"))
    # a window once, with all its items, so that one shared by many items meets a place once
    windows = written(spans.groupBy("_win", "_len").agg(F.array_sort(F.collect_set("_item")).alias("_of")), "decontaminate-windows")

    probes = written(_fingerprints(item_words, "_item", span, gram).select("_fp").distinct(), "decontaminate-fingerprints")
    hits = joined(_fingerprints(words, "_row", span, gram), probes, "_fp", "left_semi", 64).select("_row", F.lit(span).alias("_len"), F.col("_pos"))
    for short in sorted(r[0] for r in windows.where(F.col("_len") < span).select("_len").distinct().collect()):
        wanted = windows.where(F.col("_len") == short).select(F.xxhash64(F.split("_win", " ")).alias("_fp")).distinct()
        found = words.where(F.size("_w") >= short).select("_row", F.inline(_all_grams(short)))
        hits = hits.unionByName(joined(found, wanted, "_fp", "left_semi", 64).select("_row", F.lit(short).alias("_len"), "_pos"))
    hits = written(hits.groupBy("_row", "_len").agg(F.collect_set("_pos").alias("_at")), "decontaminate-hits")

    # a hit k-gram lies in the windows that start up to span - k places before it
    back = F.when(F.col("_len") == span, F.lit(span - gram)).otherwise(F.lit(0))
    near = joined(words, hits, "_row", "inner", 4096)
    near = near.select("_row", "_w", "_len", F.explode(F.array_distinct(F.flatten(F.transform("_at", lambda p: F.sequence(F.greatest(F.lit(1), p - back), F.least(p, F.size("_w") - F.col("_len") + F.lit(1))))))).alias("_start"))
    near = near.select("_row", "_len", "_start", F.array_join(F.slice("_w", F.col("_start"), F.col("_len")), " ").alias("_win"))
    found = joined(near, windows, "_win", "inner", 512).where(near["_len"] == windows["_len"]).select("_row", near["_len"].alias("_len"), "_start", "_of")
    found = found.groupBy("_row").agg(F.collect_set(F.struct("_start", "_len")).alias("_at"), F.array_distinct(F.flatten(F.collect_set("_of"))).alias("_items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda s: F.sequence(s["_start"], s["_start"] + s["_len"] - F.lit(1))))))
    found = found.select("_row", covered.cast("long").alias("_hit"), F.array_sort("_items").alias("_items"))

    counted = keyed.select("doc_id", "_row", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
    out = counted.join(found, "_row", "left")
    n_hit = F.coalesce("_hit", F.lit(0).cast("long"))
    ids = F.coalesce("_items", F.array().cast("array<string>"))
    row = [F.col("_row").alias("row_hash")] if with_row else []
    return out.select("doc_id", *row, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without a hit."""
    hit = contaminated(docs, items, doc_id, text, item_id, item_text, with_row=True).where("contaminated").select("row_hash").distinct()
    hit = written(hit, "decontaminate-rows").withColumnRenamed("row_hash", "_row_hash")
    marked = docs.withColumn("_row_hash", F.xxhash64(F.col(doc_id).cast("long"), F.col(text)))
    return joined(marked, hit, "_row_hash", "left_anti", 64).select(*map(named, docs.columns))
