"""Containment, seams, crossings and scattered pieces of listed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Listed values up to which they are literals of the plan.
FEW_VALUES = 300


def containing(units: DataFrame, values: DataFrame, norm: str = "norm", name: str = "rule", value: str = "value") -> DataFrame:
    """(all columns of ``units``, ``rule``) where a value's normal form occurs in the unit's.

    Few values become literals of one pass.  Many are found by equal k-grams: a value's first k
    characters are joined with every k-gram of the units, and the whole value is looked up after.
    Either way each row of ``units`` meets each row of ``values`` at most once: repeated rows stay.
    """
    rules = values.where(F.length(value) > 0).select(F.col(name).alias("_rule"), F.col(value).alias("_value"))
    listed = rules.limit(FEW_VALUES + 1).collect()
    if len(listed) <= FEW_VALUES:
        all_ = F.array(*[F.struct(F.lit(r["_rule"]).alias("r"), F.lit(r["_value"]).alias("v")) for r in listed]) if listed else F.array().cast("array<struct<r:string,v:string>>")
        hits = F.filter(all_, lambda x: F.contains(F.col(norm), x["v"]))
        return units.select("*", F.explode(F.transform(hits, lambda x: x["r"])).alias("rule"))
    k = min(12, rules.agg(F.min(F.length("_value"))).first()[0])
    keyed = rules.withColumn("_gram", F.substring("_value", 1, k))
    places = F.when(F.length(norm) >= k, F.sequence(F.lit(1), F.length(norm) - F.lit(k - 1)))
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(F.col(norm), i, F.lit(k))))
    met = units.select("*", F.explode(grams).alias("_gram")).join(keyed, "_gram").where(F.contains(norm, "_value"))
    return met.select(*units.columns, F.col("_rule").alias("rule"))


def chunks(units: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Units cut into pieces of ``size`` characters that each begin with the last ``overlap`` of the one before."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(size))
    pieces = F.transform(starts, lambda i: F.substring(F.col(text), F.greatest(F.lit(1), i - overlap), F.least(i - 1, F.lit(overlap)) + size))
    return units.withColumn(text, F.explode(pieces))


def straddles(left: Column, right: Column, value: Column) -> Column:
    """Whether ``value`` occurs in left + right at a place that lies on both sides of the join."""
    n = F.length(left)
    at = F.call_function("locate", value, F.concat(left, right), F.greatest(F.lit(1), n - F.length(value) + 2))
    return (F.length(value) >= 2) & (at >= 1) & (at <= n)


def seams(lines: DataFrame, values: list[tuple[str, str]], doc: str, page: str, line: str, norm: str = "norm") -> DataFrame:
    """(doc, page, rule): a value straddles the last line of the page before, just one less, and the first line."""
    ends = lines.groupBy(doc, page).agg(F.max_by(norm, line).alias("_last"), F.min_by(norm, line).alias("_first"))
    w = Window.partitionBy(doc).orderBy(page)
    met = ends.select(doc, page, "_first", F.lag("_last").over(w).alias("_before"), F.lag(page).over(w).alias("_page")).where(F.col("_page") == F.col(page) - 1)
    return _named(met, values, lambda v: straddles(F.col("_before"), F.col("_first"), v)).select(doc, page, "rule")


def crossings(pages: DataFrame, values: list[tuple[str, str]], doc: str, page: str, norm: str = "norm") -> DataFrame:
    """(doc, page, rule): a value straddles the kept end of all text before and a page's beginning.

    Each page is first cut to what can matter, one less than the longest value at either end.  Pages
    without text add nothing, so no more pages than characters are looked back.
    """
    keep = max(len(v) for _, v in values) - 1
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(-max(1, keep), -1)
    short = pages.where(F.length(norm) > 0).select(doc, page, F.left(norm, F.lit(keep)).alias("_head"), F.right(norm, F.lit(keep)).alias("_end"))
    tail = F.right(F.array_join(F.collect_list("_end").over(w), ""), F.lit(keep))
    return _named(short.select(doc, page, "_head", tail.alias("_tail")), values, lambda v: straddles(F.col("_tail"), F.col("_head"), v)).select(doc, page, "rule")


def _named(df: DataFrame, values: list[tuple[str, str]], holds) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(holds(F.lit(v)), F.lit(n)) for n, v in values]))
    return df.select("*", F.explode(hits).alias("rule"))


def scattered(lines: DataFrame, values: DataFrame, doc: str, line: str, norm: str = "norm", window: int = 5, across: int | None = None) -> DataFrame:
    """(doc, rule): two or three pieces of a value, an end of one line, perhaps one whole line, and
    the start of another, each another line, all within ``window`` consecutive lines, in any order.
    With ``across`` only assemblies that use lines on both sides of that line number."""
    cuts = values.where(F.length("value") >= 2).select("rule", "value", F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("k"))
    cuts = F.broadcast(cuts)  # rules are a configuration, a few characters each
    text = lines.where(F.length(norm) > 0).select(F.col(doc).alias("d"), F.col(line).alias("n"), F.col(norm).alias("t"))
    last = cuts.withColumn("c", F.expr("substr(value, k, 1)"))
    first = cuts.withColumn("c", F.expr("substr(value, k + 1, 1)"))
    ends = text.withColumn("c", F.right("t", F.lit(1))).join(last, "c").where("endswith(t, left(value, k))").select("d", "rule", "value", F.col("n").alias("i"), F.col("k").alias("ki"))
    starts = text.withColumn("c", F.left("t", F.lit(1))).join(first, "c").where("startswith(t, substr(value, k + 1))").select("d", "rule", F.col("n").alias("j"), F.col("k").alias("kj"))
    near = ends.join(starts, ["d", "rule"]).where((F.col("i") != F.col("j")) & (F.abs(F.col("i") - F.col("j")) < window))
    sides = lambda *c: F.lit(True) if across is None else ~(F.greatest(*c) < across) & (F.least(*c) < across)
    two = near.where((F.col("ki") == F.col("kj")) & sides("i", "j")).select("d", "rule")
    mid = text.select("d", F.col("n").alias("m"), "t")
    three = near.where("kj > ki").join(mid, "d").where((F.col("m") != F.col("i")) & (F.col("m") != F.col("j")) & (F.abs(F.col("m") - F.col("i")) < window) & (F.abs(F.col("m") - F.col("j")) < window))
    three = three.where("kj = ki + length(t) and substr(value, ki + 1, length(t)) = t").where(sides("i", "j", "m")).select("d", "rule")
    return two.union(three).distinct().select(F.col("d").alias(doc), "rule")
