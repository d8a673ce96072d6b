"""From matches to findings, notices and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS, FAIL, REVIEW = 0, 1, 2


def deduplicated(matches: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in ``order``, which makes the kept sample the same every time."""
    w = Window.partitionBy(*key).orderBy(*order)
    return matches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def severity(exit_: Column) -> Column:
    """0 passes, 2 is worse, 1 is worst."""
    return F.when(exit_ == FAIL, 2).when(exit_ == REVIEW, 1).otherwise(0)


def verdicts(documents: DataFrame, findings: DataFrame, warnings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, n_findings, n_warnings, exit_code): 1 with a finding, else 2 with a warning, else 0.
    Every document has a row, also one without any unit."""
    f = findings.groupBy(doc).agg(F.count("*").alias("n_findings"))
    w = warnings.groupBy(doc).agg(F.count("*").alias("n_warnings"))
    out = documents.select(doc).join(f, doc, "left").join(w, doc, "left").na.fill(0, ["n_findings", "n_warnings"])
    return out.withColumn("exit_code", F.when(F.col("n_findings") > 0, FAIL).when(F.col("n_warnings") > 0, REVIEW).otherwise(PASS))


def page_labels(matches: DataFrame, doc: str, rule: str, page: str, shown: int = 3) -> DataFrame:
    """(doc, rule, n_pages, label): "p. 1, 2, 3 (+2 more)"; what is cut is said."""
    w = Window.partitionBy(doc, rule).orderBy(page)
    each = matches.select(doc, rule, page).distinct().withColumn("_i", F.row_number().over(w))
    pages = each.groupBy(doc, rule).agg(F.max("_i").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_i") <= shown, F.col(page)))).alias("_p"))
    n = F.col("_n")
    head = F.array_join(F.transform("_p", lambda p: p.cast("string")), ", ")
    more = F.when(n > shown, F.concat(F.lit(" (+"), (n - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return pages.select(doc, rule, n.cast("long").alias("n_pages"), F.concat(F.lit("p. "), head, more).alias("label"))


def page_ranges(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, ranges): "2, 4-6" of distinct pages, by gaps and islands."""
    d = pages.select(doc, page).distinct()
    d = d.withColumn("_i", F.col(page) - F.row_number().over(Window.partitionBy(doc).orderBy(page)))
    islands = d.groupBy(doc, "_i").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    got = islands.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("l"))
    return got.select(doc, F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("ranges"))
