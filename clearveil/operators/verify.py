"""Rules against located text: tiers, order of checks, and the verdict of each document."""

from __future__ import annotations

import json as json_
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearveil.functions import text as tx
from clearveil.operators import findings as fd
from clearveil.operators import matching as mt
from clearveil.sources.rules import Rules

#: Fixed value: characters of the text before that a scan across pages still sees.
OVERLAP = 512

_KEY = ["doc_id", "page", "rule"]


def folded_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, folded) of pages (doc_id, page, text)."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return tx.folded(lines, "l").drop("l")


def _first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return fd.deduplicated(rows, key, order)


def _hits(rows: DataFrame, text: str, rules: list) -> DataFrame:
    """A row for every rule with a match, with the match as ``sample``."""
    found = F.array(*[F.struct(F.lit(r.name).alias("rule"), tx.rule_match(F.col(text), r.kind, r.text, r.flags).alias("sample")) for r in rules])
    return rows.select("*", F.inline(F.filter(found, lambda x: x["sample"].isNotNull())))


def hard_patterns(pages: DataFrame, rules: list) -> DataFrame:
    """(doc_id, page, rule, sample): matches on one line, of each page and rule the first."""
    return _first(_hits(folded_lines(pages), "folded", rules), _KEY, ["line"]).select(*_KEY, "sample")


def soft_patterns(pages: DataFrame, rules: list, hard: DataFrame) -> DataFrame:
    """(doc_id, page, rule, sample): matches in a page's text with runs of separators made one, for
    rules that are not hard on the page."""
    read = tx.folded(pages.select("doc_id", "page", "text"), "text").withColumn("_c", tx.collapse_separators(F.col("folded")))
    return _hits(read, "_c", rules).select(*_KEY, "sample").join(hard.select(*_KEY), _KEY, "left_anti")


def cross_page_patterns(pages: DataFrame, rules: list, seen: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, rule, page, sample): matches in the running text, each page after a line feed, for
    rules seen nowhere in the document.

    A page is read with the last ``overlap`` characters before it, which the pages before give: no
    more of them than characters, each cut to that length, so no text is moved whole.
    """
    cut = pages.select("doc_id", "page", "text", F.right(F.concat(F.lit("\n"), F.coalesce("text", F.lit(""))), F.lit(overlap)).alias("_end"))
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(-overlap, -1)
    joined = cut.withColumn("_w", F.concat(F.right(F.array_join(F.collect_list("_end").over(w), ""), F.lit(overlap)), F.lit("\n"), F.coalesce("text", F.lit(""))))
    hits = _hits(tx.folded(joined.select("doc_id", "page", "_w"), "_w"), "folded", rules)
    first = _first(hits, ["doc_id", "rule"], ["page"]).select("doc_id", "rule", "page", "sample")
    return first.join(seen.select("doc_id", "rule").distinct(), ["doc_id", "rule"], "left_anti")


def hard_values(pages: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, page, rule): values on one line."""
    lines = pages.select("doc_id", "page", F.explode(F.split("text", "\n")).alias("l"))
    return mt.containing(tx.normalized(lines, "l").select("doc_id", "page", "norm"), values).select(*_KEY).distinct()


class Result(NamedTuple):
    findings: DataFrame  # doc_id, rule, tier, page, location, sample
    warnings: DataFrame  # doc_id, rule, code, page
    notices: DataFrame  # as findings
    verdicts: DataFrame  # doc_id, n_findings, n_warnings, exit_code


def verify(pages: DataFrame, rules: Rules, *, strict_classes: bool = False, fail_fast: bool = False, documents: DataFrame | None = None) -> Result:
    """Findings, warnings, notices and verdicts of documents given as pages (doc_id, page, text).

    Hard: a value or pattern on one line, a value across a page seam.  Review: joined lines of a page,
    the running text across pages, patterns with separators collapsed or across pages; each only
    where the rule is not hard on the page, or, across pages, nowhere in the document.  Classes that
    are not strict give notices, which never count.  With ``fail_fast`` nothing after a document's
    first page with a counting finding is reported, and a warning says so.  A document without text
    has a warning; with ``documents`` also one without any page.
    """
    spark = pages.sparkSession
    pages = pages.select("doc_id", "page", "text")
    values = rules.values()
    patterns = [r for r in rules.rules if r.kind != "value"]
    none = "doc_id long, page int, rule string, sample string"
    type_ = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    none = none.replace("doc_id long", f"doc_id {type_['doc_id']}").replace("page int", f"page {type_['page']}")
    empty = spark.createDataFrame([], none)

    hard, review = [empty.withColumn("how", F.lit("line"))], [empty.withColumn("code", F.lit(""))]
    if values:
        listed = spark.createDataFrame(values, "rule string, value string")
        on_line = hard_values(pages, listed)
        read = tx.normalized(pages, "text")
        lines = tx.normalized(pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "l")), "l").where("norm <> ''")
        seam = mt.seams(lines, values, "doc_id", "page", "line")
        in_page = mt.containing(read.select("doc_id", "page", "norm"), listed).select(*_KEY).distinct()
        # a page that only joins lines, and running text that only joins pages, ask for review
        over = mt.crossings(read.select("doc_id", "page", "norm"), values, "doc_id", "page")
        no = F.lit(None).cast("string").alias("sample")
        here = on_line.unionByName(seam).distinct()
        hard += [on_line.select(*_KEY, no, F.lit("line").alias("how")), seam.join(on_line, _KEY, "left_anti").select(*_KEY, no, F.lit("page seam").alias("how"))]
        joined = in_page.join(here, _KEY, "left_anti")
        review += [joined.select(*_KEY, no, F.lit("REVIEW_CROSS_LINE").alias("code")), over.join(here.unionByName(joined), _KEY, "left_anti").select(*_KEY, no, F.lit("REVIEW_CROSS_PAGE").alias("code"))]
    if patterns:
        h = hard_patterns(pages, patterns)
        s = soft_patterns(pages, patterns, h)
        x = cross_page_patterns(pages, patterns, h.select("doc_id", "rule").unionByName(s.select("doc_id", "rule")))
        hard.append(h.select(*_KEY, "sample", F.lit("line").alias("how")))
        review += [r.select(*_KEY, "sample", F.lit("REVIEW_FUSED_PATTERN").alias("code")) for r in (s, x)]
    found, doubts = hard[0], review[0]
    for r in hard[1:]:
        found = found.unionByName(r)
    for r in review[1:]:
        doubts = doubts.unionByName(r)

    quiet = sorted(rules.informational(strict_classes))
    counts = ~F.col("rule").isin(*quiet) if quiet else F.lit(True)
    skipped = None
    if fail_fast:
        stop = found.where(counts).groupBy("doc_id").agg(F.min("page").alias("_stop"))
        last = pages.groupBy("doc_id").agg(F.max("page").alias("_last"))
        skipped = stop.join(last, "doc_id").where("_stop < _last").select("doc_id", F.lit(None).cast("string").alias("rule"), F.lit("SKIPPED_FAIL_FAST").alias("code"), F.lit(None).cast(type_["page"]).alias("page"))
        before = lambda r: r.join(stop, "doc_id", "left").where("_stop is null or page <= _stop").drop("_stop")
        found, doubts = before(found), before(doubts)
    sample = tx.masked(F.col("sample"), [v for _, v in values])
    # one finding a rule, with its pages; the sample is the first page's
    first = _first(found, ["doc_id", "rule"], ["page", "how"]).select("doc_id", "rule", "how", "sample")
    labels = fd.page_labels(found, "doc_id", "rule", "page")
    whole = first.join(labels, ["doc_id", "rule"]).select("doc_id", "rule", F.lit("hard").alias("tier"), F.when(F.col("n_pages") == 1, F.regexp_extract("label", "[0-9]+", 0).cast("long")).alias("page"), F.concat_ws(", ", "label", "how").alias("location"), sample.alias("sample"))
    warnings = doubts.where(counts).select("doc_id", "rule", "code", "page").distinct()
    everyone = pages.select("doc_id") if documents is None else documents.select("doc_id").unionByName(pages.select("doc_id"))
    read_ = pages.where("trim(text) <> ''").select("doc_id").distinct()
    blank = everyone.distinct().join(read_, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("string").alias("rule"), F.lit("EMPTY_DOCUMENT").alias("code"), F.lit(None).cast(type_["page"]).alias("page"))
    warnings = warnings.unionByName(blank) if skipped is None else warnings.unionByName(blank).unionByName(skipped)
    findings = whole.where(counts)
    quiet_doubts = doubts.where(~counts).select("doc_id", "rule", F.lit("review").alias("tier"), F.col("page").cast("long").alias("page"), F.col("code").alias("location"), sample.alias("sample"))
    notices = whole.where(~counts).unionByName(quiet_doubts)
    return Result(findings, warnings, notices, fd.verdicts(everyone.distinct(), findings, warnings))


def metadata_units(rows: DataFrame, doc: str, json: str, excluded: tuple[str, ...]) -> DataFrame:
    """(doc, values, patterns, malformed) of tool output as JSON: the whole object but ``excluded``
    fields, as text, for values, and its string values alone, fenced by blank lines, for patterns.

    Output that is no object is malformed and read as it is; strings inside lists and objects count.
    """
    parsed = F.try_parse_json(F.col(json))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    fields = F.from_json(json, "map<string,string>")
    own = F.map_filter(fields, lambda k, v: ~k.isin(*excluded))
    text = F.to_json(own)
    strings = string_values(F.when(is_object, F.map_values(own)).otherwise(F.array(F.col(json))))
    return rows.select(doc, F.when(is_object, text).otherwise(F.col(json)).alias("values"), F.when(is_object, F.array_join(strings, "\n\n")).otherwise(F.col(json)).alias("patterns"), (~F.coalesce(is_object, F.lit(False))).alias("malformed"))


def string_values(found):
    """The values of a flat object that are no numbers, booleans or null, as read into a map of strings."""
    return F.filter(found, lambda v: v.isNotNull() & ~v.rlike(r"\A(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)\z"))


def json_strings(json):
    """All string values of a JSON text, however deep, in order; keys are skipped."""
    def walk(node, out: list[str]) -> list[str]:
        todo = [node]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif isinstance(x, dict | list):
                todo += list(x.values() if isinstance(x, dict) else x)[::-1]
        return out

    def each(s: pd.Series) -> pd.Series:
        rows = []
        for t in s:
            try:
                rows.append(walk(json_.loads(t), []) if t is not None else None)
            except (ValueError, RecursionError):
                rows.append(None)
        return pd.Series(rows, dtype=object)

    return F.pandas_udf(each, "array<string>")(json)
