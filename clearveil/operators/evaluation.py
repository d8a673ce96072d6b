"""Scorecards, strata, differentials and policy what-ifs over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scorecard(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and run-time percentiles of case rows (truth, expected_exit, actual_exit, has_hard_finding, crashed, timed_out, elapsed)."""
    ran = ~F.col("crashed") & ~F.col("timed_out")
    leak, clean, exit_ = F.col("truth") == "leak", F.col("truth") == "clean", F.col("actual_exit")
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(leak).alias("leak_cases"),
        F.count_if(clean).alias("clean_cases"),
        F.count_if(leak & ran & (exit_ == 0)).alias("silent_miss"),
        F.count_if(leak & ran & (F.col("expected_exit") == 1) & (exit_ == 2)).alias("downgrade"),
        F.count_if(clean & ran & F.col("has_hard_finding")).alias("false_hard"),
        F.count_if(clean & ran & (exit_ == 2)).alias("review_rate"),
        F.count_if(F.col("crashed") & ~F.col("timed_out")).alias("crashes"),
        F.count_if(F.col("timed_out")).alias("timeouts"),
        F.coalesce(F.percentile("elapsed", 0.5), F.lit(0.0)).alias("runtime_p50"),
        F.coalesce(F.percentile("elapsed", 0.95), F.lit(0.0)).alias("runtime_p95"),
    )


def in_strata(rows: DataFrame, strata: list[Column]) -> DataFrame:
    """Each row once for every stratum it belongs to (null: none) and once for "all"."""
    return rows.select("*", F.explode(F.array_compact(F.array(F.lit("all"), *strata))).alias("stratum"))


def multiset_difference(reference: DataFrame, candidate: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_reference, n_candidate, change) of keys whose counts differ; null keys are keys."""
    a = reference.groupBy(*key).agg(F.count("*").alias("n_reference"), F.lit(0).cast("long").alias("n_candidate"))
    b = candidate.groupBy(*key).agg(F.lit(0).cast("long").alias("n_reference"), F.count("*").alias("n_candidate"))
    both = a.unionByName(b).groupBy(*key).agg(F.sum("n_reference").alias("n_reference"), F.sum("n_candidate").alias("n_candidate")).where("n_reference <> n_candidate")
    return both.withColumn("change", F.when(F.col("n_reference") == 0, "added").when(F.col("n_candidate") == 0, "removed").otherwise("count"))


def against_accepted(differences: DataFrame, accepted: DataFrame, key: list[str]) -> DataFrame:
    """(key, status): differences "accepted" or "unlisted", and listed ones that no longer occur, "stale"."""
    d, a = differences.select(*key).distinct(), accepted.select(*key).distinct()
    known = d.join(a, key, "left_semi").withColumn("status", F.lit("accepted"))
    new = d.join(a, key, "left_anti").withColumn("status", F.lit("unlisted"))
    return known.unionByName(new).unionByName(a.join(d, key, "left_anti").withColumn("status", F.lit("stale")))


def worst(rows: DataFrame, key: list[str], value: str, rank: Column) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by(value, rank).alias(value))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(100 * part / whole, 1))


# Warning codes that a missing tool explains, by tool (null: the warning names it).
ENVIRONMENTAL = {"OCR_UNAVAILABLE": "ocr", "TOOL_MISSING": None}
KNOWN_TOOLS = ("qpdf", "exiftool", "ocr")


def environmental(code: Column, tool: Column, have: tuple[str, ...]) -> Column:
    """Whether a warning only says that a tool, not one of ``have``, is missing here."""
    means = F.coalesce(*[F.when(code == c, F.lit(t) if t else tool) for c, t in ENVIRONMENTAL.items()])
    return F.coalesce(means.isin(*KNOWN_TOOLS) & ~means.isin(*have) if have else means.isin(*KNOWN_TOOLS), F.lit(False))


# The warning of a layer whose tool is missing.
LAYER_WARNINGS = {"ocr": "OCR_UNAVAILABLE", "exiftool": "TOOL_MISSING", "qpdf": "TOOL_MISSING"}


def unread_layers(documents: DataFrame, doc: str, have: tuple[str, ...]) -> DataFrame:
    """(doc, tool, code): for every document the layers that cannot be read without a tool that is not one of ``have``."""
    lost = [F.struct(F.lit(t).alias("tool"), F.lit(c).alias("code")) for t, c in LAYER_WARNINGS.items() if t not in have]
    return documents.select(doc, F.inline(F.array(*lost)) if lost else F.lit(None).cast("string")).where(F.lit(bool(lost)))


def exits(documents: DataFrame, findings: DataFrame, warnings: DataFrame, doc: str, ignored: list[str]) -> DataFrame:
    """(doc, before, after): exits with and without the rules ``ignored``.

    ``documents`` has ``error``: a failed run is 1 if a finding remains, else 2; it never passes.
    """
    other = ~F.coalesce(F.col("rule").isin(*ignored), F.lit(False)) if ignored else F.lit(True)
    count = lambda rows, p: rows.groupBy(doc).agg(F.count("*").alias(p + "_all"), F.count_if(other).alias(p + "_other"))
    d = documents.select(doc, "error").join(count(findings, "f"), doc, "left").join(count(warnings, "w"), doc, "left").na.fill(0)
    exit_ = lambda s: F.when(F.col("f" + s) > 0, 1).when(F.col("error") | (F.col("w" + s) > 0), 2).otherwise(0)
    return d.select(doc, exit_("_all").alias("before"), exit_("_other").alias("after"))


def pattern_baseline(files: DataFrame, findings: DataFrame, doc: str) -> DataFrame:
    """(rule, layer, shape, files, findings, pct): hard findings per class, by layer, by shape, by both.

    Null ``layer`` or ``shape`` with ``by_layer`` or ``by_shape`` false means all of them.  ``pct`` is of the measured files.
    """
    n = files.where("measured").agg(F.count("*").alias("_n"))
    hard = findings.join(files.where("measured").select(doc), doc, "left_semi")
    g = hard.groupingSets([["rule"], ["rule", "layer"], ["rule", "shape"], ["rule", "layer", "shape"]], "rule", "layer", "shape")
    out = g.agg((F.grouping("layer") == 0).alias("by_layer"), (F.grouping("shape") == 0).alias("by_shape"), F.countDistinct(doc).alias("files"), F.count("*").alias("findings"))
    return out.join(F.broadcast(n)).select("rule", "layer", "shape", "by_layer", "by_shape", "files", "findings", percent(F.col("files"), F.col("_n")).alias("pct"))


def demotions(cases: DataFrame, findings: DataFrame, options: dict[str, dict[str, list[str]]], case: str) -> DataFrame:
    """(option, case, at_least, at_most): cases with exit 1 that an option moves to review.

    A finding has ``rule`` and ``shapes``, an array of what it may be, "unknown" among them; an
    option lists the shapes it keeps by class, a class without a list keeps all.  At least: each
    finding has only known shapes and none kept.  At most: no finding has only kept ones.  A case with
    ``other_hard`` is never moved.
    """
    rows = [(o, c, s) for o, kept in options.items() for c, s in kept.items()]
    kept = F.broadcast(findings.sparkSession.createDataFrame(rows, "option string, rule string, kept array<string>"))
    names = F.array(*map(F.lit, options))
    f = findings.select(case, "rule", "shapes", F.explode(names).alias("option")).join(kept, ["option", "rule"], "left")
    known = F.array_except("shapes", F.array(F.lit("unknown")))
    sure = (F.size(known) > 0) & (F.size(known) == F.size(F.array_distinct("shapes")))
    keeps_all = sure & (F.size(F.array_except(known, F.col("kept"))) == 0) | F.col("kept").isNull()
    surely_gone = F.coalesce(sure & ~F.arrays_overlap(known, F.col("kept")), F.lit(False))
    per = f.groupBy("option", case).agg(F.bool_and(surely_gone).alias("at_least"), (~F.bool_or(F.coalesce(keeps_all, F.lit(False)))).alias("at_most"))
    return per.join(cases.where("exit_code = 1 and not other_hard").select(case), case, "left_semi").select("option", case, "at_least", "at_most").where("at_most")


def problems(expected: DataFrame, found: DataFrame, case: str, name: str, place: str) -> DataFrame:
    """(case, name, place, problem): expected ones that are "missing", and "unexpected" places of names the case expects."""
    key = [case, name, place]
    e, f = expected.select(*key).distinct(), found.select(*key).distinct()
    lost = _anti(e, f, key).withColumn("problem", F.lit("missing"))
    extra = _anti(f, e, key).join(e.select(case, name).distinct(), [case, name], "left_semi").withColumn("problem", F.lit("unexpected"))
    return lost.unionByName(extra)


def _anti(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``a`` whose key, nulls included, is not in ``b``."""
    b = b.select(*[F.col(k).alias("_" + k) for k in key])
    same = F.lit(True)
    for k in key:
        same = same & a[k].eqNullSafe(b["_" + k])
    return a.join(b, same, "left_anti")


def code_scopes(warnings: DataFrame, doc: str, code: str, page: str) -> DataFrame:
    """(doc, code, scope): "CODE pp. 2, 4-6", with "and document-wide" if any is without a page; "CODE" if all are."""
    from clearveil.operators.findings import page_ranges

    w = warnings.select(F.struct(F.col(doc).alias("d"), F.col(code).alias("c")).alias("_k"), F.col(page).alias("_p"))
    ranges = page_ranges(w.where("_p is not null"), "_k", "_p")
    g = w.groupBy("_k").agg(F.bool_or(F.col("_p").isNull()).alias("_wide"), F.countDistinct("_p").alias("_n")).join(ranges, "_k", "left")
    label = F.concat(F.when(F.col("_n") == 1, "p.").otherwise("pp. "), F.col("ranges"), F.when(F.col("_wide"), " and document-wide").otherwise(""))
    return g.select(F.col("_k.d").alias(doc), F.col("_k.c").alias(code), F.concat_ws(" ", F.col("_k.c"), label).alias("scope"))


def summary(instances: DataFrame, by: list[str]) -> DataFrame:
    """Instances by ``by`` with a column for each outcome; ``caught`` is the share of hits among all but ambiguous ones."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    g = instances.groupBy(*by).agg(F.count("*").alias("total"), is_("hit").alias("hits"), is_("downgraded").alias("downgraded"), is_("ambiguous").alias("ambiguous"), is_("missed").alias("missed"))
    return g.withColumn("caught", percent(F.col("hits"), F.col("total") - F.col("ambiguous")))
