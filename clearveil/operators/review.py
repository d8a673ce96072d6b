"""Reports compared with what is expected of them: occurrences, labels, probes, lists that may only shrink, headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearveil.operators.findings import severity

# Warning codes by what they say about how complete a map is.
PAGE_CODES = ("PAGE_FAILED", "PAGE_THUMBNAIL", "IMAGE_COVERED")
OBJECT_CODES = ("XREF_UNREADABLE", "OBJECT_UNREADABLE", "UNTERMINATED_STRING", "LEFTOVER_UNDECODABLE_TEXT", "LEFTOVER_IMAGE", "LEFTOVER_CONTAINER", "REVISION_SCAN_FAILED", "REVISION_UNREADABLE", "REVISION_CAP", "TRAILER_UNREADABLE")
REVIEW_CODES = ("REVIEW_CROSS_LINE", "REVIEW_CROSS_PAGE", "REVIEW_FUSED_PATTERN", "REVIEW_METADATA_RAW", "REVIEW_HIDDEN_TEXT")
STORED_REVIEW_CODES = ("REVIEW_BINARY", "REVIEW_OBJECT_TEXT", "REVIEW_ADJACENT_LITERALS")
SCOPE_CODES = ("RULES_UNKNOWN_KEY", "RULES_UNQUOTED_VALUE", "RULES_TRUNCATED_PATTERN", "RULES_CAPTURING_GROUP")
OUTSIDE = ("orphaned", "unreferenced", "superseded")
# Probe results and the error of a run that says the same.
PROBE_ERRORS = {"password": "FILE_PASSWORD", "unreadable": "FILE_UNREADABLE"}


def code_level(code: Column, storage: Column) -> Column:
    """What a warning is about: page, document, scope, review, live, or outside the document; an unknown code the document."""
    out = F.coalesce(storage.isin(*OUTSIDE), F.lit(False))
    return (
        F.when(code.isin(*PAGE_CODES), "page")
        .when(code.isin(*SCOPE_CODES), "scope")
        .when(code.isin(*REVIEW_CODES), "review")
        .when(code.isin(*STORED_REVIEW_CODES), F.when(out, "outside").otherwise("live"))
        .when(code.isin(*OBJECT_CODES) & out, "outside")
        .otherwise("document")
    )


def headline_row(visible: Column, incomplete: Column, pending: Column, live: Column, on_demand: Column, exit_code: Column, json_unwritten: Column, n_codes: Column, outside_only: Column) -> Column:
    """The number, 1 to 8, of the one headline of a run; the first that fits."""
    return (
        F.when(visible, 1)
        .when(incomplete | pending | live, 2)
        .when(on_demand, 3)
        .when(exit_code == 1, 4)
        .when((exit_code == 2) & (n_codes > 0) & outside_only, 5)
        .when((exit_code == 2) & json_unwritten & (n_codes == 0), 6)
        .when(exit_code == 0, 7)
        .otherwise(8)
    )


def headlines(runs: DataFrame, warnings: DataFrame, doc: str) -> DataFrame:
    """(doc, headline, codes): ``runs`` has visible, on_demand, exit_code, json_unwritten; the rest comes from the warnings' levels."""
    level = code_level(F.col("code"), F.col("storage"))
    w = warnings.select(doc, "code", level.alias("_l")).groupBy(doc).agg(
        F.array_sort(F.collect_set("code")).alias("codes"), F.bool_or(F.col("_l").isin("page", "document")).alias("_i"), F.bool_or(F.col("_l") == "review").alias("_p"), F.bool_or(F.col("_l") == "live").alias("_v"), F.bool_and(F.col("_l") == "outside").alias("_o")
    )
    got = runs.join(w, doc, "left").na.fill(False, ["_i", "_p", "_v", "_o"])
    row = headline_row(F.col("visible"), F.col("_i"), F.col("_p"), F.col("_v"), F.col("on_demand"), F.col("exit_code"), F.col("json_unwritten"), F.coalesce(F.size("codes"), F.lit(0)), F.col("_o"))
    return got.select(doc, row.alias("headline"), F.coalesce(F.array_join("codes", ", "), F.lit("")).alias("codes"))


def place(storage: Column, page: Column, object_: Column, layer: Column) -> Column:
    """Where an occurrence is: its page, else its object, else joined text of a page layer, else one place a storage."""
    joined = F.when(layer.isin("Text", "OCR"), "|joined").otherwise("|elsewhere")
    after = F.when(page.isNotNull(), F.concat(F.lit("|p"), page.cast("string"))).when(object_.isNotNull(), F.concat(F.lit("|o"), object_.cast("string"))).otherwise(joined)
    return F.concat(storage, after)


def occurrence_units(entries: DataFrame, secrets: DataFrame, doc: str) -> DataFrame:
    """(doc, place, key, rules, finding): one unit for each place and secret, or "pattern" where no secret is.

    ``entries``: doc, rule, storage, page, object, layer, finding; ``secrets``: rule, secret.  Pattern
    rules of a place (names that begin with "patterns[") belong to each of its secrets.
    """
    e = entries.where("rule is not null").select(doc, "rule", "finding", place(*map(F.col, ("storage", "page", "object", "layer"))).alias("place"))
    e = e.join(F.broadcast(secrets.select("rule", "secret")), "rule", "left") if secrets.count() <= 100_000 else e.join(secrets.select("rule", "secret"), "rule", "left")
    pattern = F.col("rule").startswith("patterns[")
    keys = e.groupBy(doc, "place").agg(F.collect_set("secret").alias("_k"), F.collect_set(F.when(pattern, F.col("rule"))).alias("_pr"), F.bool_or(F.when(pattern, F.col("finding")).otherwise(False)).alias("_pf"))
    units = keys.select(doc, "place", "_pr", "_pf", F.explode(F.when(F.size("_k") > 0, F.col("_k")).otherwise(F.array(F.lit("pattern")))).alias("key"))
    own = e.where("secret is not null").groupBy(doc, "place", F.col("secret").alias("key")).agg(F.collect_set("rule").alias("_r"), F.bool_or("finding").alias("_f"))
    got = units.join(own, [doc, "place", "key"], "left")
    rules = F.array_sort(F.array_distinct(F.concat(F.coalesce("_r", F.array().cast("array<string>")), "_pr")))
    return got.select(doc, "place", "key", rules.alias("rules"), (F.coalesce("_f", F.lit(False)) | F.col("_pf")).alias("finding"))


def expected_for(instances: DataFrame, table: DataFrame) -> DataFrame:
    """Instances (location, storage, ...) with the cell and exit expected there; null where none is listed."""
    small = table.select("location", "storage", "cell", "expected_exit").distinct()
    return instances.join(F.broadcast(small) if small.count() <= 100_000 else small, ["location", "storage"], "left")


def probe_mismatches(runs: DataFrame, key: str) -> DataFrame:
    """(key, probe, error): files that the probe and the run disagree about; crashes and run-level errors are left out."""
    expected = F.coalesce(*[F.when(F.col("probe") == p, F.lit(e)) for p, e in PROBE_ERRORS.items()])
    said = F.col("error").isNull() | F.col("error").isin(*PROBE_ERRORS.values())
    return runs.where(~F.col("crashed") & ~F.col("timed_out") & said & ~F.col("error").eqNullSafe(expected)).select(key, "probe", "error")


def grown(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What a list that may only shrink has gained."""
    return new.select(*key).distinct().join(old.select(*key).distinct(), key, "left_anti")


def is_weaker(old_exit: Column, new_exit: Column) -> Column:
    """Whether the new exit says less than the old one: 1 says most, then 2, then 0."""
    return severity(new_exit) < severity(old_exit)


def relabelled(cases: DataFrame, findings: DataFrame, warnings: DataFrame, case: str) -> DataFrame:
    """(case, before, after, change): labels whose exit changes once class findings no longer count.

    ``cases``: case, exit_code, class_only; ``findings``: case, is_class; ``warnings``: case, is_review.
    A finding of another rule keeps 1, a warning that is no review keeps 2.  A case with other rules
    than classes cannot tell whose review it is ("undetermined"), nor can exit 2 without a warning.
    """
    f = findings.groupBy(case).agg(F.bool_or(~F.col("is_class")).alias("_f"))
    w = warnings.groupBy(case).agg(F.bool_or(~F.col("is_review")).alias("_w"), F.count_if("is_review").alias("_r"))
    got = cases.join(f, case, "left").join(w, case, "left").na.fill(False, ["_f", "_w"]).na.fill(0, ["_r"])
    after = F.when(F.col("_f"), 1).when(F.col("_w"), 2).when(F.col("exit_code") == 0, 0).when(~F.col("class_only"), None).when((F.col("exit_code") == 2) & (F.col("_r") == 0), None).otherwise(0)
    got = got.select(case, F.col("exit_code").alias("before"), after.alias("after")).where("not (before <=> after)")
    return got.withColumn("change", F.when(F.col("after").isNull(), "undetermined").otherwise("changed"))


def rule_counts(rules: DataFrame, findings: DataFrame, doc: str) -> DataFrame:
    """(doc, kind, found, total): rules of each kind with a finding, of all that there are; no finding is 0."""
    total = rules.groupBy("kind").agg(F.countDistinct("rule").alias("total"))
    docs = findings.select(doc).distinct()
    grid = docs.join(F.broadcast(total.withColumn("_one", F.lit(1))), F.lit(True))  # kinds are three at most
    got = findings.where("rule is not null").join(rules.select("rule", "kind"), "rule").groupBy(doc, "kind").agg(F.countDistinct("rule").alias("found"))
    return grid.drop("_one").join(got, [doc, "kind"], "left").na.fill(0, ["found"]).select(doc, "kind", "found", "total")
