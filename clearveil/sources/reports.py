"""Reports: one JSON document for each scanned file, and its text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearveil.functions.text import sanitized

# The fields of findings and warnings, always present, and the words of the exits.
FINDING = ("layer", "rule", "tier", "storage", "object", "revision", "page", "location", "sample")
WARNING = ("code", "kind", "layer", "rule", "storage", "object", "revision", "page", "tool", "message")
VERDICTS = {0: "pass", 1: "fail", 2: "uncertified"}
SCHEMA_VERSION = 1


def _entries(rows: DataFrame, fields: tuple[str, ...], doc: str, name: str) -> DataFrame:
    """(doc, name): the rows of a document as JSON, sorted by it, so that each run writes the same."""
    of = lambda c: sanitized(F.col(c)) if dict(rows.dtypes)[c] == "string" else F.col(c)
    entry = F.struct(*[(of(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in sorted(fields)])
    return rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.to_json(entry, {"ignoreNullFields": "false"}))).alias(name))


def json_reports(verdicts: DataFrame, findings: DataFrame, warnings: DataFrame, notices: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, exit_code, report): every document of ``verdicts`` has one, also one without any row elsewhere."""
    out = verdicts.select(doc, "exit_code")
    for rows, fields, name in ((findings, FINDING, "findings"), (warnings, WARNING, "warnings"), (notices, (*FINDING, "code"), "notices")):
        out = out.join(_entries(rows, fields, doc, name), doc, "left")
    word = F.coalesce(*[F.when(F.col("exit_code") == k, v) for k, v in VERDICTS.items()])
    listed = lambda c: F.concat(F.lit(f'"{c}":['), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit("]"))
    head = F.concat(F.lit(f'{{"schema_version":{SCHEMA_VERSION},"exit_code":'), F.col("exit_code").cast("string"), F.lit(',"verdict":"'), word, F.lit('",'))
    report = F.concat(head, listed("findings"), F.lit(","), listed("warnings"), F.lit(","), listed("notices"), F.lit("}"))
    return out.select(doc, "exit_code", report.alias("report"))


def text_report(exit_code: Column, findings: Column, warnings: Column, notices: Column) -> Column:
    """A few lines for a person."""
    banner = F.when(exit_code == 0, "PASS: nothing listed was found").when(exit_code == 1, "FAIL: listed values were found").otherwise("REVIEW: the document cannot be certified")
    line = lambda n, what: F.concat(n.cast("string"), F.lit(f" {what}"))
    return F.concat_ws("\n", banner, line(findings, "finding(s)"), line(warnings, "warning(s)"), line(notices, "notice(s)"))


def write_json(reports: DataFrame, folder: str) -> None:
    """One line for each document, in the order of the table's partitions."""
    reports.select(F.col("report").alias("value")).write.mode("overwrite").text(folder)


def private(text: Column, paths: list[str]) -> Column:
    """Given paths appear by their last part only."""
    for p in sorted(set(paths), key=len, reverse=True):
        if p not in ("", "."):
            text = F.replace(text, F.lit(p), F.lit(p.rstrip("/").rsplit("/", 1)[-1]))
    return text
