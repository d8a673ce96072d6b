import json

from clearveil.operators import evaluation as ev
from clearveil.operators import structure as st
from clearveil.sources import reports as rp
from pyspark.sql import functions as F


def _set(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_environmental_warnings(spark):
    df = spark.createDataFrame([("OCR_UNAVAILABLE", None), ("TOOL_MISSING", "qpdf"), ("TOOL_MISSING", "/usr/bin/qpdf"), ("TOOL_MISSING", None), ("OTHER", "qpdf"), (None, None)], "c string, t string")
    got = [r[0] for r in df.select(ev.environmental(F.col("c"), F.col("t"), ("qpdf",))).collect()]
    assert got == [True, False, False, False, False, False]
    assert [r[0] for r in df.select(ev.environmental(F.col("c"), F.col("t"), ())).collect()] == [True, True, False, False, False, False]


def test_exits_without_class_rules(spark):
    docs = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True), (5, False), (6, False)], "d int, error boolean")
    f = spark.createDataFrame([(1, "ssn"), (2, "ssn"), (2, "v"), (4, "ssn"), (6, None)], "d int, rule string")
    w = spark.createDataFrame([(1, "ssn"), (3, "ssn"), (5, None)], "d int, rule string")
    assert _set(ev.exits(docs, f, w, "d", ["ssn"]), "d", "before", "after") == [(1, 1, 0), (2, 1, 1), (3, 2, 0), (4, 1, 2), (5, 2, 2), (6, 1, 1)]


def test_baseline_counts_files_and_findings(spark):
    files = spark.createDataFrame([(1, True), (2, True), (3, False)], "d int, measured boolean")
    f = spark.createDataFrame([(1, "ssn", "Text", "formatted"), (1, "ssn", "Hidden", "formatted"), (2, "ssn", "Text", "uuid"), (3, "ssn", "Text", "uuid")], "d int, rule string, layer string, shape string")
    got = {(r["layer"], r["shape"], r["by_layer"], r["by_shape"]): (r["files"], r["findings"], r["pct"]) for r in ev.pattern_baseline(files, f, "d").collect()}
    assert got[None, None, False, False] == (2, 3, 100.0) and got["Text", None, True, False] == (2, 2, 100.0)
    assert got[None, "formatted", False, True] == (1, 2, 50.0) and got["Text", "uuid", True, True] == (1, 1, 50.0)


def test_demotion_bounds(spark):
    cases = spark.createDataFrame([(c, 1, False) for c in range(6)] + [(6, 1, True), (7, 2, False)], "c int, exit_code int, other_hard boolean")
    rows = [(0, "ssn", ["uuid"]), (1, "ssn", ["uuid", "unknown"]), (2, "ssn", ["formatted"]), (3, "ssn", ["uuid"]), (3, "ssn", ["formatted"]), (4, "email", ["email-address"]), (5, "ssn", ["uuid", "formatted"]), (6, "ssn", ["uuid"]), (7, "ssn", ["uuid"])]
    got = ev.demotions(cases, spark.createDataFrame(rows, "c int, rule string, shapes array<string>"), {"A": {"ssn": ["formatted"]}}, "c")
    assert _set(got, "c", "at_least", "at_most") == [(0, True, True), (1, False, True), (5, False, True)]


def test_problems_scopes_and_summary(spark):
    e = spark.createDataFrame([(1, "a", "live"), (1, "b", None)], "c int, n string, p string")
    f = spark.createDataFrame([(1, "a", "old"), (1, "b", None), (1, "z", "live")], "c int, n string, p string")
    assert _set(ev.problems(e, f, "c", "n", "p"), "c", "n", "p", "problem") == [(1, "a", "live", "missing"), (1, "a", "old", "unexpected")]
    w = spark.createDataFrame([(1, "X", 2), (1, "X", 4), (1, "X", 5), (1, "X", None), (1, "Y", None), (2, "X", 3)], "d int, c string, p int")
    assert [r[2] for r in _set(ev.code_scopes(w, "d", "c", "p"), "d", "c", "scope")] == ["X pp. 2, 4-5 and document-wide", "Y", "X p.3"]
    i = spark.createDataFrame([("m", o) for o in ("hit", "hit", "missed", "ambiguous")], "method string, outcome string")
    assert _set(ev.summary(i, ["method"]), "total", "hits", "missed", "ambiguous", "caught") == [(4, 2, 1, 1, 66.7)]


def test_references_tiles_trees_and_caps(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0), (1, 1, 2, 0), (1, 2, 3, 1), (1, 2, 9, 0)], "d int, src int, num int, gen int")
    objects = spark.createDataFrame([(1, 2, 0), (1, 3, 0)], "d int, num int, gen int")
    assert _set(st.resolved(edges, objects, "d"), "num", "state") == [(2, "live"), (3, "generation"), (9, "dangling")]
    tiles = spark.createDataFrame([(1, 0, 4), (1, 4, 9), (2, 1, 4), (2, 5, 8)], "d int, start int, end int")
    sizes = spark.createDataFrame([(1, 9), (2, 9), (3, 1), (4, 0)], "d int, size int")
    assert _set(st.tiling_gaps(tiles, sizes, "d"), "d", "problem") == [(2, "begin"), (2, "end"), (2, "inside"), (3, "none")]
    leaves = spark.createDataFrame([(1, "t", 0, "a", ["r", "k"]), (1, "t", 1, "b", ["r", "k"]), (1, "t", 2, "b", ["r", "m"])], "d int, tree string, seq int, key string, path array<string>")
    nodes = spark.createDataFrame([(1, "t", "r", None, None), (1, "t", "k", "a", "b"), (1, "t", "m", "a", "b")], "d int, tree string, node string, low string, high string")
    assert _set(st.tree_faults(leaves, nodes, "d"), "node", "fault") == [("m", "limits"), ("m", "order")]
    rows = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "d int, n int")
    assert _set(st.capped(rows, ["d"], ["n"], 3), "d", "n", "left_out") == [(1, 0, 0), (1, 1, 0), (1, 2, 2), (2, 0, 0)]
    assert _set(st.revisions_kept(rows.withColumnRenamed("n", "revision"), "d", 3), "d", "revision", "left_out") == [(1, 0, 2), (1, 3, 2), (1, 4, 2), (2, 0, 0)]


def test_reports_are_json_and_sorted(spark):
    v = spark.createDataFrame([(1, 1), (2, 0)], "doc_id int, exit_code int")
    f = spark.createDataFrame([(1, "b", 2), (1, "a\u0007", 1)], "doc_id int, rule string, page int")
    w = spark.createDataFrame([], "doc_id int, code string")
    got = {r["doc_id"]: json.loads(r["report"]) for r in rp.json_reports(v, f, w, w, "doc_id").collect()}
    assert [x["rule"] for x in got[1]["findings"]] == ["a�", "b"] and set(got[1]["findings"][0]) == set(rp.FINDING)
    assert got[2] == {"schema_version": 1, "exit_code": 0, "verdict": "pass", "findings": [], "warnings": [], "notices": []}
    assert spark.range(1).select(rp.private(F.lit("in /a/b/c.pdf"), ["/a/b/c.pdf", "."])).first()[0] == "in c.pdf"
