import random
import re
import unicodedata

import pytest
from clearveil.functions import text as tx
from clearveil.operators import matching as mt
from clearveil.operators import review as rv
from clearveil.operators import structure as st
from clearveil.operators import verify as vf
from clearveil.plans import checks
from clearveil.sources import pdf_file
from clearveil.sources.rules import Rule, Rules
from pyspark.sql import functions as F


def test_patterns_read_every_script_as_written(spark):
    r = random.Random(3)
    sources = [r"\d+", r"\s\w+", r"[\d-]{3}", r"[^\s]+x", r"(a|é)\1", r"\w\b", r"[[a]b", r"\D\S", r"[\w.&&]+", r"x[]a]", r"^a"]
    texts = ["".join(r.choice("a b1é٣\x1c\x85 -x[]&.Ж\n_²") for _ in range(r.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for source in sources:
        got = {x["i"]: x["m"] for x in df.select("i", tx.rule_match(F.col("t"), "pattern", source, "m").alias("m")).collect()}
        for i, t in enumerate(texts):
            found = next((m[0] for m in re.finditer(source, t, re.M) if m[0]), None)
            assert got[i] == found, (source, t)
    with pytest.raises(ValueError):
        tx.java(r"[\S]")


def test_classes_read_digits_of_any_script(spark):
    df = spark.createDataFrame([("212-555-٠١٢٣",), ("4111 1111 1111 111١",)], "t string")
    got = df.select(tx.first_match(F.col("t"), "us-phone").alias("p"), tx.first_match(F.col("t"), "credit-card").alias("c")).collect()
    assert got[0]["p"] == "212-555-٠١٢٣" and got[1]["c"] is not None


def _bare(text):
    d = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).casefold()
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in d.replace("ı", "i") if c.isalnum())


def test_masks_show_no_character_of_a_value(spark):
    r = random.Random(5)
    values = ["Jo９", "ß4", "ЖЩ"]
    samples = ["".join(r.choice("abjo9４ßsЖщé-12٣") for _ in range(r.randrange(14))) for _ in range(500)]
    df = spark.createDataFrame([(s, i % 7 == 0) for i, s in enumerate(samples)], "s string, f boolean")
    listed = set("".join(map(_bare, values)))
    for row in df.select("s", "f", tx.masked(F.col("s"), values, F.col("f")).alias("m")).collect():
        shown = row["m"][4:]
        assert row["m"].startswith("****") and row["s"].endswith(shown) and len(shown) <= min(4, len(row["s"]) // 2)
        assert not set(_bare(shown)) & listed and not (row["f"] and shown)
        if not shown and not row["f"] and len(row["s"]) > 1:
            tail = row["s"][-min(4, len(row["s"]) // 2) :]
            plain = tx._normal(tail)
            assert set(_bare(tail)) & listed or set(plain) & listed or any(set(_bare(c)) & listed for c in tail) or any(_bare(v) in _bare(row["s"]) or _bare(v) in tx._normal(row["s"]) for v in values)


def test_folds(spark):
    rows = ["ᾀ", "ıI", "ＡÉ9٣", "93Ж8", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", tx.wide_any(F.col("t")).alias("w")).collect()
    for r in got:
        assert r["w"] == (None if rows[r["i"]] is None else _bare(rows[r["i"]]))
    assert spark.range(1).select(tx.latin(F.lit("a—“b”\n🂡")).alias("x")).first()["x"] == 'a--"b"\\u{000A}\\u{1F0A1}'


def test_tiers(spark):
    rules = Rules((Rule("v", "value", "secret99"), Rule("p", "pattern", r"REF-\d{4}", "m"), Rule("mail", "class", "email")))
    pages = [
        (1, 1, "a secret 99 here"), (2, 1, "its secret"), (2, 2, "99 on"), (3, 1, "its secret\n99 on"), (4, 1, "a se"), (4, 2, "cr"), (4, 3, "et99"),
        (5, 1, "REF-12\n34 REF-1234"), (6, 1, "REF-\n1234"), (7, 1, "x REF"), (7, 2, "-1234"), (8, 1, "write a.b@c.org"), (9, 1, " "), (9, 2, None), (11, 1, "secret 99"), (11, 2, "REF-1234"),
    ]
    df = spark.createDataFrame(pages, "doc_id long, page int, text string")
    everyone = spark.createDataFrame([(10,)], "doc_id long")
    got = vf.verify(df, rules, documents=everyone)
    exits = {r["doc_id"]: r["exit_code"] for r in got.verdicts.collect()}
    assert exits == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1, 6: 2, 7: 0, 8: 0, 9: 2, 10: 2, 11: 1}
    assert {(r["doc_id"], r["code"]) for r in got.warnings.collect()} == {(3, "REVIEW_CROSS_LINE"), (4, "REVIEW_CROSS_PAGE"), (6, "REVIEW_FUSED_PATTERN"), (9, "EMPTY_DOCUMENT"), (10, "EMPTY_DOCUMENT")}
    assert [(r["doc_id"], r["rule"], r["sample"]) for r in got.notices.collect()] == [(8, "mail", "****")]  # r is a character of the value
    assert {r["doc_id"]: r["exit_code"] for r in vf.verify(df, rules, strict_classes=True).verdicts.collect()}[8] == 1
    fast = vf.verify(df, rules, fail_fast=True)
    assert {(r["doc_id"], r["rule"]) for r in fast.findings.where("doc_id = 11").collect()} == {(11, "v")}
    assert fast.warnings.where("code = 'SKIPPED_FAIL_FAST'").select("doc_id").distinct().count() == 1
    assert vf.verify(df.limit(0), rules).verdicts.count() == 0


def test_patterns_across_pages(spark):
    rules = [Rule("w", "pattern", r"one\ntwo", "m"), Rule("far", "pattern", r"x{3}\ny", "m")]
    pages = [(1, 1, "at one"), (1, 2, "two"), (2, 1, "at one"), (2, 3, "two"), (3, 1, "one\ntwo"), (4, 1, "xxx"), (4, 2, None), (4, 3, "y")]
    df = spark.createDataFrame(pages, "doc_id long, page int, text string")
    none = df.select("doc_id", F.lit("z").alias("rule")).limit(0)
    assert {(r["doc_id"], r["rule"]) for r in vf.cross_page_patterns(df, rules, none).collect()} == {(1, "w"), (2, "w"), (3, "w")}


def test_chunks_lose_no_value(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, norm string")
    value = spark.createDataFrame([("v", "abba")], "rule string, value string")
    got = {x["i"] for x in mt.containing(mt.chunks(df, "norm", 5, 3), value).select("i").collect()}
    assert got == {i for i, t in enumerate(texts) if "abba" in t}


def test_uses_and_members(spark):
    paths = ["Root", "Resources/Font", "A/Resources/Font/F1", "X/Kids/Parent", "", "Font"]
    got = [r["u"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(st.use_kind(F.split("p", "/")).alias("u")).collect()]
    assert got == ["root", "font", "font", "pages", "other", "other"]


def test_headline_order(spark):
    rows = [(i, *[bool(i >> b & 1) for b in range(7)], e, c) for i in range(128) for e in (0, 1, 2) for c in (0, 2)]
    df = spark.createDataFrame(rows, "i int, v boolean, n boolean, p boolean, l boolean, x boolean, j boolean, o boolean, e int, c int")
    for r in df.withColumn("h", rv.headline_row(*map(F.col, ("v", "n", "p", "l", "x", "e", "j", "c", "o")))).collect():
        want = 1 if r.v else 2 if r.n or r.p or r.l else 3 if r.x else 4 if r.e == 1 else 5 if r.e == 2 and r.c and r.o else 6 if r.e == 2 and r.j and not r.c else 7 if r.e == 0 else 8
        assert r.h == want


def test_reading_a_file_is_linear_in_its_objects():
    body, places = bytearray(b"%PDF-1.4\n"), []
    for n in range(1, 20001):
        places.append(len(body))
        body += f"{n} 0 obj\n<< /A ({n}) /B {n} 0 R >>\nendobj\n".encode()
    at = len(body)
    body += b"xref\n0 20001\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer\n<< /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % at
    rows = pdf_file.read(bytes(body))  # with a map for each object this would take minutes
    assert sum(r["kind"] == "object" for r in rows) == 20000


def test_objects_freed_and_written_again(spark):
    files = spark.createDataFrame([("1", checks.small_pdf(1, "name", "part"))], "path string, content binary")
    units = {(r["num"], r["storage"], r["unit"]): r["text"] for r in pdf_file.units(pdf_file.objects(files)).where("num is not null").collect()}
    assert units[(5, "superseded", "values")] == "note of 1" and units[(6, "live", "shown")] == "part" and (6, "superseded", "shown") not in units
    assert units[(4, "superseded", "patterns")] == "name" and units[(4, "live", "values")] == "name again"


def test_class_samples_hide_by_what_they_show(spark, tmp_path):
    mails = ["une.92@mail6.example.com", "rue.46@mail.example.com", "x.y@host.edu", "a@b.at", "a@c.be"]
    docs = [(i, t, "fr", "s") for i, t in enumerate(["write to " + m + ", soon" for m in mails] + ["call 212-555-0123", "call 212-555-0178", None])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["sample"] for r in checks.masked_samples(spark, str(tmp_path)).collect()}
    assert got == {0: "****.com", 1: "****.com", 2: "****", 3: "****.at", 4: "****", 5: "****0123", 6: "****0178"}
    # the operator reads the sample itself: one that holds a listed value shows nothing
    whole = spark.createDataFrame([(m,) for m in mails], "m string").select(tx.masked(F.col("m"), checks.LISTED)).collect()
    assert [r[0] for r in whole] == ["****", "****", "****", "****.at", "****"]
