import random
import re
import zlib

from clearveil.functions import pdf
from clearveil.functions import shapes as sh
from clearveil.plans import cases
from pyspark.sql import functions as F


def test_shapes(spark):
    rows = [
        ("ssn", "id ", "123-45-6789", " x", "formatted"), ("ssn", "ab", "123456789", "", "hex-id"), ("ssn", "zq_", "123456789", "", "alnum-id"),
        ("ssn", "", "123456789", "", "bare-digits"), ("us-phone", "", "(212) 555-0187", ",", "formatted"), ("us-phone", "", "1 212 555 0187", "", "formatted"),
        ("us-phone", "", "21 2555-0187 0", "", "number-list"), ("credit-card", "", "4111 1111 1111 1111", "", "formatted"), ("credit-card", "", "3782 822463 10005", "", "formatted"),
        ("credit-card", "", "1700000000000", "", "date-or-time"), ("credit-card", "D:", "20240131101010", "Z", "date-or-time"), ("credit-card", "", "20241331101010", "", "bare-digits"),
        ("us-phone", "00000000-0000-0000-0000-00", "2125550187", "", "uuid"), ("credit-card", "x", "4 1 1 1 1 1 1 1 1 1 1 1 1", "", "alnum-id"), ("us-phone", None, "2125550187", "", None),
    ]
    df = spark.createDataFrame(rows, "c string, b string, m string, a string, want string")
    for name in ("ssn", "us-phone", "credit-card"):
        for r in df.where(F.col("c") == name).withColumn("got", sh.shape(name, F.col("b"), F.col("m"), F.col("a"))).collect():
            assert r["got"] == r["want"], r
    assert spark.range(1).select(sh.shape("email", F.lit("x"), F.lit("a@b.co"), F.lit(""))).first()[0] == "email-address"


def test_place_of_a_match(spark):
    df = spark.createDataFrame([("x91234567890 1234567890 y", "1234567890")], "t string, m string")
    r = df.select(sh.around(F.col("t"), F.col("m")).alias("p")).first()["p"]
    assert (r["before"], r["after"]) == ("x91234567890 ", " y")


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def test_ocr_match_equals_the_definition(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ab12") for _ in range(n))
    rows = [(word(r.randrange(0, 12)), word(r.randrange(0, 16))) for _ in range(200)]
    got = spark.createDataFrame(rows, "v string, t string").select("v", "t", sh.ocr_match(F.col("v"), F.col("t")).alias("m")).collect()
    for v, t, m in got:
        n = len(v)
        best = min(_edits(v, t[i : i + n + k]) for k in (-1, 0, 1) for i in range(max(1, len(t) - n + 2)) if n + k >= 0)
        want = None if not n else "whole" if v in t or (n >= 9 and best <= 1) else "near" if best <= (3 if n >= 6 else 1) else None
        assert m == want, (v, t)
    assert spark.range(1).select(sh.ocr_form(F.lit("S0l Bo|é-x,"))).first()[0] == "5018" + "0é-x"


def test_residues_of_every_item(spark, tmp_path):
    docs = [(1, "see Smith 12-34 and a9-876b"), (2, "smithson 12 34"), (3, None), (4, "LANE lane 0000 98765"), (4, "LANE lane 0000 98765"), (None, "smith 8765")]
    items = [(1, "nothing here"), (2, "John Smith"), (3, "id 1234, 5 Long Lane"), (4, "98 76 5 lane"), (5, None), (6, "")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    every = docs.crossJoin(items.withColumnRenamed("text", "v")).select("doc_id", "item_id", sh.residue(F.col("text"), F.col("v")).alias("piece")).where("piece is not null")
    got = sorted(map(tuple, cases.residues(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(map(tuple, every.collect()), key=str)
    assert (1, 2, "Smith") in got and (1, 3, "1234") in got and got.count((4, 4, "9876")) == 2


def test_residue_and_forms(spark):
    df = spark.createDataFrame([("a12-345b", "999-12-3456"), ("see smith here", "John Smith"), ("smithson", "Smith"), ("", "1234"), ("12 34", "1234")], "t string, v string")
    assert [x[0] for x in df.select(sh.residue(F.col("t"), F.col("v"))).collect()] == ["1234", "smith", None, None, None]
    forms = spark.range(1).select(sh.written_forms(F.lit("a(b"))).first()[0]
    assert set(map(bytes, forms)) == {b"a(b", b"\0a\0(\0b", b"612862", b"006100280062", b"a\\(b"}
    assert [x[0] for x in spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 11, 12, 13, 21, 112)], "n int").select(sh.ordinal(F.col("n"))).collect()] == "1st 2nd 3rd 4th 11th 12th 13th 21st 112th".split()


def _spans(s):
    out, i, open_ = [], 0, []
    while i < len(s):
        if open_:
            if s[i] == "\\":
                i += 2
                continue
            if s[i] == "(":
                open_.append(i)
            elif s[i] == ")":
                a = open_.pop()
                if not open_:
                    out.append((a, i + 1))
        elif s[i] == "(":
            open_.append(i)
        elif m := re.compile(r"<[0-9A-Fa-f\s]+>").match(s, i):
            out.append((i, m.end()))
            i = m.end() - 1
        i += 1
    return out, bool(open_)


def test_string_spans_equal_a_state_machine():
    r = random.Random(1)
    for _ in range(3000):
        s = "".join(r.choice("()\\a<4F> ") for _ in range(r.randrange(25)))
        assert pdf.string_spans(s) == _spans(s), s
    assert pdf.string_spans("(" * 200_000) == ([], True)


def test_strings_content_and_sniffs(spark):
    assert pdf.decode_string(r"(a\(b\051\n\q)") == "a(b)\nq"
    assert pdf.decode_string("<FEFF00e9>") == "é" and pdf.decode_string("<4>") == "@" and pdf.decode_string(r"(\376\377\000A)") == "A"
    c = pdf.scan_content("BT /F1 12 Tf [(12)-3(3-45) <2D>] TJ (x\\)y) Tj ET % (no)\nBT ET BI /W 40 /H 9 ID \x01\x02(( EI (z) '")
    assert c.shown == ["123-45-", "x)y", "z"] and c.text_objects == 1 and c.image_sizes == [(40, 9)]
    assert pdf.unreadable(pdf.scan_content(r"(\000\001\000\002) Tj")) and not pdf.unreadable(pdf.scan_content("(plain) Tj"))
    assert pdf.inflate(zlib.compress(b"a" * 100), 100)[0] == b"a" * 100 and pdf.inflate(zlib.compress(b"a" * 10**6), 1000) == (b"a" * 1000, True)
    assert pdf.inflate(zlib.compress(b"abc" * 50)[:-6], 1000)[1] and pdf.inflate(b"junk", 10) == (b"", True) and pdf.inflate(zlib.compress(b""), 9) == (b"", False)
    df = spark.createDataFrame([("(D:20240101) (12) <33> (4", ), (None,)], "s string").select(pdf.strings(F.col("s")).alias("x"), F.col("s"))
    a, b = df.select("x", pdf.value_text(F.col("x.strings")).alias("v"), pdf.pattern_text(F.col("x.strings")).alias("p")).collect()
    assert (a["v"], a["p"], a["x"]["truncated"]) == ("D:20240101123", "12\n\n3", True) and b["v"] == ""
    data = spark.createDataFrame([(bytearray(b),) for b in (b" %PDF-1.4", b"plain", "é".encode() * 10, "é".encode("latin-1"), bytes(range(128, 256)), b"\xff\xfea\0", b"")], "b binary")
    assert [x[0] for x in data.select(pdf.is_readable(F.col("b"))).collect()] == [False, True, True, True, False, True, True]
    text = spark.createDataFrame([("q 1 0 0 1 0 0 cm /X Do Q",), ("f(x) is n",)], "t string")
    assert [x[0] for x in text.select(pdf.is_content(F.col("t"))).collect()] == [True, False]
    what = data.limit(2).select(pdf.leftover(F.col("b"), F.lit(None), F.lit(None).cast("int"), F.lit(1)).alias("w")).collect()
    assert [x["w"] for x in what] == ["container", "text"]
    assert [tuple(x["c"]["shown"]) for x in spark.createDataFrame([("(a) Tj",), (None,)], "s string").select(pdf.content(F.col("s")).alias("c")).collect()] == [("a",), ()]


def test_readable_streams_of_short_and_signed_texts(spark, tmp_path):
    texts = ["", "a", "A.", "De.", "abcd", "é", "一", "\0", " %PDF-1.4", "Rar!", "PK\x03\x04", "a" * 65535 + "é", "一" * 30000]
    docs = [(3 * i + k, t) for i, t in enumerate([*texts, None]) for k in range(3)] + [(-1, ""), (-2, "De."), (None, ""), (None, "De.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r["doc_id"], r["readable"]) for r in cases.readable_streams(spark, str(tmp_path)).collect()), key=str)
    readable = lambda d, t: None if d is None else d % 3 == 0 or t == "" and (d < 0 or d % 3 == 2)
    assert got == sorted(((d, readable(d, t)) for d, t in docs if t is not None), key=str)
