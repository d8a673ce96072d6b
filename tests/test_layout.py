import random

from clearveil.operators import assignment as asg
from clearveil.operators import layout as lo

GLYPHS = "doc_id int, page int, seq int, char string, x0 double, y0 double, x1 double, y1 double, vertical boolean, width double, height double"


def _glyph(seq, c, x, y, vertical=False, page=1, size=10.0):
    return (1, page, seq, c, float(x), float(y), float(x) + size, float(y) + size, vertical, 200.0, 200.0)


def _read(spark, rows):
    got = lo.readings(spark.createDataFrame(rows, GLYPHS)).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["page"], r["reading"], r["line"])):
        out.setdefault((r["page"], r["reading"]), []).append(r["text"])
    return out


def test_ten_readings(spark):
    rows = [_glyph(i, c, 10 + 10 * i, 20 + (i % 2)) for i, c in enumerate("ab c")]
    rows += [_glyph(10, "x", 10, 60), _glyph(11, "y", 20, 60), _glyph(12, "z", 30, 60), _glyph(13, "q", 90, 60)]  # a wide gap breaks the line
    rows += [_glyph(20 + i, c, 150, 20 + 10 * i, True) for i, c in enumerate("VW")]
    rows += [_glyph(30, "o", 195.1, 20), _glyph(31, "p", 300, 150), _glyph(40, "n", 5, 5, page=2), _glyph(41, None, 5, 5, page=2)]
    got = _read(spark, rows)
    assert got[1, 0] == ["abc", "xyz", "q"] and got[1, 1] == ["VW"] and got[1, 2] == ["WV"]
    assert got[1, 3] == ["o", "p"]
    assert got[1, 4] == ["abc", "xyz", "q"] and got[1, 9] == ["abc", "o", "xyz", "q", "p"]
    assert got[1, 5] == ["VW"] and got[1, 8] == [t[::-1] for t in got[1, 7]]
    assert got[2, 0] == ["n"]


def test_lines_of_jittered_form_digits_stay_together(spark):
    rows = [_glyph(i, c, 10 + 18 * i, 20 + 4 * (i % 2), size=14.0) for i, c in enumerate("123456789")]
    assert _read(spark, rows)[1, 0] == ["123456789"]


def test_covered_images_equal_arithmetic(spark):
    schema = "doc_id int, page int, seq int, kind string, x0 double, y0 double, x1 double, y1 double, opacity double, width double, height double"
    r = random.Random(4)
    rows = []
    for p in range(30):
        for s in range(12):
            x, y = r.uniform(-20, 90), r.uniform(-20, 90)
            rows.append((1, p, s, r.choice(["image", "fill", "fill", "clip"]), x, y, x + r.uniform(-5, 60), y + r.uniform(1, 60), r.choice([None, 1.0, 0.5]), 100.0, 100.0))
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    cut = lambda a, b: (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
    want = {}
    for _, p, s, kind, *b, o, w, h in rows:
        image = cut(b, (0, 0, w, h))
        if kind != "image" or area(image) <= 0:
            continue
        other = [x for x in rows if x[1] == p and x[6] > x[4] and x[7] > x[5]]
        windows = [image] + [c for c in (cut(image, x[4:8]) for x in other if x[3] == "clip") if area(c) > 0]
        want[p, s] = max([0.0] + [area(cut(c, x[4:8])) / area(c) for c in windows for x in other if x[3] == "fill" and x[2] > s and x[8] != 0.5])
    got = {(x["page"], x["seq"]): x["fraction"] for x in lo.covered_images(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_boxes_merge_greedily(spark):
    rows = [(1, "a", 0, 0.0, 0.0, 10.0, 10.0, False), (1, "a", 1, 5.0, 0.0, 15.0, 10.0, True), (1, "a", 2, 40.0, 0.0, 50.0, 9.0, None), (1, "b", 3, 0.0, 0.0, 10.0, 10.0, False)]
    got = lo.merged_boxes(spark.createDataFrame(rows, "page int, label string, n int, x0 double, y0 double, x1 double, y1 double, approx boolean"), ["page", "label"], "n").collect()
    assert sorted((g["label"], g["x0"], g["x1"], g["approx"], g["n"]) for g in got) == [("a", 0.0, 15.0, True, 2), ("a", 40.0, 50.0, False, 1), ("b", 0.0, 10.0, False, 1)]


def _most(wanted, used=frozenset()):
    if not wanted:
        return 0
    (_, rights), rest = wanted[0], wanted[1:]
    return max([_most(rest, used)] + [1 + _most(rest, used | {r}) for r in rights if r not in used])


def test_matching_is_largest_and_one_to_one(spark):
    r = random.Random(9)
    rows = [(f"f{g}", a, b, r.randrange(2)) for g in range(40) for a in range(5) for b in range(5) if r.random() < 0.35]
    rows += [("long", i, j, 0) for i in range(3000) for j in ((i, i + 1) if i < 2999 else (0,))]
    got = {}
    for x in asg.one_to_one(spark.createDataFrame(rows, "f string, l int, r int, p int"), "f", "l", "r", "p").collect():
        got.setdefault(x["f"], {})[x["l"]] = x["r"]
    for f in {x[0] for x in rows}:
        mine = [(a, b) for g, a, b, _ in rows if g == f]
        used = [(a, b) for a, b in got[f].items() if b is not None]
        assert set(got[f]) == {a for a, _ in mine} and set(used) <= set(mine) and len({b for _, b in used}) == len(used)
        if f == "long":
            assert len(used) == 3000
        else:
            assert len(used) == _most([(a, [b for x, b in mine if x == a]) for a in got[f]])


def test_outcomes(spark):
    inst = spark.createDataFrame([("f", 0, 1), ("f", 1, 1), ("f", 2, 2), ("f", 3, 1), ("f", 4, 1)], "f string, l long, expected_exit int")
    units = spark.createDataFrame([("f", 0, True), ("f", 1, False), ("f", 2, False)], "f string, r long, finding boolean")
    cand = spark.createDataFrame([("f", 0, 0, 0), ("f", 1, 1, 0), ("f", 2, 2, 0), ("f", 3, 1, 0)], "f string, l long, r long, p int")
    got = asg.outcomes(inst, asg.one_to_one(cand, "f", "l", "r", "p"), units, "f", "l", "r").collect()
    assert {x["l"]: x["outcome"] for x in got} == {0: "hit", 1: "downgraded", 2: "hit", 3: "ambiguous", 4: "missed"}


def test_groups_that_span_batches(spark):
    r = random.Random(6)
    rows = [(r.randrange(12) or None, "a", i, x, y, x + r.uniform(1, 30), y + r.uniform(1, 30), False) for i in range(300) for x, y in [(r.uniform(0, 60), r.uniform(0, 60))]]
    boxes = spark.createDataFrame(rows, "page int, label string, n int, x0 double, y0 double, x1 double, y1 double, approx boolean")
    whole = sorted(map(str, lo.merged_boxes(boxes, ["page", "label"], "n").collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        assert sorted(map(str, lo.merged_boxes(boxes, ["page", "label"], "n").collect())) == whole
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sum(x["n"] for x in lo.merged_boxes(boxes, ["page", "label"], "n").collect()) == 300
    assert lo.merged_boxes(boxes.where("false"), ["page", "label"], "n").count() == 0
