import random

import __spark_entry__
from clearveil.operators import evaluation as ev
from clearveil.operators import findings as fd
from clearveil.operators import structure as st


def test_tiling_equals_a_byte_map(spark):
    r = random.Random(5)
    claims = [(d, o, s, s + r.randrange(0, 9)) for d in range(20) for o in range(6) for s in [r.randrange(30) for _ in range(1 + d % 3)]]
    claims += claims[:9]  # an owner may claim a range twice, or ranges that overlap or touch
    got = st.tiling(spark.createDataFrame(claims, "d long, o long, s long, e long"), "d", "o", "s", "e").collect()
    for d in range(20):
        own = [{o for x, o, s, e in claims if x == d and s <= b < e} for b in range(45)]
        rows = sorted((x["start"], x["end"], x["kind"], x["owners"]) for x in got if x["d"] == d)
        for start, end, kind, owners in rows:
            assert all(("gap" if not own[b] else "owned" if len(own[b]) == 1 else "contested") == kind for b in range(start, end))
            assert len(set().union(*own[start:end])) == owners
        assert all(a[1] == b[0] and (a[2] != b[2] or a[2] == "owned") for a, b in zip(rows, rows[1:]))
        assert all(own[a[0]] != own[b[0]] for a, b in zip(rows, rows[1:]) if a[2] == b[2])
        assert (rows[0][0], rows[-1][1]) == (min(b for b in range(45) if own[b]), max(b + 1 for b in range(45) if own[b]))


def test_tiling_of_nulls_and_nothing(spark):
    claims = [("a", None, 0, 4), ("a", "x", 2, 6), ("a", "y", 6, 6), (None, "x", 0, 3), ("b", "y", 1, 3), ("b", "y", 3, 5)]
    df = spark.createDataFrame(claims, "d string, o string, s int, e int")
    want = [("a", 0, 2, "gap", 0), ("a", 2, 6, "owned", 1), ("b", 1, 5, "owned", 1)]
    assert sorted(map(tuple, st.tiling(df, "d", "o", "s", "e").collect())) == want
    assert st.tiling(df.limit(0), "d", "o", "s", "e").count() == 0


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 9, 8), (2, 1, 5)], "d long, s long, t long")
    roots = spark.createDataFrame([(1, 1), (2, 7)], "d long, n long")
    assert sorted(map(tuple, st.reachable(edges, roots, "d", "s", "t", "n").collect())) == [(1, 1), (1, 2), (1, 3), (2, 7)]


def test_verdict_has_a_row_for_every_document(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    one, two = docs.where("doc_id = 1"), docs.where("doc_id <= 2")
    assert {r["doc_id"]: r["exit_code"] for r in fd.verdicts(docs, one, two).collect()} == {1: 1, 2: 2, 3: 0}


def test_differential_and_accepted(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    diff = ev.multiset_difference(a, b, ["k"])
    assert {(r["k"], r["change"]) for r in diff.collect()} == {(1, "count"), (2, "removed"), (3, "added"), (None, "removed")}
    listed = spark.createDataFrame([(1,), (7,)], "k int")
    assert {(r["k"], r["status"]) for r in ev.against_accepted(diff.where("k is not null"), listed, ["k"]).collect()} == {(1, "accepted"), (2, "unlisted"), (3, "unlisted"), (7, "stale")}


def test_entry_points(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q)
    assert __spark_entry__.entry(spark).columns == ["doc_id", "n_findings", "n_warnings", "exit_code"]
