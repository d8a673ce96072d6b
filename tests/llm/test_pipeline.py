"""Each stage on a small corpus: its columns, its decisions, and the whole."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from clearveil.llm import toxicity
from clearveil.llm.common import table
from test_operators import SCHEMA, corpus, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [table(spark, SF, "documents")], table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for docs in stages[:-1]:
        assert docs.dtypes == stages[0].dtypes


def test_stages_only_lose_documents(stages):
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert len(ids[1]) < len(ids[0]) and len(ids[-1]) > 0.5 * len(ids[0])


def test_packing_covers_what_is_left(stages):
    last = {(r["doc_id"]) for r in stages[-1].select("doc_id").collect()}
    assert last == {r["doc_id"] for r in stages[-2].select("doc_id").collect()}


def test_run_equals_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1].count()


CLASHING = "n_words int, n_removed int, kept_sha256 string, kept_text string, kept string, `a.b` int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 7, 8, "s", "t", "k", 9) for r in corpus()]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}")


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_stages_pass_on_clashing_columns(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.dtypes == odd.dtypes, name
        assert stage(spark, odd.limit(0), SF).count() == 0
        assert out.where("n_removed = 8 and `a.b` = 9 and kept = 'k'").count() == out.count() > 0
    without = odd.drop("n_chars")
    assert corpus_pipeline.cut_repeats(spark, without, SF).columns == without.columns


def test_stages_against_plain_loops(spark, odd, tmp_path):
    rows = odd.collect()
    words = [re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in rows]
    # repeats
    first = {}
    for r, w in zip(rows, words):
        for p in range(len(w) - 12):
            if r["doc_id"] is not None:
                first[tuple(w[p : p + 13])] = min(r["doc_id"], first.get(tuple(w[p : p + 13]), r["doc_id"]))
    want = Counter()
    for r, w in zip(rows, words):
        gone = {p + k for p in range(len(w) - 12) if r["doc_id"] is not None and first[tuple(w[p : p + 13])] < r["doc_id"] for k in range(13)}
        if not w or len(gone) < len(w):
            left = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else r["text"]
            want[(r["doc_id"], left, r["lang"], r["source"], len(left) if gone else r["n_chars"], *tuple(r)[5:])] += 1
    assert rows_of(corpus_pipeline.cut_repeats(spark, odd, SF)) == want
    # classes of near-duplicates
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows if r["doc_id"] is not None}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = sum((sets[a] & sets[b]).values())
                if both and least[b] < least[a] and both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= 0.8:
                    least[a] = least[b]
        if all(least[least[i]] == least[i] for i in least):
            break
    got = corpus_pipeline.drop_near_duplicates(spark, odd, SF).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(i for i in least if least[i] == i)
    assert sum(r["doc_id"] is None for r in got) == sum(r["doc_id"] is None for r in rows)
    # benchmark
    items = [(1, " ".join(words[7][:30])), (2, "one"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    spans = {tuple(w[p : p + 10]) for _, t in items if (w := split(t)) for p in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[p : p + len(k)]) == k for w in [split(t)] for k in spans for p in range(len(w) - len(k) + 1))
    assert rows_of(corpus_pipeline.drop_contaminated(spark, odd, str(tmp_path))) == Counter(tuple(r) for r in rows if not hit(r["text"]))
    # toxicity: what the operator, which has a test of its own, scores below the threshold stays
    labels = [(i, int(i % 3 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.train(odd, spark.createDataFrame(labels, "doc_id long, toxic int"))
    bad = Counter((r["doc_id"], r["predicted"]) for r in toxicity.scored(odd, model).collect())
    left = Counter(r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, odd, str(tmp_path)).collect())
    assert left == Counter({i: n for (i, p), n in bad.items() if not p})
    # packing: every token has one place, and each sequence is gapless
    at = sorted((r["sequence_id"], r["offset"], r["length"]) for r in corpus_pipeline.pack(spark, odd, SF).collect())
    for (s, o, n), (t, p, _) in zip(at, at[1:]):
        assert p == (o + n if s == t else 0) and o + n <= 2048
