"""Each operator against a plain version of itself, with null, empty, long, repeated and clashing input."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from clearveil.llm import bpe_count, decontaminate, gif, html_extract, kernel, near_dedup, packing, ppm, quality, substring_dedup, toxicity
from clearveil.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = "_grp int, _row long, _id string, _w array<string>, _hash binary, length int, score double"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 6))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 90))) for _ in range(n)]
    for i in range(0, n, 5):  # passages, near and exact copies
        texts[i] = texts[i] + "\n" + " ".join(texts[(i + 1) % n].split()[:40])
        texts[(i + 3) % n] = texts[(i + 2) % n]
    long = " ".join(r.choice(words) for _ in range(6000))
    texts += ["", " \t\n ", "one", "one", long, long + " end", "A b\x0bC d \x1ce", "<|endoftext|> x", "same " * 300]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return rows + [(500, None, None, None, None), (None, texts[1], None, None, None), (3, texts[3], "en", "s", 1)]


def clash(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", ["y"], b"z", 3, 0.5) for r in rows], f"{SCHEMA}, {CLASHING}")


@pytest.fixture(scope="module")
def docs(spark):
    return clash(spark, corpus())


@pytest.fixture(scope="module")
def nothing(spark):
    return clash(spark, [])


def test_substring_dedup(docs, nothing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - 12):
            if i is not None:
                first[tuple(w[p : p + 13])] = min(i, first.get(tuple(w[p : p + 13]), i))
    want = Counter()
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(map(tuple, substring_dedup.mark_repeats(docs).collect())) == want
    assert substring_dedup.mark_repeats(nothing).count() == 0
    kept = substring_dedup.mark_repeats(docs, keep=("lang", "n_chars"), kept_text=True).where("doc_id = 500").first()
    assert kept["kept_text"] is None and kept["kept"]["lang"] is None


def test_decontamination(spark, docs, nothing):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(1, texts[7]), (2, "one"), (3, ""), (4, None), (5, " ".join((texts[64] or "").split()[100:130])), (6, "A b"), (7, texts[7])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[p : p + 10])].add(str(i))
    want = Counter()
    for r in docs.collect():
        w, hit, ids = split(r["text"]), set(), set()
        for k, own in windows.items():
            for p in range(len(w) - len(k) + 1):
                if tuple(w[p : p + len(k)]) == k:
                    hit |= set(range(p, p + len(k)))
                    ids |= own
        want[(r["doc_id"], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    assert Counter(map(tuple, decontaminate.contaminated(docs, bench).collect())) == want
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert not decontaminate.contaminated(docs, bench.limit(0)).where("contaminated").count()
    assert decontaminate.clean(docs, bench).count() == sum(n for k, n in want.items() if not k[5])


def test_decontamination_runs_no_python(docs, spark):
    plan = decontaminate.contaminated(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def shingles(t):
    w = (t or "").split()
    return Counter(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates(spark, docs, nothing, monkeypatch):
    r = random.Random(9)
    base = [f"w{r.randrange(999)}" for _ in range(120)]
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    for i in range(40):  # a family with links between some members only
        w = list(base)
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    all_ = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = sum((sets[a] & sets[b]).values())
            if both and both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in sets}
    for few, block in ((4, 256), (0, 8)):  # pairs, and blocks
        monkeypatch.setattr(near_dedup, "_FEW", few)
        monkeypatch.setattr(near_dedup, "_BLOCK", block)
        got = near_dedup.near_duplicates(all_).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) - {None} == {want[i] for i in want if i < 1000}


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(4)
    e = r.integers(0, 1 << 62, 300).astype(np.uint64)
    w1, w2 = r.integers(1, 4, 300), r.integers(1, 4, 300)
    s1 = near_dedup.signatures(np.zeros(300, int), e, w1, 1, 2048)
    s2 = near_dedup.signatures(np.zeros(300, int), e, w2, 1, 2048)
    assert abs((s1 == s2).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.05


def test_packing(docs, nothing):
    path = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    got = packing.packed(docs, path, capacity=256).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (a, n) in enumerate(packing.cut(len(ids), 256)):
            want[(r["doc_id"], k, a, n, zlib.crc32(ids[a : a + n].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 256) + 2
    assert packing.packed(nothing, path).count() == 0
    assert packing.cut(4100, 2048) == [(0, 4), (4, 2048), (2052, 2048)]


def test_packing_plans_hold_every_piece():
    r = random.Random(1)
    for over in (0.5, 0.2, 0.1):
        h = {n: r.randrange(1, 400) for n in r.sample(range(1, 101), 60)}
        runs = packing.plan(h, 100, 8, over)
        held = defaultdict(list)
        for run in runs:
            assert run.room >= 0 and run.room + sum(n * k for n, k, _ in run.content) == 100
            for n, k, rank in run.content:
                held[n] += range(rank, rank + k * run.count)
        assert {n: sorted(v) for n, v in held.items()} == {n: list(range(c)) for n, c in h.items()}
        plain = packing._Rooms()
        packing.best_fit(plain, [[n, c, 0] for n, c in h.items()], 100)
        assert sum(x.count for x in runs) <= 1.1 * sum(x.count for x in plain.all()) + 2


def test_packing_lets_large_lengths_share_sequences():
    h = {983: 1200, 532: 2400}
    count = lambda runs: sum(x.count for x in runs)
    assert count(packing.plan(h)) == 1400
    runs = packing.best_plan(h)
    assert count(runs) == 1200
    for n, c in h.items():
        assert sorted(i for x in runs for m, k, rank in x.content if m == n for i in range(rank, rank + k * x.count)) == list(range(c))
    r = random.Random(3)
    for _ in range(3):
        h = {n: r.randrange(1, 300) for n in r.sample(range(1, 257), 60)}
        assert count(packing.best_plan(h, 256, 16)) <= min(count(packing.plan(h, 256, 16, over)) for over in packing.LARGE_OVERS)


def test_token_counts(docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    for r, x in zip(bpe_count.token_counts(docs, path).collect(), docs.collect()):
        n = len(own.encode(x["text"] or "", add_special_tokens=False).ids)
        assert tuple(r) == (x["doc_id"], len((x["text"] or "").encode()), n, n > 2048)
    assert bpe_count.token_counts(nothing, path).count() == 0
    count = bpe_count.Counter(path, remembered=5).count
    for t in ("ΣΑΣ ΌΔΟΣ", "don't I'LL 123", "é́ ﬁ İ", "a\x1cb", "<|startoftext|><|endoftext|>", "x" * 500):
        assert count(t) == len(own.encode(t, add_special_tokens=False).ids)


def test_lm_scoring(docs, nothing):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    order, trie, counts = 3, defaultdict(Counter), Counter()
    stream = lambda t: b"\xff" * order + low(t).encode() + b"\xff"
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
            s = stream(t)
            for p in range(order, len(s)):
                for j in range(order + 1):
                    trie[s[p - j : p]][s[p]] += 1
    n, v = sum(counts.values()), len(counts)

    def model(t):
        s, total = stream(t), 0.0
        for p in range(order, len(s)):
            gone = set()
            for j in range(order, -1, -1):
                c = trie.get(s[p - j : p])
                if not c:
                    continue
                left = {k: x for k, x in c.items() if k not in gone}
                m, d = sum(left.values()), len(left)
                if s[p] in left:
                    total += math.log10(left[s[p]] / (m + d))
                    break
                if d:
                    total += math.log10(d / (m + d))
                gone |= c.keys()
            else:
                total -= math.log10(256 - len(gone))
        return total

    got = {(r["doc_id"], r["n_tokens"], r["base_score"]): r for r in ppm.scored(docs, order=order).collect()}
    by_id = {r["doc_id"]: r for r in got.values()}
    for i, t in rows:
        r, w = by_id[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] == pytest.approx(model(t), rel=1e-4)
    assert ppm.scored(nothing).count() == 0


def test_lm_scoring_keeps_rare_grams(spark):
    """More grams that occur once than a trie on the driver could keep: none is left out."""
    r = random.Random(5)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    others = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 != 2][:10]
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=60000)) for _ in others]
    grams, followed = Counter(), defaultdict(set)
    for t in texts:
        s = "^" * 5 + t + "$"
        grams.update(s[i : i + 6] for i in range(len(s) - 5))
    assert len(grams) > 1 << 19
    total = Counter()
    for g, n in grams.items():
        total[g[:5]] += n
        followed[g[:5]].add(g[5])
    s = "^" * 5 + texts[0] + "$"
    want = sum(math.log10(grams[g] / (total[g[:5]] + len(followed[g[:5]]))) for g in (s[i : i + 6] for i in range(len(s) - 5)))
    rows = [(held, texts[0]), *zip(others, texts)]
    got = ppm.scored(spark.createDataFrame(rows, "doc_id long, text string")).where(f"doc_id = {held}").first()
    assert got["held_out"] and got["score"] == pytest.approx(want, rel=1e-4)


def test_adaptive_coder_learns():
    r = random.Random(0)
    assert ppm.adaptive_bits("abcabcabc" * 30) < ppm.adaptive_bits("".join(r.choice("abc") for _ in range(270)))


def test_toxicity(spark, docs, nothing):
    r = random.Random(2)
    plain = [f"w{i}" for i in range(60)]
    sentence = lambda bad: " ".join([*(r.choice(plain) for _ in range(8)), *(["vile"] if bad else [])]) + "."
    rows = [(i, " ".join(sentence(i % 4 == 0 and k == 2) for k in range(6))) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 and i < 400 else 0) for i, _ in rows] + [(None, 1), (5, None), (12345, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {x["doc_id"]: x for x in toxicity.scored(df, model).collect()}
    unseen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in unseen) >= 0.97 * len(unseen)
    assert got[900]["score"] == got[901]["score"] == 0.0 and got[900]["worst_start"] is None
    text = dict(rows)
    for i in (4, 8):
        assert "vile" in text[i].encode()[got[i]["worst_start"] : got[i]["worst_end"]].decode()
    assert toxicity.offending_sentences(df, model).where("doc_id in (1, 2, 3)").count() == 0
    assert toxicity.without_toxic(df, model).count() == sum(not x["predicted"] for x in got.values())
    assert toxicity.scored(nothing, model).count() == 0 and toxicity.scored(docs, model).count() == docs.count()
    assert toxicity.scored(df, toxicity.train(df, labels.limit(0))).where("score > 0").count() == 0


def test_quality(spark, docs, nothing):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    good = [" ".join(r.choice(words) for _ in range(80)) + "." for _ in range(150)]
    bad = [" ".join(w + r.choice(["###", "%%%"]) for w in t.split()) for t in good[:15]] + [("word " * 90) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(good + bad)) + [(900, None), (901, "")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in quality.classified(df).collect()}
    assert sum(got[i]["keep"] for i in range(150)) >= 147
    assert sum(got[150 + i]["keep"] for i in range(25)) <= 2
    assert got[900]["posterior"] < 0.5 and got[901]["posterior"] < 0.5
    assert quality.classified(nothing).count() == 0 and quality.classified(docs).count() == docs.count()


def test_html_extraction(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site, the best.</h1></header><nav><ul><li><a href="x">Home</a></ul></nav>'
        '<div class="cookie-notice"><p>We use cookies, sorry. Accept, please.</p></div><article><h1>Head &amp; line</h1><p><b>First,  paragraph\n here.<br><p>Second; with <a href="y">a link</a>, and &eacute;.</p><p>Sh.</p>'
        '<form><p>Sign up, now, please.</p></form><div class="comments"><p>Nice post, really. I liked it, a lot.</p></div></article><aside><p>Other, things. To read, too.</p></aside><footer>&copy; x. All rights, reserved.</footer></body></html>'
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>Only, this.</p>"), (4, "u", "<script>x</script>"), (5, "u", "<p>open <b>bold &lt;x&gt;"), (5, "u", "<p>open <b>bold &lt;x&gt;")]
    got = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = [r["text"] for r in got]
    assert texts == ["Head & line\nFirst, paragraph here.\nSecond; with a link, and é.\nSh.", "", "", "Only, this.", "", "open bold <x>", "open bold <x>"]
    assert [r["n_chars"] for r in got] == [len(t) for t in texts]


def test_html_extraction_keeps_all_content_paths():
    lead, last = ("The lead, in short; with marks. " * 10).strip(), ("In the end, so it was. " * 13).strip()
    for n in (3, 100):  # what is kept must not depend on the length of the body
        body = [("A sentence, and another one. " * 4).strip() for _ in range(n)]
        page = f"<body><div><p>{lead}</p><div>" + "".join(f"<p>{t}</p>" for t in body) + f"</div><p>{last}</p></div></body>"
        assert html_extract.main_text(page) == "\n".join([lead, *body, last])


def test_html_extraction_of_any_markup():
    text = html_extract.main_text
    assert text("<p>Hello, you. Yes.<![foo[b]]> more<![ foo> end.</p>") == "Hello, you. Yes. more end."
    assert text("<p>a\u2003\u2003b\u00a0 c</p>") == "a b c"
    said = "Main text, it is here. More of it, too."
    for wrapper in ('class="layout has-sidebar"', 'class="post comments-open"', 'id="discussion"'):
        assert text(f"<div {wrapper}><p>{said}</p></div>") == said
    assert text(f'<div class="sidebar"><h1>Title, of it</h1><p>{said}</p></div>') == f"Title, of it\n{said}"
    long = "Words, and more. " * 9
    assert text(f'<article><p>{long}</p><section id="discussion"><p>{long}</p></section><ul class="comment-list"><li>{long}</li></ul></article>') == f"{long.strip()}\n{long.strip()}"
    assert text("<p>Kept, this.</p><!-- never ends <p>lost.</p>") == "Kept, this."
    assert text('<p>Kept, this.</p><a href="never ends>lost.</p>') == "Kept, this."
    began = time.time()
    pages = ["<div>" * 20000 + said + "</div>" * 20000, "".join(f"<div>Text, {i}." for i in range(20000)), "<!--" * 100000, "<a " * 100000, "<script>" * 50000, "<i class=x>" * 20000 + "</i>" * 20000, "<div>" * 5000 + "</x></p></li>" * 5000]
    assert [len(text(x)) > 0 for x in pages] == [True, True] + [False] * 5
    assert time.time() - began < 30  # quadratic work would take minutes


def plain_main_text(html):
    """The scores by plain loops over a tree of another reader."""
    blocks, stack, marks = [], [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            stack.append((tag, any(k == "class" and v == "ad" for k, v in attrs)))

        def handle_endtag(self, tag):
            stack.pop()

        def handle_data(self, data):
            if data.strip():
                blocks.append((tuple(t for t, _ in stack), any(m for _, m in stack), " ".join(data.split())))

    Reader().feed(html)
    keys = list(dict.fromkeys((p, m) for p, m, _ in blocks))
    text, punctuation, amount = [], [], []
    for k in keys:
        own = [t for p, m, t in blocks if (p, m) == k]
        n = 0 if k[1] else sum(map(len, own))
        amount.append(n)
        text.append(n / len(own))
        punctuation.append(0 if k[1] else sum(c in ",.;:!?" for t in own for c in t) / len(own))
    smooth = lambda x: [(v + (x[i - 1] if i else 0) / 3 + (x[i + 1] if i + 1 < len(x) else 0) / 3) * 3 / 5 for i, v in enumerate(x)] if len(x) > 1 else x
    fused = [0 if k[1] else a * (1 + b) * math.log1p(c) for k, a, b, c in zip(keys, smooth(text), smooth(punctuation), amount)]
    score = {}
    for k, s in zip(keys, fused):
        kin = [f for (p, _), f in zip(keys, fused) if len(p) <= len(k[0]) and k[0][: len(p) - 1] == p[:-1]]
        score[k] = 0 if k[1] else max(s, 0.5 * max(kin))
    best = max(score.values(), default=0)
    return "\n".join(t for p, m, t in blocks if best and score[p, m] >= 0.1 * best)


def test_html_extraction_against_plain_loops():
    r = random.Random(8)

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return " ".join(r.choice(["one", "two,", "three.", "four"]) for _ in range(r.choice([1, 3, 8, 60])))
        return "".join(f"<{t}{' class=ad' if r.random() < 0.1 else ''}>{tree(depth - 1)}</{t}>" for t in r.choices(["div", "section", "blockquote"], k=r.randrange(1, 4)))

    for _ in range(300):
        page = f"<html><body><article>one, two.</article>{tree(4)}</body></html>"
        assert html_extract.main_text(page) == plain_main_text(page)


def thue_morse(k):
    t = "a"
    for _ in range(k):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_hashes_hold_on_words_that_defeat_polynomials(spark):
    a, b = thue_morse(11)
    rows = [(1, f"p q r s t u {a} v w x y z k"), (2, f"p q r s t u {b} v w x y z k")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.mark_repeats(df).orderBy("doc_id").collect()] == [0, 0]
    assert {r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == {1, 2}
    seq_a, seq_b = (" ".join(x) for x in (a, b))
    df = spark.createDataFrame([(1, seq_a), (2, seq_b)], "doc_id long, text string")
    w = [x.split() for x in (seq_a, seq_b)]
    first = {tuple(w[0][p : p + 13]) for p in range(len(w[0]) - 12)}
    gone = {p + k for p in range(len(w[1]) - 12) if tuple(w[1][p : p + 13]) in first for k in range(13)}
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.mark_repeats(df).collect()}
    assert got == {1: 0, 2: len(gone)}
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    df = spark.createDataFrame([(next(i for i in range(60) if i not in held), a), (held[0], b)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_known"] for r in ppm.scored(df).collect()}[held[0]] == 1  # its end alone


def test_span_and_window_hashes():
    r = random.Random(2)
    words = ["".join(r.choice("ab") for _ in range(r.choice([1, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(3000)]
    t = next(kernel.slices(pa.array([" ".join(words)])))
    h, _, _, _ = kernel.word_hashes(t)
    of = {}
    assert all(of.setdefault(w, x) == x for w, x in zip(words, h.tolist())) and len(set(of.values())) == len(of)
    for k in (1, 2, 3, 5, 7, 13, 16):
        for second in (False, True):
            small = np.array([of[words[i % 3]] for i in range(40)], np.uint64)
            got = kernel.rolling(small, k, second).tolist()
            assert len(got) == 41 - k and all((got[i] == got[j]) == (i % 3 == j % 3) for i in range(len(got)) for j in range(len(got)) if k > 1 or True)
    assert not set(kernel.rolling(h, 13).tolist()) & set(kernel.rolling(h, 13, True).tolist())


def test_packing_reads_any_white_space(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    own, mine = Tokenizer.from_file(path), packing.Encoder(path)
    r = random.Random(5)
    odd = ["", " ", "  ", "a  b", "x\x1c y", "a\x00 b", "<|endoftext|> x", "a <|endoftext|>", "\u0085 a"]
    odd += ["".join(r.choice([" ", "\n", "a", "é", "\x1c", "1", "!", "'s", "\t", "\u3000", "<|endoftext|>", "\0"]) for _ in range(r.randrange(1, 14))) for _ in range(2000)]
    mine.REMEMBERED = 50
    for t in odd:
        assert mine.ids(t).tolist() == own.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, " " * 10**6), (2, "x" + "\n" * 300000)], "doc_id long, text string")
    got = packing.packed(df, path).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in ((1, " " * 10**6), (2, "x" + "\n" * 300000))}


def test_toxicity_against_plain_loops(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["Bad", "vile", "good", "né", "a1", "longerword"]) + r.choice(["", ".", "!\n", ","]) for _ in range(r.randrange(0, 40))) for _ in range(60)]
    labels = [int("vile" in t.lower()) for t in texts]
    model = toxicity.fit(texts, labels)
    hashed = lambda w: int(kernel.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    mask = (1 << toxicity.BITS) - 1
    for t, row in zip(texts, toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()):
        none = 1.0
        for sentence in re.split(rb"[\n!.?]", t.encode().lower()):
            words = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", sentence)
            at = [hashed(w) & mask for w in words] + [(hashed(w[:n]) ^ (n * 0x51ED27)) & mask for w in words for n in toxicity.PREFIXES if len(w) > n]
            if any(model.known[i] for i in at):
                none *= 1 - 1 / (1 + math.exp(-float(sum(model.weights[i] for i in at)) - model.bias))
        assert row["score"] == pytest.approx(1 - none, abs=1e-5)


def test_toxicity_sample_is_bounded_whatever_the_texts_length(spark):
    long = "x " * 200000
    rows = [(i, ("vile " if i % 2 else "") + (long if i < 10 else "short one.")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 0), (3, 0)], "doc_id long, toxic int")
    seen = []
    real, toxicity.fit = toxicity.fit, lambda texts, y: seen.append((texts, y)) or real(texts, y)
    try:
        model = toxicity.train(df, labels, hold_out=False)
        assert len(seen[0][0]) == 200 and sum(seen[0][1]) == 100 and any(len(t) > 65536 for t in seen[0][0])  # both labels: toxic
        toxicity.train(df, labels, hold_out=False, train_bytes=3 * len(long))
    finally:
        toxicity.fit = real
    assert sum(len(t) for t in seen[1][0]) <= 6 * len(long) and any(len(t) > 65536 for t in seen[1][0])
    assert {r["doc_id"] % 2 for r in toxicity.scored(df, model).where("predicted = 1").collect()} == {1}


def test_quality_against_plain_loops(spark):
    r = random.Random(6)
    words = ["word", "Two", "LOUD", "a#", "b!", "é", "longerwordthanothers", "x|", "the"]
    texts = [" ".join(r.choices(words, k=r.randrange(0, 60))) for _ in range(80)] + ["the " * 50, "z" * 500]

    def plain(t):
        b, ws, n = t.encode(), t.encode().lower().split(), len(t.split())
        runs = [x == y for x, y in zip(ws, ws[1:])]
        count = lambda f: sum(map(f, b))
        mark = lambda c: chr(c) in "#$%&*+<=>@[\\]^_`{|}~!"
        small, letters = count(lambda c: 97 <= c <= 122 or c >= 128), max(1, count(lambda c: 65 <= c <= 90 or 97 <= c <= 122))
        good = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or chr(c) in "\t\n\x0b\x0c\r \"'(),-./0123456789:;?"
        rising = lambda x, lo, hi: -1 if x >= hi else 1 if x <= lo else 0
        size, least = max(1, len(b)), max(1, n)
        top, mean = max(Counter(ws).values(), default=0), sum(map(len, ws)) / least
        v = [
            rising(count(mark) / size, 0.01, 0.03), rising(sum(mark(w[-1]) for w in ws) / least, 0.03, 0.12), rising(count(lambda c: not good(c)) / size, 0.02, 0.05),
            rising(1 - small / size, 0.3, 0.45), rising(count(lambda c: 65 <= c <= 90) / letters, 0.15, 0.5), rising(count(lambda c: c == 33) / least, 0.02, 0.15),
            -rising(len(set(ws)) / min(least, 6 * least**0.7), 0.35, 0.55), rising(sum(runs) / least, 0.05, 0.15), rising(top / least, 0.12, 0.2), -1 if mean > 20 else 1 if 3 < mean < 10 else 0,
        ]
        return [-1] * 10 if n == 0 else [0] * 10 if n < 5 else [min(x, 0) for x in v] if n < 20 else v

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.classified(df).orderBy("doc_id").collect()
    votes = [plain(t) for t in texts]
    assert [[r[f"v_{n}"] for n in quality.LABELLERS] for r in got] == votes
    # the label model by plain loops
    m, belief = 10, 0.2
    post = [0.05 if min(v) < 0 else 0.95 for v in votes]
    prior = [[0.45, 0.55], [0.01, 0.99]]
    for _ in range(200):
        share = min(max(sum(post) / len(post), 1e-3), 1 - 1e-3)
        p = []
        for c in (0, 1):
            w = [q if c else 1 - q for q in post]
            rows = [[sum(x for x, v in zip(w, votes) if v[k] == side) + prior[c][j] * (belief * len(votes) + 1) for j, side in enumerate((-1, 1))] for k in range(m)]
            p.append([[a / (a + b), b / (a + b)] for a, b in rows])
        odds = [math.log(share / (1 - share)) + sum(math.log(p[1][k][(x + 1) // 2] / p[0][k][(x + 1) // 2]) for k, x in enumerate(v) if x) for v in votes]
        new = [1 / (1 + math.exp(-o)) for o in odds]
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        post = new
        if done:
            break
    assert [r["posterior"] for r in got] == pytest.approx(post, abs=1e-6)


def test_gif_text(docs, nothing):
    for r, x in zip(gif.text_media(docs, with_media=True).collect(), docs.collect()):
        raw = (x["text"] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (x["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert gif.restore(gif.decode(bytes(r["media"]))) == payload
    assert gif.text_media(nothing).count() == 0


def test_gif_frames_as_rows(spark):
    a = gif.Frame(0, 0, np.full((2, 4), 10), gif.GREY, None, 1, 5)
    b = gif.Frame(0, 0, np.array([[200, 10, 0, 0]]), gif.GREY, 0, 2, 7)  # two pixels are transparent
    c = gif.Frame(3, 1, np.array([[200]]), gif.GREY, None, 1, 1)
    media = gif.encode([a, b, c], 4, 2, gif.GREY)
    rows = gif.media_frames(spark.createDataFrame([(1, media), (2, None)], "doc_id long, media binary"), bins=2).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 5, [8, 0]), (1, 1, 5, 7, [7, 1]), (1, 2, 12, 1, [3, 1])]
    assert gif.feature(gif.decode(media), 2).endswith("grey=900,100")


def test_gif_frames():
    r = np.random.default_rng(0)
    palette = r.integers(0, 256, (8, 3)).astype(np.uint8)
    own = r.integers(0, 256, (4, 3)).astype(np.uint8)
    a = gif.Frame(0, 0, r.integers(0, 8, (9, 7)), palette, None, 1, 5)
    b = gif.Frame(2, 3, r.integers(0, 4, (4, 5)), own, 1, 2, 7)
    c = gif.Frame(1, 1, r.integers(0, 8, (2, 2)), palette, None, 3, 1)
    got = gif.decode(gif.encode([a, b, c, b], 7, 9, palette, loops=3))
    assert got.loops == 3 and [f.delay for f in got.frames] == [5, 7, 1, 7]
    for f, g in zip((a, b, c, b), got.frames):
        assert (f.indices == g.indices).all() and (f.palette == g.palette).all() and (f.transparent, f.disposal) == (g.transparent, g.disposal)
    shown = list(gif.composed(got))
    assert [t for t, _, _ in shown] == [0, 5, 12, 13]
    assert (shown[0][1] == palette[a.indices]).all()
    box, clear = shown[1][1][3:7, 2:7], b.indices == 1
    assert (box[~clear] == own[b.indices][~clear]).all() and (box[clear] == palette[a.indices][3:7, 2:7][clear]).all()
    assert not shown[2][2][3:7, 2:7].any()  # restored to background
    with pytest.raises(gif.GifError):
        gif.decode(gif.encode([a], 7, 9, palette)[:-9])
    for n in (0, 1, 4095, 70000):
        data = r.integers(0, 3, n).astype(np.uint8).tobytes()
        assert gif.lzw_decode(gif.pack_codes(*gif.lzw_codes(data, 2)), 2, n) == data


def test_lzw_full_table_without_clear():
    """A writer may go on with 12 bits a code when the table is full; codes past the last entry are refused."""
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 9000, dtype=np.uint8).tobytes()
    codes, widths = gif.lzw_codes(data, 8)
    full = codes.index(256, 1)
    head = gif.lzw_decode(gif.pack_codes([*codes[:full], 257], [*widths[:full], 12]), 8, full - 1)
    tail = r.integers(0, 256, 10000, dtype=np.uint8).tobytes()
    media = gif.pack_codes([*codes[:full], *tail, 4095, 257], [*widths[:full], *[12] * (len(tail) + 2)])
    got = gif.lzw_decode(media, 8, full - 1 + len(tail))
    assert got.startswith(head) and data.startswith(head)
    whole = gif.lzw_decode(gif.pack_codes([*codes[:full], 257], [*widths[:full], 12]), 8, len(head))
    assert whole == head and tail[:5000] in got
    with pytest.raises(gif.GifError):
        gif.lzw_decode(gif.pack_codes([256, 7, 300, 257], [9, 9, 9, 9]), 8, 1)
    with pytest.raises(gif.GifError):
        gif.lzw_decode(b"\0" * 9, 9, 1)
