"""All queries over the driver's tables, by name, with their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearveil.functions import text as tx
from clearveil.operators import evaluation as ev
from clearveil.operators import findings as fd
from clearveil.operators import matching as mt
from clearveil.operators import structure as st

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

CLASSES = ("ssn", "credit-card", "email", "us-phone")
#: Listed values of the page queries (name, normal form).
VALUES = (("v1", "theth"), ("v2", "rethe"), ("v3", "deau"), ("v4", "ungder"), ("v5", "ciondela"), ("v6", "leque"), ("v7", "erthe"))


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL pieces. RE2 has no look-around: runs of a class's characters are cut at every place instead.
_NORM = "regexp_replace(lower(translate(replace({0}, 'ß', 'ss'), '" + tx._ACCENTED + "', '" + tx._BASES + "')), '[^a-z0-9]+', '', 'g')"
_DIGIT_RUN, _MAIL_RUN = r"[0-9\s().+-]{9,}", "[A-Za-z0-9._%+@-]{5,}"
_ONE_SEP = "|".join(rf"[0-9]{{3}}{s}[0-9]{{2}}{s}[0-9]{{4}}" for s in ("-", r"\.", " ", r"\t", r"\n", r"\r", r"\x0B", r"\f"))
_BODY = {
    "ssn": rf"(?:{_ONE_SEP}|[0-9]{{9}})",
    "credit-card": r"(?:[0-9][-\s\x0B.]?){12,18}[0-9]",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "us-phone": r"(?:\+?1[-\s\x0B.]?)?\(?[0-9]{3}\)?[-\s\x0B.]?[0-9]{3}[-\s\x0B.]?[0-9]{4}",
}
_D = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda j: CASE WHEN (length({_D}) - j) % 2 = 1 THEN CASE WHEN CAST(substr({_D}, j, 1) AS INT) > 4 THEN CAST(substr({_D}, j, 1) AS INT) * 2 - 9 ELSE CAST(substr({_D}, j, 1) AS INT) * 2 END ELSE CAST(substr({_D}, j, 1) AS INT) END)) % 10 = 0"
_VALID = {
    "ssn": f"NOT (substr({_D}, 1, 3) IN ('000', '666') OR {_D}[1] = '9' OR substr({_D}, 4, 2) = '00' OR substr({_D}, 6, 4) = '0000')",
    "credit-card": f"length({_D}) BETWEEN 13 AND 19 AND replace({_D}, {_D}[1], '') <> '' AND {_LUHN} AND NOT (length({_D}) = 14 AND substr({_D}, 1, 2) IN ('19', '20'))",
    "email": "lower(regexp_extract(m, '\\.([A-Za-z0-9]*)$', 1)) NOT IN (" + ", ".join(f"'{e}'" for e in tx.EMAIL_FILE_ENDINGS) + ")",
    "us-phone": f"regexp_full_match(CASE WHEN length({_D}) = 11 AND {_D}[1] = '1' THEN substr({_D}, 2) ELSE {_D} END, '[2-9][0-9]{{2}}[2-9][0-9]{{6}}')",
}


def _class_sql(name: str, table: str = "documents") -> str:
    """(doc_id, m): the first validated match of each document."""
    mail = name == "email"
    guard, after = ("[A-Za-z0-9._%+-]", "") if mail else ("[0-9.]", "(?:[^0-9]|$)")
    return rf"""(SELECT doc_id, arg_min(m, u * 1000000 + i) AS m FROM (
  SELECT doc_id, u, i, regexp_extract(substr(run, i), '^({_BODY[name]}){after}', 1) AS m FROM (
    SELECT doc_id, u, run, unnest(range(1, length(run) + 1)) AS i FROM (
      SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS u FROM (
        SELECT doc_id, regexp_extract_all(text, '{_MAIL_RUN if mail else _DIGIT_RUN}') AS runs FROM {table})
    ) WHERE {"contains(run, '@')" if mail else "length(regexp_replace(run, '[^0-9]', '', 'g')) >= 9"})
  WHERE i = 1 OR NOT regexp_matches(substr(run, i - 1, 1), '{guard}'))
 WHERE m <> '' AND {_VALID[name]} GROUP BY doc_id)"""


_MASK = "'****' || right(m, CAST(least(4, length(m) // 2) AS INT))"


def class_hits(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, rule, sample): one finding for each document and class, masked."""
    read = tx.folded(docs.where(F.col("text").isNotNull()), "text")
    found = F.array(*[F.struct(F.lit(c).alias("rule"), tx.first_match(F.col("folded"), c).alias("m")) for c in CLASSES])
    rows = read.select("doc_id", "lang", "source", F.inline(found)).where("m is not null")
    return rows.select("doc_id", "lang", "source", "rule", tx.mask(F.col("m")).alias("sample"))


def _class_docs(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = tx.folded(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
        return read.select("doc_id", tx.first_match(F.col("folded"), name).alias("m")).where("m is not null").select("doc_id", tx.mask(F.col("m")).alias("sample"))

    return run


for _name, _key in (("card", "credit-card"), ("email", "email"), ("phone", "us-phone"), ("ssn", "ssn")):
    _QUERIES[f"class_{_name}_docs"] = _class_docs(_key)
    _SQL[f"class_{_name}_docs"] = f"SELECT doc_id, {_MASK} AS sample FROM {_class_sql(_key)}"

_HITS = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS rule, {_MASK} AS sample FROM {_class_sql(c)}" for c in CLASSES)


@query(f"SELECT lang, rule, count(*) AS n FROM ({_HITS}) JOIN documents USING (doc_id) GROUP BY ALL")
def class_hits_by_lang(spark, sf_dir):
    return class_hits(_table(spark, sf_dir, "documents")).groupBy("lang", "rule").agg(F.count("*").alias("n"))


def _verdicts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    unread = docs.where("text is null or trim(text) = ''").select("doc_id")
    return fd.verdicts(docs, class_hits(docs), unread)


_VERDICT = f"""SELECT d.doc_id, count(h.rule) AS n_findings, CAST(max(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_warnings,
 CASE WHEN count(h.rule) > 0 THEN 1 WHEN max(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END) > 0 THEN 2 ELSE 0 END AS exit_code
 FROM documents d LEFT JOIN ({_HITS}) h ON d.doc_id = h.doc_id GROUP BY d.doc_id"""


@query(_VERDICT)
def verdict_by_document(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(f"SELECT source, exit_code, count(*) AS n FROM ({_VERDICT}) JOIN documents USING (doc_id) GROUP BY ALL")
def verdict_counts_by_source(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return _verdicts(spark, sf_dir).join(docs, "doc_id").groupBy("source", "exit_code").agg(F.count("*").alias("n"))


@query(f"SELECT exit_code AS strict_exit, CASE WHEN n_warnings > 0 THEN 2 ELSE 0 END AS informational_exit, count(*) AS n, CAST(sum(n_findings) AS BIGINT) AS notices FROM ({_VERDICT}) GROUP BY ALL")
def notices_vs_strict(spark, sf_dir):
    """Class rules as notices: what exits would be if they did not count."""
    v = _verdicts(spark, sf_dir)
    return v.groupBy(F.col("exit_code").alias("strict_exit"), F.when(F.col("n_warnings") > 0, 2).otherwise(0).alias("informational_exit")).agg(F.count("*").alias("n"), F.sum("n_findings").alias("notices"))


@query(f"SELECT rule, count(*) AS found, count(DISTINCT sample) AS samples FROM ({_HITS}) GROUP BY rule")
def found_by_rule(spark, sf_dir):
    return class_hits(_table(spark, sf_dir, "documents")).groupBy("rule").agg(F.count("*").alias("found"), F.countDistinct("sample").alias("samples"))


@query(f"SELECT doc_id, left(sha256('salt' || chr(0) || rule || chr(0) || sample), 32) AS record FROM ({_HITS})")
def record_keys(spark, sf_dir):
    return class_hits(_table(spark, sf_dir, "documents")).select("doc_id", tx.record_key(F.lit("salt"), F.col("rule"), F.col("sample")).alias("record"))


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5, CAST(length({_NORM.format('text')}) AS INT) AS n FROM documents")
def normalized_documents(spark, sf_dir):
    return tx.normalized(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.md5("norm").alias("norm_md5"), F.length("norm").alias("n"))


def _benchmark_values(spark, sf_dir):
    b = tx.normalized(_table(spark, sf_dir, "benchmark"), "text")
    return b.select(F.col("item_id").cast("string").alias("rule"), F.col("norm").alias("value"))


_CONTAINS = f"SELECT doc_id, CAST(item_id AS VARCHAR) AS rule FROM (SELECT doc_id, {_NORM.format('text')} AS t FROM documents) d JOIN (SELECT item_id, {_NORM.format('text')} AS v FROM benchmark) b ON v <> '' AND contains(t, v)"
_LINES = f"(SELECT doc_id, {_NORM.format('l')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))"
_ON_LINE = f"SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS rule FROM {_LINES} d JOIN (SELECT item_id, {_NORM.format('text')} AS v FROM benchmark) b ON v <> '' AND contains(t, v)"


@query(_CONTAINS)
def value_contains_benchmark(spark, sf_dir):
    docs = tx.normalized(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "norm")
    return mt.containing(docs, _benchmark_values(spark, sf_dir)).select("doc_id", "rule")


def _hard_lines(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return mt.containing(tx.normalized(lines, "l").select("doc_id", "norm"), _benchmark_values(spark, sf_dir)).select("doc_id", "rule").distinct()


@query(_ON_LINE)
def value_hard_line(spark, sf_dir):
    return _hard_lines(spark, sf_dir)


@query(f"{_CONTAINS} EXCEPT {_ON_LINE}")
def value_joined_lines_review(spark, sf_dir):
    """Values that only joined lines hold: review, never where the same rule is hard."""
    return value_contains_benchmark(spark, sf_dir).join(_hard_lines(spark, sf_dir), ["doc_id", "rule"], "left_anti").distinct()


def _conversation_lines(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return tx.normalized(turns, "l").where("norm <> ''")


_VALUES_SQL = "(SELECT unnest([" + ", ".join(f"'{n}'" for n, _ in VALUES) + "]) AS rule, unnest([" + ", ".join(f"'{v}'" for _, v in VALUES) + "]) AS v)"
_STRADDLE = "instr(substr({l} || {r}, CAST(greatest(1, length({l}) - length(v) + 2) AS INT)), v)"


def _straddles(left: str, right: str) -> str:
    at = _STRADDLE.format(l=left, r=right)
    return f"{at} > 0 AND greatest(1, length({left}) - length(v) + 2) + {at} - 1 <= length({left})"


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda l: {_NORM.format('l')}), lambda x: x <> '') AS ls FROM conversations),
 e AS (SELECT conv_id, turn, ls[1] AS first, ls[-1] AS last FROM t WHERE len(ls) > 0),
 m AS (SELECT *, lag(last) OVER w AS before, lag(turn) OVER w AS p FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, rule FROM m, {_VALUES_SQL} WHERE p = turn - 1 AND {_straddles('before', 'first')}""")
def page_seam_conversations(spark, sf_dir):
    return mt.seams(_conversation_lines(spark, sf_dir), list(VALUES), "conv_id", "turn", "line")


@query(f"""WITH t AS (SELECT conv_id, turn, {_NORM.format('text')} AS n FROM conversations),
 c AS (SELECT conv_id, turn, n, string_agg(n, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t)
 SELECT conv_id, turn, rule FROM c, {_VALUES_SQL} WHERE b IS NOT NULL AND {_straddles('b', 'n')}""")
def tail_crossing_conversations(spark, sf_dir):
    pages = tx.normalized(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")
    return mt.crossings(pages, list(VALUES), "conv_id", "turn")


_CUTS = f"(SELECT rule, v, unnest(range(1, length(v))) AS k FROM {_VALUES_SQL})"


@query(f"""WITH l AS MATERIALIZED (SELECT conv_id, turn, i, {_NORM.format('l')} AS t FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)),
 a AS MATERIALIZED (SELECT conv_id, turn, rule, v, k, i FROM l, {_CUTS} WHERE t <> '' AND ends_with(t, left(v, k))), b AS MATERIALIZED (SELECT conv_id, turn, rule, v, k, i FROM l, {_CUTS} WHERE t <> '' AND starts_with(t, substr(v, k + 1))),
 p AS MATERIALIZED (SELECT a.conv_id, a.turn, a.rule, a.v, a.k AS ka, b.k AS kb, a.i AS ia, b.i AS ib FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.rule = b.rule AND a.i <> b.i AND abs(a.i - b.i) < 5)
 SELECT conv_id, turn, rule FROM p WHERE ka = kb UNION
 SELECT p.conv_id, p.turn, p.rule FROM p JOIN l ON l.conv_id = p.conv_id AND l.turn = p.turn AND l.i <> ia AND l.i <> ib AND abs(l.i - ia) < 5 AND abs(l.i - ib) < 5 AND t <> '' AND kb = ka + length(t) AND substr(v, ka + 1, length(t)) = t""")
def scattered_lines(spark, sf_dir):
    values = spark.createDataFrame(list(VALUES), "rule string, value string")
    lines = _conversation_lines(spark, sf_dir).select(F.struct("conv_id", "turn").alias("page"), "line", "norm")
    return mt.scattered(lines, values, "page", "line").select("page.conv_id", "page.turn", "rule")


_TURN_HITS = f"(SELECT DISTINCT conv_id, turn, rule FROM (SELECT conv_id, turn, {_NORM.format('text')} AS n FROM conversations), {_VALUES_SQL} WHERE contains(n, v))"


def _turn_hits(spark, sf_dir):
    pages = tx.normalized(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")
    return mt.containing(pages.select("conv_id", "turn", "norm"), spark.createDataFrame(list(VALUES), "rule string, value string")).select("conv_id", "turn", "rule").distinct()


@query(f"""SELECT conv_id, rule, count(*) AS n_pages, 'p. ' || array_to_string(list_sort(list(turn))[1:3], ', ') || CASE WHEN count(*) > 3 THEN ' (+' || (count(*) - 3) || ' more)' ELSE '' END AS label FROM {_TURN_HITS} GROUP BY ALL""")
def rule_page_labels(spark, sf_dir):
    return fd.page_labels(_turn_hits(spark, sf_dir), "conv_id", "rule", "turn")


@query(f"""WITH p AS (SELECT DISTINCT conv_id, turn FROM {_TURN_HITS}), i AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM p),
 r AS (SELECT conv_id, g, min(turn) AS a, max(turn) AS b FROM i GROUP BY ALL)
 SELECT conv_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY conv_id""")
def page_range_islands(spark, sf_dir):
    return fd.page_ranges(_turn_hits(spark, sf_dir), "conv_id", "turn")


@query(f"SELECT conv_id, rule, min(turn) AS turn FROM {_TURN_HITS} GROUP BY ALL")
def finding_dedup(spark, sf_dir):
    return fd.deduplicated(_turn_hits(spark, sf_dir), ["conv_id", "rule"], ["turn"]).select("conv_id", "rule", "turn")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links,
 len(regexp_extract_all(html, '<script')) AS scripts, len(regexp_extract_all(html, '<!--')) AS comments FROM pages""")
def html_layers(spark, sf_dir):
    h = F.col("html")
    count = lambda p: F.size(F.regexp_extract_all(h, F.lit(p), 0)).cast("long")
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), count('href="[^"]*"').alias("links"), count("<script").alias("scripts"), count("<!--").alias("comments"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def html_hidden_links(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_string_walk(spark, sf_dir):
    """The values, never the keys, of each event's JSON."""
    values = F.map_values(F.from_json("props", "map<string,string>"))
    return _table(spark, sf_dir, "events").select("event_id", F.explode(values).alias("value"))


@query("""SELECT source, count(*) AS n, count_if(len(list_filter(h, lambda x: x BETWEEN '20' AND '7E' OR x IN ('09', '0A', '0C', '0D'))) < 0.85 * len(h)) AS "binary" FROM (SELECT source, regexp_extract_all(left(hex(encode(text)), 131072), '..') AS h FROM documents) GROUP BY source""")
def binary_sniff_ratio(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(tx.looks_binary(F.col("text"))).alias("binary"))


#: Names that part numbers stand for, by their remainder; null and empty ones among them.
PRODUCERS = ("Acrobat Distiller 9", "Microsoft Word", None, "", "LibreOffice 7", "GPL Ghostscript", "Skia/PDF m99", "macOS Quartz", "home-made", "EXCEL preview")
_MADE = "(SELECT CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {'NULL' if p is None else repr(p)}" for i, p in enumerate(PRODUCERS)) + " END AS p FROM part)"


@query(f"SELECT CASE WHEN p IS NULL OR p = '' THEN 'unknown' WHEN p ILIKE 'acrobat%' THEN 'acrobat' WHEN p IN ('Microsoft Word', 'EXCEL preview') THEN 'office' WHEN p LIKE 'Libre%' THEN 'libreoffice' WHEN p LIKE 'GPL%' THEN 'ghostscript' WHEN p LIKE 'Skia%' THEN 'chromium' WHEN p LIKE 'mac%' THEN 'quartz' ELSE 'other' END AS family, count(*) AS n FROM {_MADE} GROUP BY ALL")
def producer_buckets(spark, sf_dir):
    made = F.get(F.array(*map(F.lit, PRODUCERS)), (F.col("p_partkey") % 10).cast("int"))
    return _table(spark, sf_dir, "part").groupBy(tx.producer_family(made).alias("family")).agg(F.count("*").alias("n"))


def _cases(spark, sf_dir):
    """Orders as case results: a status is the truth, a priority the outcome."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return _table(spark, sf_dir, "orders").select(
        F.when(s == "F", "leak").otherwise("clean").alias("truth"), F.when(s == "F", 1).otherwise(0).alias("expected_exit"),
        F.when(p.startswith("1"), 0).when(p.startswith("2"), 2).otherwise(1).alias("actual_exit"), p.startswith("3").alias("has_hard_finding"),
        p.startswith("4").alias("crashed"), (p.startswith("5") & (s == "P")).alias("timed_out"), F.col("o_totalprice").alias("elapsed"), p.alias("producer"),
    )


_CASES = """(SELECT CASE WHEN o_orderstatus = 'F' THEN 'leak' ELSE 'clean' END AS truth, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS expected_exit,
 CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 1 END AS actual_exit, o_orderpriority LIKE '3%' AS has_hard_finding,
 o_orderpriority LIKE '4%' AS crashed, o_orderpriority LIKE '5%' AND o_orderstatus = 'P' AS timed_out, o_totalprice AS elapsed, o_orderpriority AS producer FROM orders)"""
_CARD = """count(*) AS total, count_if(truth = 'leak') AS leak_cases, count_if(truth = 'clean') AS clean_cases,
 count_if(truth = 'leak' AND NOT crashed AND NOT timed_out AND actual_exit = 0) AS silent_miss, count_if(truth = 'leak' AND NOT crashed AND NOT timed_out AND expected_exit = 1 AND actual_exit = 2) AS downgrade,
 count_if(truth = 'clean' AND NOT crashed AND NOT timed_out AND has_hard_finding) AS false_hard, count_if(truth = 'clean' AND NOT crashed AND NOT timed_out AND actual_exit = 2) AS review_rate,
 count_if(crashed AND NOT timed_out) AS crashes, count_if(timed_out) AS timeouts, quantile_cont(elapsed, 0.5) AS runtime_p50, quantile_cont(elapsed, 0.95) AS runtime_p95"""


@query(f"SELECT {_CARD} FROM {_CASES}")
def scorecard_metrics(spark, sf_dir):
    return ev.scorecard(_cases(spark, sf_dir))


@query(f"SELECT stratum, {_CARD} FROM (SELECT *, unnest(['all', producer, CASE WHEN elapsed > 250000 THEN 'large' END]) AS stratum FROM {_CASES}) WHERE stratum IS NOT NULL GROUP BY stratum")
def scorecard_strata(spark, sf_dir):
    return ev.scorecard(ev.in_strata(_cases(spark, sf_dir), [F.col("producer"), F.when(F.col("elapsed") > 250000, "large")]), "stratum")


def _runs(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_linestatus")
    return li.where("l_linestatus = 'F'").drop("l_linestatus"), li.where("l_linestatus = 'O'").drop("l_linestatus")


_DIFF = """(SELECT l_suppkey, l_linenumber, count(*) FILTER (WHERE l_linestatus = 'F') AS n_reference, count(*) FILTER (WHERE l_linestatus = 'O') AS n_candidate FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY ALL)"""


@query(f"SELECT *, CASE WHEN n_reference = 0 THEN 'added' WHEN n_candidate = 0 THEN 'removed' ELSE 'count' END AS change FROM {_DIFF} WHERE n_reference <> n_candidate")
def multiset_differential(spark, sf_dir):
    return ev.multiset_difference(*_runs(spark, sf_dir), ["l_suppkey", "l_linenumber"])


@query(f"""WITH d AS (SELECT l_suppkey, l_linenumber FROM {_DIFF} WHERE n_reference <> n_candidate), a AS (SELECT DISTINCT s_suppkey AS l_suppkey, 1 AS l_linenumber FROM supplier)
 SELECT *, 'accepted' AS status FROM d WHERE EXISTS (SELECT 1 FROM a WHERE a.l_suppkey = d.l_suppkey AND a.l_linenumber = d.l_linenumber)
 UNION ALL SELECT *, 'unlisted' FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.l_suppkey = d.l_suppkey AND a.l_linenumber = d.l_linenumber)
 UNION ALL SELECT *, 'stale' FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE a.l_suppkey = d.l_suppkey AND a.l_linenumber = d.l_linenumber)""")
def accepted_and_stale(spark, sf_dir):
    listed = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).cast(_table(spark, sf_dir, "lineitem").schema["l_linenumber"].dataType).alias("l_linenumber"))
    return ev.against_accepted(multiset_differential(spark, sf_dir), listed, ["l_suppkey", "l_linenumber"])


@query(f"SELECT actual_exit AS before, CASE WHEN crashed THEN actual_exit WHEN has_hard_finding THEN 0 ELSE actual_exit END AS after, count(*) AS n FROM {_CASES} GROUP BY ALL")
def policy_moves(spark, sf_dir):
    """Exits before and after class findings stop counting; crashed rows are not recomputed."""
    after = F.when(F.col("crashed"), F.col("actual_exit")).when(F.col("has_hard_finding"), 0).otherwise(F.col("actual_exit"))
    return _cases(spark, sf_dir).groupBy(F.col("actual_exit").alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


@query(f"SELECT producer, CASE max(CASE actual_exit WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS actual_exit FROM {_CASES} GROUP BY producer")
def worst_exit(spark, sf_dir):
    return ev.worst(_cases(spark, sf_dir), ["producer"], "actual_exit", fd.severity(F.col("actual_exit")))


@query("""SELECT a.o_orderkey, a.o_custkey FROM orders a LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) c
 ON a.o_custkey = c.o_custkey WHERE c.o_custkey IS NULL OR a.o_orderstatus IS DISTINCT FROM c.o_orderstatus""")
def superseded_versions(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    now = st.newest(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return st.superseded(orders, now, ["o_custkey"], "o_orderstatus").select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def object_map_latest(spark, sf_dir):
    return st.newest(_table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F' AND o_totalprice > 300000)")
def orphans(spark, sf_dir):
    """Objects that nothing refers to: customers without a large order that is done."""
    used = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").select("c_custkey").join(used, "c_custkey", "left_anti")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS src, l_linenumber AS dst FROM lineitem),
 r(doc, node) AS (SELECT l_orderkey, min(l_suppkey) FROM lineitem GROUP BY 1 UNION SELECT e.doc, e.dst FROM r JOIN e ON r.doc = e.doc AND r.node = e.src) SELECT doc, node FROM r""")
def reachability_closure(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    edges = li.select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("dst")).distinct()
    roots = li.groupBy(F.col("l_orderkey").alias("doc")).agg(F.min("l_suppkey").alias("node"))
    return st.reachable(edges, roots, "doc", "src", "dst", "node")


@query("""WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS o, l_suppkey AS s, l_suppkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE l_quantity >= 1),
 p AS (SELECT DISTINCT doc, unnest([s, e]) AS a FROM c), q AS (SELECT doc, a, lead(a) OVER (PARTITION BY doc ORDER BY a) AS b FROM p),
 h AS (SELECT q.doc, a, b, list_sort(list(DISTINCT o) FILTER (WHERE o IS NOT NULL)) AS os FROM q LEFT JOIN c ON q.doc = c.doc AND s <= a AND b <= e WHERE b IS NOT NULL GROUP BY ALL),
 t AS (SELECT *, CASE coalesce(len(os), 0) WHEN 0 THEN 'gap' WHEN 1 THEN 'owned' ELSE 'contested' END AS kind, CASE coalesce(len(os), 0) WHEN 0 THEN 'gap' WHEN 1 THEN 'o' || os[1] ELSE 'contested' END AS tag FROM h),
 m AS (SELECT *, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER (PARTITION BY doc ORDER BY a) THEN 1 ELSE 0 END AS n FROM t), r AS (SELECT *, sum(n) OVER (PARTITION BY doc ORDER BY a) AS g FROM m)
 SELECT doc, min(a) AS start, max(b) AS end, min(kind) AS kind, CAST(len(list_distinct(flatten(list(coalesce(os, []))))) AS BIGINT) AS owners FROM r GROUP BY doc, g""")
def interval_tiling(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").where("l_quantity >= 1")
    claims = li.select(F.col("l_orderkey").alias("doc"), "l_linenumber", F.col("l_suppkey").alias("s"), (F.col("l_suppkey") + F.col("l_quantity").cast("long")).alias("e"))
    return st.tiling(claims, "doc", "l_linenumber", "s", "e")


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY event_type")
def gate_percentiles(spark, sf_dir):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(p.alias("p"), F.max("value").alias("most")).select("event_type", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"), "most")


@query("SELECT n_name, r_name, CAST(levenshtein(n_name, r_name) AS INT) AS distance FROM nation JOIN region ON n_regionkey = r_regionkey")
def edit_distance_join(spark, sf_dir):
    region = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return _table(spark, sf_dir, "nation").join(region, "n_regionkey").select("n_name", "r_name", F.levenshtein("n_name", "r_name").alias("distance"))


@query("SELECT o_custkey, count(*) AS n, array_to_string(list_sort(list(o_orderkey))[1:8], ', ') || CASE WHEN count(*) > 8 THEN ' (+' || (count(*) - 8) || ' more)' ELSE '' END AS objects FROM orders GROUP BY o_custkey")
def object_lists(spark, sf_dir):
    """The first eight objects and how many more there are."""
    o = st.capped(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 8)
    g = o.groupBy("o_custkey").agg((F.count("*") + F.sum("left_out")).alias("n"), F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    more = F.when(F.col("n") > 8, F.concat(F.lit(" (+"), (F.col("n") - 8).cast("string"), F.lit(" more)"))).otherwise("")
    return g.select("o_custkey", "n", F.concat(F.array_join(F.transform(F.slice("k", 1, 8), lambda x: x.cast("string")), ", "), more).alias("objects"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_by_document(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
