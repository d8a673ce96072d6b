"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_count, decontaminate, gif, html_extract, near_dedup, packing, ppm, quality, substring_dedup, toxicity
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, model)
    held = F.coalesce(toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "worst_start", "worst_end")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.mark_repeats(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"))


def op10_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.text_media(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus_pipeline().run(spark, sf_dir)


def _corpus_pipeline():
    """corpus_pipeline.py at the top of the repository, which belongs to this subpackage."""
    if "corpus_pipeline" not in sys.modules:
        spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).resolve().parents[2] / "corpus_pipeline.py")
        module = importlib.util.module_from_spec(spec)
        sys.modules["corpus_pipeline"] = module
        spec.loader.exec_module(module)
    return sys.modules["corpus_pipeline"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_toxicity, op2_substring_dedup, op3_best_fit_packing, op4_html_extraction, op5_lm_scoring, op6_token_counts, op7_minhash_near_dedup, op8_decontamination, op9_quality_classifier, op10_media_gif, pipeline]
    return {f.__name__: f for f in ops}


_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
windows AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
repeats AS (SELECT doc_id, p FROM windows JOIN firsts USING (k) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM repeats CROSS JOIN (SELECT unnest(range(0, 13)) AS o)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS t
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_starts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k FROM item_starts),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN lengths WHERE len(w) >= n),
doc_windows AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k FROM doc_starts),
hits AS (SELECT doc_id, item_id, n, p FROM doc_windows JOIN item_windows USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": _OP2, "op8_decontamination": _OP8}
