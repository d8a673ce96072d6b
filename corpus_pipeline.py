"""From raw documents to packed sequences: each stage works on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back
as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearveil.llm import decontaminate, near_dedup, packing, substring_dedup, toxicity
from clearveil.llm.common import dropped, table, written
from clearveil.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have no sentence and stay; so do null ids and repeated rows, each judged by
    its own text.  Texts are read whole.  Further columns, whatever their names, are passed on.
    Without labels, or without rows, nothing is rejected.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays.

    Null, empty and blank texts have no shingle, are like nothing and stay; rows of a null id stay;
    of rows with one id one stays.  Texts of fewer than five words are alike if they are equal word
    for word.  Further columns are passed on.
    """
    return near_dedup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; documents of which nothing is left go.

    A text that loses words is what is left of it, words joined by one space, and ``n_chars``, where
    there is such a column, its length; every other text stays as it is, null and empty ones too.  A
    null id neither gives nor loses words.  Further columns are passed on, whatever their names.
    """
    keep = tuple(c for c in docs.columns if c != "text")
    out = substring_dedup.mark_repeats(docs, keep=keep, kept_text=True)
    out = out.where("n_words = 0 or n_removed < n_words")
    kept = F.col("kept")

    def column(c: str):
        if c == "text":
            return F.col("kept_text").alias(c)
        was = kept.getField(c)
        if c == "n_chars":
            was = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(was)
        return was.alias(c)

    return out.select(*map(column, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a span of a benchmark item go.

    A span is ten words, or all words of a shorter item.  Null and empty texts hold none and stay, as
    do null ids; equal rows share their fate.  An empty benchmark rejects nothing.  Further columns
    are passed on.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 tokens, as ``op3`` packs: one row for each piece.

    A null or empty text is its end token alone; repeated rows and null ids are packed like any
    other; longer texts are cut.  Only ``doc_id`` and ``text`` are read.
    """
    return packing.packed(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained and iterative stages have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
