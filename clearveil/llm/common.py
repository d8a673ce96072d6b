"""Helpers shared by the corpus operators: tables, shared scratch folder, partition arithmetic."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Raw text bytes that one group of documents should hold (see ``group_count``).
GROUP_BYTES = 4 << 20
#: Groups of a small corpus; messages between groups and buckets grow with the square of it.
LEAST_GROUPS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Arrow batches of at most ``most`` bytes, so that a row of long texts or sets costs a worker no
    more than a short one; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m")) > most:
        spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that setting is absent and all
    runs on this machine (tests) a temporary folder is used; a cluster without it is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clearveil-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


_at: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor later costs a reread, not a recomputation.  The table is
    deleted by ``dropped``, or when the driver's process ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    _at[back] = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: all that came from them is written too."""
    for df in tables:
        if path := _at.pop(df, None):
            _delete(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named(column: str) -> Column:
    """A column by its exact name, whatever is in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def group_count(docs: DataFrame, text: str, target: int = GROUP_BYTES) -> int:
    """How many groups keep each near ``target`` bytes of text: follows the data, never a constant."""
    total = docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0
    return max(LEAST_GROUPS, math.ceil(total / target))


def in_groups(docs: DataFrame, groups: int, *cols: str) -> DataFrame:
    """``docs`` with only ``cols`` and a column ``_grp``, a function of the row's own values."""
    return docs.select(F.pmod(F.xxhash64(*[F.col(c) for c in cols[:2]]), F.lit(groups)).cast("int").alias("_grp"), *[F.col(c) for c in cols])


def fits(df: DataFrame, row_bytes: int, limit: int = 48 << 20) -> bool:
    """Whether a table counted now is small enough to broadcast."""
    return df.count() * row_bytes <= limit


def within_bytes(rows: DataFrame, text: str, order: list[str], most: int, by: list[str] | None = None) -> DataFrame:
    """The first rows in ``order`` (of each group ``by``) whose texts together have at most ``most``
    bytes.  Which texts these are does not depend on their own length, but for the last one."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_bytes", F.sum(F.octet_length(text)).over(w)).where(F.col("_bytes") <= most).drop("_bytes")


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str, row_bytes: int) -> DataFrame:
    """An equi-join that sends ``right`` to all executors only if its rows, counted now, are few enough."""
    return left.join(F.broadcast(right) if fits(right, row_bytes) else right, on, how)
