"""Pages that arrive over time: values that run across page breaks, with a bounded state for each document."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "next long, tail string, seen array<string>"


def rolling_scan(pages: DataFrame, values: list[tuple[str, str]], doc: str, page: str, norm: str = "norm") -> DataFrame:
    """(doc, page, rule, code): values inside a page's text or across its beginning, once for each document.

    ``pages`` is a stream of normal forms.  A document's state is the number of the page
    to come, the last characters of its text, one less than the longest value, and the rules found.
    Pages of one batch are put in order.  A page that comes after a later one cannot be joined to a
    text that is gone: it is searched alone, and a row with the code ``PAGE_OUT_OF_ORDER`` and no rule
    asks for review; a gap is joined but flagged ``PAGE_GAP``.  Null text is empty.
    """
    keep = max(len(v) for _, v in values) - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        due, tail, seen = state.get if state.exists else (None, "", [])
        seen, out = set(seen), []
        rows = pd.concat(list(batches)).sort_values("_page", kind="stable")
        for number, text in zip(rows["_page"].tolist(), rows["_norm"].fillna("").tolist(), strict=True):
            late = due is not None and number < due
            if late:
                out.append((number, None, "PAGE_OUT_OF_ORDER"))
            elif due is not None and number > due:
                out.append((number, None, "PAGE_GAP"))
            joined = text if late else tail + text
            for name, value in values:
                if name not in seen and value and value in joined:
                    seen.add(name)
                    out.append((number, name, None))
            if not late:
                due, tail = number + 1, joined[-keep:] if keep else ""
        state.update((due, tail, sorted(seen)))
        df = pd.DataFrame(out, columns=["_page", "rule", "code"])
        df.insert(0, "_doc", key[0])
        yield df

    p = pages.select(F.col(doc).alias("_doc"), F.col(page).cast("long").alias("_page"), F.col(norm).alias("_norm")).where("_doc is not null and _page is not null")
    type_ = p.schema["_doc"].dataType.simpleString()
    got = p.groupBy("_doc").applyInPandasWithState(step, f"_doc {type_}, _page long, rule string, code string", STATE, "append", "NoTimeout")
    return got.select(F.col("_doc").alias(doc), F.col("_page").alias(page), "rule", "code")


def finished(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there, in micro-batches, and gives its rows, kept in ``folder``."""
    rows, state = f"{folder}/rows", f"{folder}/state"
    stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(rows).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)


def shared_folder(spark, name: str) -> str:
    """A new folder below the one that driver and executors share, which the cluster names in ``spark.checkpoint.dir``."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="clearveil-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
