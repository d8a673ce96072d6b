"""One-to-one matching of expected instances with reported occurrences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _largest(wanted: dict[int, list[int]]) -> dict[int, int]:
    """A largest matching {left: right}; lefts in ascending order, each tries its rights in the given order.

    A search for an augmenting path goes over rights not seen in it; the stack holds (left, place
    in its list), so long chains need no recursion.
    """
    owner: dict[int, int] = {}
    for first in sorted(wanted):
        seen: set[int] = set()
        path = [(first, iter(wanted[first]))]
        taken: list[int] = []
        while path:
            left, rights = path[-1]
            step = next((r for r in rights if r not in seen), None)
            if step is None:
                path.pop()
                if taken:
                    taken.pop()
                continue
            seen.add(step)
            taken.append(step)
            if step in owner:
                path.append((owner[step], iter(wanted[owner[step]])))
                continue
            for (mover, _), right in zip(path, taken, strict=True):
                owner[right] = mover
            break
    return {left: right for right, left in owner.items()}


def one_to_one(candidates: DataFrame, group: str, left: str, right: str, preference: str) -> DataFrame:
    """(group, left, right): a largest matching for each group.

    ``candidates`` has a row for every admissible pair; a left tries its rights by ``preference``,
    smallest first, then by number.  A left that cannot be covered has a null ``right``: it is
    ambiguous, not missed.  Groups are files; many share one Arrow call, by a hash.
    """
    buckets = 8 * int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, g in rows.sort_values(["_p", "_r"], kind="stable").groupby("_g", sort=False):
            wanted: dict[int, list[int]] = {}
            for a, b in zip(g["_l"].tolist(), g["_r"].tolist(), strict=True):
                wanted.setdefault(a, []).append(b)
            got = _largest(wanted)
            out += [(name, a, got.get(a)) for a in wanted]
        return pd.DataFrame(out, columns=["_g", "_l", "_r"]).astype({"_r": "Int64"})

    c = candidates.select(F.col(group).alias("_g"), F.col(left).cast("long").alias("_l"), F.col(right).cast("long").alias("_r"), F.col(preference).cast("long").alias("_p")).dropna(subset=["_g", "_l", "_r"])
    c = c.groupBy("_g", "_l", "_r").agg(F.min("_p").alias("_p"))
    type_ = c.schema["_g"].dataType.simpleString()
    got = c.groupBy(F.pmod(F.xxhash64("_g"), F.lit(buckets))).applyInPandas(match, f"_g {type_}, _l long, _r long")
    return got.select(F.col("_g").alias(group), F.col("_l").alias(left), F.col("_r").alias(right))


def outcomes(instances: DataFrame, matched: DataFrame, units: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """``outcome`` of each instance: hit, downgraded (a warning where a finding was due), ambiguous, missed.

    ``instances`` has ``expected_exit``; ``units`` has ``finding``, whether a hard finding reports it.
    """
    found = matched.join(units.select(group, right, "finding"), [group, right], "left").select(group, left, right, "finding", F.lit(True).alias("_seen"))
    how = F.when(F.col("_seen").isNull(), "missed").when(F.col(right).isNull(), "ambiguous").when(F.col("finding") | (F.col("expected_exit") == 2), "hit").otherwise("downgraded")
    return instances.join(found, [group, left], "left").withColumn("outcome", how).drop("_seen", "finding")
