"""Graphs, revisions and byte ranges of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Object map: for each key the row that comes first in ``order``, newest first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def superseded(old: DataFrame, new: DataFrame, key: list[str], content: str) -> DataFrame:
    """Rows of ``old`` whose content is another in ``new``, or whose key is gone."""
    now = new.select(*key, F.col(content).alias("_now"), F.lit(True).alias("_there"))
    return old.join(now, key, "left").where(F.col("_there").isNull() | ~F.col(content).eqNullSafe(F.col("_now"))).drop("_now", "_there")


def reachable(edges: DataFrame, roots: DataFrame, doc: str, src: str, dst: str, node: str) -> DataFrame:
    """(doc, node) reachable from the roots, roots included; a closure for each document.

    Documents are small graphs, so each is walked whole; many share one Arrow call, by a hash of
    the document.  Cycles end by themselves, null nodes are nothing.
    """
    import pandas as pd

    buckets = 8 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for d, a, b in zip(left["_doc"].tolist(), left["_src"].tolist(), left["_dst"].tolist(), strict=True):
            near.setdefault((d, a), []).append((d, b))
        todo = list(dict.fromkeys(zip(right["_doc"].tolist(), right["_node"].tolist(), strict=True)))
        seen = set(todo)
        while todo:
            for b in near.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return pd.DataFrame(sorted(seen), columns=["_doc", "_node"]).astype("int64")

    bucket = F.pmod(F.xxhash64("_doc"), F.lit(buckets)).alias("_bucket")
    e = edges.select(F.col(doc).cast("long").alias("_doc"), F.col(src).cast("long").alias("_src"), F.col(dst).cast("long").alias("_dst")).dropna().select("*", bucket)
    r = roots.select(F.col(doc).cast("long").alias("_doc"), F.col(node).cast("long").alias("_node")).dropna().select("*", bucket)
    out = e.groupBy("_bucket").cogroup(r.groupBy("_bucket")).applyInPandas(walk, "_doc long, _node long")
    return out.select(F.col("_doc").alias(doc), F.col("_node").alias(node))


def tiling(claims: DataFrame, doc: str, owner: str, start: str, end: str) -> DataFrame:
    """Elementary pieces of claimed ranges [start, end): (doc, start, end, kind, owners).

    Neighbouring pieces are one region if both are contested, both unclaimed, or owned by the same
    one; ``owners`` counts the distinct claimants of the region.  A null owner claims nothing, empty
    ranges and null documents have no piece.

    Claims are not joined: an owner's ranges that touch are one, which begins and ends at an event;
    along a document's events a running sum tells how many owners there are, and the running sum of
    their numbers tells which one if there is one.  All is sorted within one dealing by document.
    """
    c = claims.select(F.col(doc).alias("_doc"), F.col(owner).alias("_owner"), F.col(start).alias("_s"), F.col(end).alias("_e")).where("_doc is not null and _s < _e")
    same = Window.partitionBy("_doc", "_owner").orderBy("_s", "_e")
    c = c.withColumn("_id", F.dense_rank().over(Window.partitionBy("_doc").orderBy("_owner")).cast("long"))
    c = c.withColumn("_before", F.max("_e").over(same.rowsBetween(Window.unboundedPreceding, -1)))
    c = c.withColumn("_next", F.lead("_s").over(same)).withColumn("_far", F.greatest("_e", "_before"))
    begins = F.col("_before").isNull() | (F.col("_s") > F.col("_before"))
    ends = F.col("_next").isNull() | (F.col("_next") > F.col("_far"))
    counts = F.col("_owner").isNotNull().cast("long")
    both = F.array(F.when(begins, F.struct(F.col("_s").alias("at"), counts.alias("by"))), F.when(ends, F.struct(F.col("_far").alias("at"), (-counts).alias("by"))))
    events = c.select("_doc", "_id", F.explode(F.array_compact(both)).alias("_x")).select("_doc", "_id", F.col("_x.at").alias("_at"), F.col("_x.by").alias("_by"))
    came, went = (F.collect_set(F.when(F.col("_by") == x, F.col("_id"))).alias(n) for x, n in ((1, "_came"), (-1, "_went")))
    points = events.groupBy("_doc", "_at").agg(F.sum("_by").alias("_by"), F.sum(F.col("_by") * F.col("_id")).alias("_ids"), came, went)
    w = Window.partitionBy("_doc").orderBy("_at")
    p = points.select("_doc", "_at", "_came", "_went", F.lead("_at").over(w).alias("_to"), F.sum("_by").over(w).alias("_n"), F.sum("_ids").over(w).alias("_sum"))
    kind = F.when(F.col("_n") == 0, "gap").when(F.col("_n") == 1, "owned").otherwise("contested")
    tag = F.struct(kind, F.when(F.col("_n") == 1, F.col("_sum")))
    sole = F.when(F.lag("_n").over(w) == 1, F.lag("_sum").over(w))  # owned the piece before, and perhaps this one
    stays = F.when(sole.isNotNull() & ~F.array_contains("_went", sole), F.array(sole)).otherwise(F.array().cast("array<bigint>"))
    p = p.select("_doc", "_at", "_to", kind.alias("_k"), tag.alias("_t"), F.concat("_came", stays).alias("_o"))
    p = p.withColumn("_new", (~F.col("_t").eqNullSafe(F.lag("_t").over(w))).cast("int")).withColumn("_r", F.sum("_new").over(w)).where("_to is not null")
    claimants = F.size(F.array_distinct(F.flatten(F.collect_list("_o")))).cast("long")
    out = p.groupBy("_doc", "_r").agg(F.min("_at").alias("start"), F.max("_to").alias("end"), F.min("_k").alias("kind"), claimants.alias("_all"))
    owners = F.when(F.col("kind") == "gap", 0).when(F.col("kind") == "owned", 1).otherwise(F.col("_all")).cast("long")
    return out.select(F.col("_doc").alias(doc), "start", "end", "kind", owners.alias("owners"))


def resolved(edges: DataFrame, objects: DataFrame, doc: str) -> DataFrame:
    """(doc, src, num, gen, state): each reference once, "live", "dangling" (no such object) or "generation" (another one's)."""
    now = objects.select(doc, "num", F.col("gen").alias("_gen"))
    got = edges.select(doc, "src", "num", "gen").distinct().join(now, [doc, "num"], "left")
    state = F.when(F.col("_gen").isNull(), "dangling").when(F.col("_gen") == F.col("gen"), "live").otherwise("generation")
    return got.select(doc, "src", "num", "gen", state.alias("state"))


def tiling_gaps(tiles: DataFrame, sizes: DataFrame, doc: str) -> DataFrame:
    """(doc, problem) where tiles (start, end) do not cover [0, size) exactly: "begin", "inside", "end", "none"."""
    w = Window.partitionBy(doc).orderBy("start", "end")
    t = tiles.select(doc, "start", "end", (F.col("start") != F.lag("end").over(w)).alias("_apart"))
    g = t.groupBy(doc).agg(F.min("start").alias("_a"), F.max("end").alias("_b"), F.bool_or("_apart").alias("_apart"))
    found = F.array(
        F.when(F.col("_a").isNull() & (F.col("size") > 0), "none"), F.when(F.col("_a") != 0, "begin"), F.when(F.col("_apart"), "inside"), F.when(F.col("_b") != F.col("size"), "end")
    )
    return sizes.select(doc, "size").join(g, doc, "left").select(doc, F.explode(F.array_compact(found)).alias("problem"))


def tree_faults(leaves: DataFrame, nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, node, fault) of name and number trees: "order" where keys do not strictly increase along
    the tree, "limits" where a node's limits are not the first and last key below it.

    ``leaves``: doc, tree, seq (place along the tree), key, path (the nodes above, root first);
    ``nodes``: doc, tree, node, low, high (null for the root).
    """
    w = Window.partitionBy(doc, "tree").orderBy("seq")
    order = leaves.select(doc, "tree", "key", "path", F.lag("key").over(w).alias("_before")).where("_before >= key")
    order = order.select(doc, F.try_element_at("path", F.lit(-1)).alias("node"), F.lit("order").alias("fault"))
    below = leaves.select(doc, "tree", F.explode("path").alias("node"), "seq", "key").groupBy(doc, "tree", "node").agg(F.min_by("key", "seq").alias("_low"), F.max_by("key", "seq").alias("_high"))
    wrong = nodes.where("low is not null or high is not null").join(below, [doc, "tree", "node"], "left").where("not (low <=> _low and high <=> _high)")
    return order.unionByName(wrong.select(doc, "node", F.lit("limits").alias("fault"))).distinct()


def capped(rows: DataFrame, key: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key, and in ``left_out`` of the last of them how many more there are."""
    w = Window.partitionBy(*key)
    n = rows.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    left = F.when(F.col("_i") == most, F.col("_n") - most).otherwise(0).cast("long")
    return n.where(F.col("_i") <= most).withColumn("left_out", left).drop("_i", "_n")


def revisions_kept(revisions: DataFrame, doc: str, most: int = 50) -> DataFrame:
    """The first revision and the latest ``most - 1``; ``left_out`` counts the others of the file."""
    w = Window.partitionBy(doc)
    n = revisions.withColumn("_last", F.row_number().over(w.orderBy(F.desc("revision")))).withColumn("_n", F.count("*").over(w))
    return n.where((F.col("_last") < most) | (F.col("_last") == F.col("_n"))).withColumn("left_out", F.greatest(F.lit(0), F.col("_n") - most)).drop("_last", "_n")


def missing_members(entries: DataFrame, members: DataFrame, doc: str) -> DataFrame:
    """(doc, num, home): entries that say an object lies in a stream, where that stream has no such member.

    ``entries``: doc, num, home; ``members``: doc, home, num.  A home that is not there has none.
    """
    return entries.select(doc, "num", "home").distinct().join(members.select(doc, "num", "home"), [doc, "num", "home"], "left_anti")


# What a reference is used for, by the key that holds it; a category directly inside
# resources comes first, then the outermost key that is listed.
RESOURCE_USES = {"XObject": "xobject", "Font": "font", "Pattern": "pattern", "Shading": "shading", "ExtGState": "extgstate", "ColorSpace": "color_space", "Properties": "properties"}
KEY_USES = {
    "Root": "root", "Info": "info", "Encrypt": "encrypt", "Pages": "pages", "Kids": "pages", "Parent": "parent", "Contents": "contents", "Resources": "resources",
    "FontFile": "font_program", "FontFile2": "font_program", "FontFile3": "font_program", "CharProcs": "font_program", "SMask": "soft_mask", "Mask": "soft_mask",
    "Annots": "annotation", "AP": "appearance", "AcroForm": "field", "Fields": "field", "V": "field", "Outlines": "outline", "Names": "name_tree", "Dests": "name_tree",
    "OpenAction": "action", "AA": "action", "A": "action", "EF": "embedded_file", "AF": "embedded_file", "Metadata": "metadata", "Thumb": "thumbnail",
    "Alternates": "alternate", "OCProperties": "optional_content", "OC": "optional_content", "StructTreeRoot": "structure", "PieceInfo": "piece_info",
}


def use_kind(path):
    """What a reference at ``path``, an array of keys from the outermost on, is used for; "other" if no key says."""
    literal = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    pairs = F.transform(F.slice(path, 1, F.greatest(F.lit(0), F.size(path) - 1)), lambda k, i: F.when(k == "Resources", F.element_at(literal(RESOURCE_USES), F.get(path, i + 1))))
    keys = F.transform(path, lambda k: F.element_at(literal(KEY_USES), k))
    first = lambda found: F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(first(pairs), first(keys), F.lit("other"))
