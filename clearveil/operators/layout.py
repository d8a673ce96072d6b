"""From glyphs with boxes to lines of text, and rectangles on pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of the line tolerance in points, factors of a column break, sizes, fractions.
LINE_TOLERANCE = (4.0, 12.0)
GAP_FACTOR, EXTENT_FACTOR = 3.0, 1.5
GENUINE_READINGS, SEAM_READINGS, SCATTER_READINGS = 7, 5, (9, 5)
MERGE_OVERLAP, COVERED_FRACTION, OPAQUE = 0.5, 0.25, 0.99
OCR_LONGEST_SIDE, TEXT_SHORT_SIDE, TEXT_LONG_SIDE = 3510, 8, 32

GLYPHS = "char string, x0 double, y0 double, x1 double, y1 double, vertical boolean"


def _upper_median(values: np.ndarray) -> float:
    return float(np.sort(values)[len(values) // 2])


def _rows(at: np.ndarray, tolerance: float) -> np.ndarray:
    """Row numbers of sorted positions; a row is left when a position is too far from its running mean."""
    row, mean, held, out = 0, at[0], 0, np.empty(len(at), np.int64)
    for i, v in enumerate(at.tolist()):
        if abs(v - mean) > tolerance:
            row, mean, held = row + 1, v, 0
        held += 1
        mean += (v - mean) / held
        out[i] = row
    return out


def _segments(start: np.ndarray, end: np.ndarray, measured: np.ndarray) -> np.ndarray:
    """Column numbers along one row.  A column ends at a gap that is an outlier among the row's gaps
    and wider than a character; ``measured`` glyphs, if the row has any, set both."""
    if len(start) < 2:
        return np.zeros(len(start), np.int64)
    gaps = np.maximum(0.0, start[1:] - end[:-1])
    if measured.any():
        both = gaps[measured[1:] & measured[:-1]]
        typical, extent = (_upper_median(both) if len(both) else 0.0), _upper_median((end - start)[measured])
    else:
        typical, extent = _upper_median(gaps), _upper_median(end - start)
    return np.concatenate([[0], np.cumsum(gaps > max(GAP_FACTOR * typical, EXTENT_FACTOR * extent))])


def _in_groups(df: DataFrame, key: list[str], order: str, each, schema: str) -> DataFrame:
    """``key`` and what ``each`` gives for the rows of every key, sorted by ``order``.

    Groups are small and many: partitions are read in batches, whole groups are cut out as they come,
    and only one open group is kept.  ``each`` takes rows and the bounds of their groups, and gives
    ``_key``, the group's key as JSON, and ``schema``.
    """

    def bounds(rows: pd.DataFrame) -> list[int]:
        k = rows["_key"].to_numpy(object)
        return [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else [0]

    def run(batches):
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            if held and held[0]["_key"].iloc[0] != b["_key"].iloc[0]:
                rows = pd.concat(held, ignore_index=True)
                yield each(rows, bounds(rows))
                held = []
            last = bounds(b)[-2]
            if last:
                rows = pd.concat([*held, b.iloc[:last]], ignore_index=True)
                yield each(rows, bounds(rows))
                held = []
            held.append(b.iloc[last:])
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield each(rows, bounds(rows))

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", F.to_json(F.struct(*key), {"ignoreNullFields": "false"})).drop(*key)
    out = keyed.repartition(n, "_key").sortWithinPartitions("_key", order).mapInPandas(run, "_key string, " + schema)
    named = out.withColumn("_key", F.from_json("_key", df.select(*key).schema))
    return named.select(*[F.col("_key")[k].alias(k) for k in key], *[c for c in out.columns if c != "_key"])


class _Page:
    """Glyphs of one page; ``low`` and ``high`` are their sides along x and y."""

    def __init__(self, g: pd.DataFrame):
        self.char = g["char"].to_numpy(object)
        self.low, self.high = g[["x0", "y0"]].to_numpy(float), g[["x1", "y1"]].to_numpy(float)
        self.mid, self.size = (self.low + self.high) / 2, self.high - self.low

    def lines(self, which: np.ndarray, axis: int, measure: np.ndarray | None = None, only_with: np.ndarray | None = None) -> list[list[int]]:
        """Glyph numbers of each line: rows along ``axis``, cut at column breaks, read along the other."""
        if not len(which):
            return []
        measured = np.zeros(len(self.char), bool)
        if measure is not None:
            measured[measure] = True
        base = measure if measure is not None and len(measure) else which
        tolerance = float(np.clip(_upper_median(self.size[base, axis]) / 2, *LINE_TOLERANCE))
        by_row = which[np.argsort(self.mid[which, axis], kind="stable")]
        rows, other, out = _rows(self.mid[by_row, axis], tolerance), 1 - axis, []
        for part in np.split(by_row, np.flatnonzero(np.diff(rows)) + 1):
            row = part[np.argsort(self.mid[part, other], kind="stable")]
            half = self.size[row, other] / 2
            columns = _segments(self.mid[row, other] - half, self.mid[row, other] + half, measured[row])
            for line in np.split(row, np.flatnonzero(np.diff(columns)) + 1):
                if only_with is None or only_with[line].any():
                    out.append(line.tolist())
        return out


def _ten_readings(g: pd.DataFrame, width: float, height: float) -> list[list[list[int]]]:
    page = _Page(g)
    seen = (page.mid >= 0).all(1) & (page.mid[:, 0] <= width) & (page.mid[:, 1] <= height)
    up = g["vertical"].to_numpy(bool)
    pick = lambda m: np.flatnonzero(m)
    flat, turned, off = pick(seen & ~up), pick(seen & up), pick(~seen)
    off_flat, off_turned = pick(~seen & ~up), pick(~seen & up)
    down = lambda w, m=None: page.lines(w, 0, m)
    back = lambda lines: [x[::-1] for x in lines]
    all_flat, all_turned, visible = np.concatenate([flat, off_flat]), np.concatenate([turned, off_turned]), np.concatenate([flat, turned])
    across, columns = down(all_turned, turned), down(visible)
    return [
        page.lines(flat, 1), down(turned), back(down(turned)), page.lines(off, 1),
        page.lines(all_flat, 1, flat, seen & ~up) if len(off_flat) else page.lines(flat, 1), across, back(across),
        columns, back(columns), page.lines(all_flat, 1, flat) if len(off_flat) else page.lines(flat, 1),
    ]


def readings(glyphs: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """(doc, page, reading, line, text): ten readings of every page.

    ``glyphs`` has the columns of GLYPHS in the order ``seq``, and the visible ``width`` and
    ``height`` of the page, whose origin is the top left corner.  0 visible horizontal lines; 1, 2
    visible vertical ones, down and up; 3 what lies off the page; 4 horizontal across the edge, only
    stretches with a visible glyph; 5, 6 vertical across the edge; 7, 8 all that is visible, in
    columns; 9 all horizontal text.  White space and null characters are nothing; a page
    without glyphs has no row.  A call holds one page.
    """

    def read(rows: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
        out, keys = [], rows["_key"].tolist()
        for a, b in zip(bounds, bounds[1:]):
            g = rows.iloc[a:b]
            chars = g["char"].to_numpy(object)
            for r, lines in enumerate(_ten_readings(g, g["width"].iloc[0], g["height"].iloc[0])):
                out += [(keys[a], r, n, "".join(chars[line])) for n, line in enumerate(lines)]
        return pd.DataFrame(out, columns=["_key", "reading", "line", "text"])

    shown = glyphs.where(F.col("char") != "").where(~F.col("char").rlike(r"\A[\s\x1C-\x1F\x85\p{Z}]+\z"))
    g = shown.select(F.col(doc).alias("_doc"), F.col(page).alias("_page"), "seq", "char", "x0", "y0", "x1", "y1", F.coalesce("vertical", F.lit(False)).alias("vertical"), "width", "height")
    got = _in_groups(g, ["_doc", "_page"], "seq", read, "reading int, line int, text string")
    return got.select(F.col("_doc").alias(doc), F.col("_page").alias(page), "reading", "line", "text")


def covered_images(log: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """(doc, page, seq, fraction): each image of a draw log with the largest part of it that one later opaque fill hides.

    ``log``: seq, kind ("image", "fill", "clip"), x0, y0, x1, y1, opacity (null: opaque), width,
    height.  The part is of the image's area on the page, or of its area inside a clip, whichever is
    larger.  Images that lie off the page have no row.
    """
    side = lambda p: [F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1")]
    box = lambda p: f"greatest(0D, {p}x1 - {p}x0) * greatest(0D, {p}y1 - {p}y0)"
    cut = lambda a, b: [F.greatest(a + "x0", b + "x0").alias("wx0"), F.greatest(a + "y0", b + "y0").alias("wy0"), F.least(a + "x1", b + "x1").alias("wx1"), F.least(a + "y1", b + "y1").alias("wy1")]
    on_page = log.where("kind = 'image'").select(doc, page, "seq", F.greatest("x0", F.lit(0.0)).alias("ix0"), F.greatest("y0", F.lit(0.0)).alias("iy0"), F.least("x1", "width").alias("ix1"), F.least("y1", "height").alias("iy1")).where(box("i") + " > 0")
    painted = log.where("x1 > x0 and y1 > y0")
    clips = painted.where("kind = 'clip'").select(doc, page, *side("c"))
    fills = painted.where(f"kind = 'fill' and coalesce(opacity, 1) >= {OPAQUE}").select(doc, page, F.col("seq").alias("later"), *side("f"))
    key = [doc, page, "seq"]
    windows = on_page.select(*key, F.col("ix0").alias("wx0"), F.col("iy0").alias("wy0"), F.col("ix1").alias("wx1"), F.col("iy1").alias("wy1"))
    windows = windows.union(on_page.join(clips, [doc, page]).select(*key, *cut("i", "c")).where(box("w") + " > 0"))
    hidden = windows.join(fills, [doc, page]).where("later > seq")
    part = "greatest(0D, least(wx1, fx1) - greatest(wx0, fx0)) * greatest(0D, least(wy1, fy1) - greatest(wy0, fy0)) / (" + box("w") + ")"
    most = hidden.groupBy(*key).agg(F.max(F.expr(part)).alias("fraction"))
    return on_page.select(*key).join(most, key, "left").na.fill(0.0, ["fraction"])


def merged_boxes(boxes: DataFrame, by: list[str], order: str) -> DataFrame:
    """Boxes with equal ``by`` that overlap by half of the smaller become one, greedily in ``order``.

    Returns ``by``, x0, y0, x1, y1, approx (of any), n (how many).
    """

    def merge(rows: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
        at = list(zip(rows["x0"].tolist(), rows["y0"].tolist(), rows["x1"].tolist(), rows["y1"].tolist(), rows["approx"].eq(True).tolist(), strict=True))
        first, out = [], []
        for a, b in zip(bounds, bounds[1:]):
            kept: list[list] = []
            for x0, y0, x1, y1, rough in at[a:b]:
                for k in kept:
                    common = max(0.0, min(k[2], x1) - max(k[0], x0)) * max(0.0, min(k[3], y1) - max(k[1], y0))
                    if common > 0 and common >= MERGE_OVERLAP * min((k[2] - k[0]) * (k[3] - k[1]), (x1 - x0) * (y1 - y0)):
                        k[:] = min(k[0], x0), min(k[1], y0), max(k[2], x1), max(k[3], y1), k[4] or rough, k[5] + 1
                        break
                else:
                    kept.append([x0, y0, x1, y1, rough, 1])
            first += [a] * len(kept)
            out += kept
        names = rows[["_key"]].iloc[first].reset_index(drop=True)
        return pd.concat([names, pd.DataFrame(out, columns=["x0", "y0", "x1", "y1", "approx", "n"])], axis=1)

    b = boxes.select(*by, order, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "approx")
    return _in_groups(b, by, order, merge, "x0 double, y0 double, x1 double, y1 double, approx boolean, n long")


def split_at_edge(hits: DataFrame, glyphs: str = "glyphs") -> DataFrame:
    """``shown`` and ``hidden``: a match's glyphs (an array of structs with ``visible``) on and off the page."""
    return hits.withColumn("shown", F.filter(glyphs, lambda g: g["visible"])).withColumn("hidden", F.filter(glyphs, lambda g: ~g["visible"]))


def ocr_too_large(width, height):
    return F.greatest(width, height) > OCR_LONGEST_SIDE


def text_sized(width, height):
    """Large enough to hold a line of text; an unknown size counts."""
    known = width.isNotNull() & height.isNotNull()
    return ~known | ((F.least(width, height) >= TEXT_SHORT_SIDE) & (F.greatest(width, height) >= TEXT_LONG_SIDE))
