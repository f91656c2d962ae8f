"""Page layout: boxes of words become lines, blocks and zones, in reading order.

Words become lines by windows over a page; what is left is one page at a time, as an array: header and footer zones,
blocks of lines, and their order by recursive cuts along the widest gaps (XY-cut).
Coordinates are shares of the page, from its upper left corner.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import structure

# The share of a page that is header or footer, and the least gap between columns.
ZONE, GUTTER = 0.08, 0.015


def lines(words: DataFrame, page: list[str], x: str = "x", y: str = "y", w: str = "w", h: str = "h", text: str = "text", size: str = "size") -> DataFrame:
    """page, x0, y0, x1, y1, size, text: runs of words at one height without a gap of more than two and a half heights."""
    mid = F.col(y) + F.col(h) / 2
    down = Window.partitionBy(*page).orderBy("_m", x)
    rows = words.where(F.trim(text) != "").withColumn("_m", mid)
    rows = rows.withColumn("_l", F.sum(F.coalesce((F.col("_m") - F.lag("_m").over(down) > F.col(h) / 2).cast("int"), F.lit(1))).over(down))
    across = Window.partitionBy(*page, "_l").orderBy(x, "_m")
    gap = F.col(x) - F.max(F.col(x) + F.col(w)).over(across.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_s", F.sum(F.coalesce((gap > 2.5 * F.col(h)).cast("int"), F.lit(0))).over(across))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(x, "_m", F.trim(text).alias("_t")))), lambda p: p["_t"]), " ")
    return rows.groupBy(*page, "_l", "_s").agg(
        F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(F.col(x) + F.col(w)).alias("x1"), F.max(F.col(y) + F.col(h)).alias("y1"), F.median(size).alias("size"), joined.alias("text")
    ).drop("_l", "_s")


def widest(boxes: list, axis: int) -> tuple[float, float]:
    """(width, middle) of the widest stretch of an axis that no box covers; (0, 0) where there is none."""
    best, reach = (0.0, 0.0), None
    for b in sorted(boxes, key=lambda b: b[axis]):
        if reach is not None and b[axis] - reach > best[0]:
            best = (b[axis] - reach, (b[axis] + reach) / 2)
        reach = b[axis + 2] if reach is None else max(reach, b[axis + 2])
    return best


def reading_order(boxes: list[tuple]) -> list[tuple]:
    """Boxes (x0, y0, x1, y1, …) in the order of reading.

    Cut along the widest gap: between columns where it is wide enough and no clear gap goes across, else between what is
    above and below; without a gap by height, then from the left.
    """
    out, todo = [], [list(boxes)]
    while todo:
        now = todo.pop()
        gx, at_x = widest(now, 0)
        gy, at_y = widest(now, 1)
        if len(now) > 1 and gx > 0 and (gx >= GUTTER and gy < 0.02 or gy <= 0):
            axis, at = 0, at_x
        elif len(now) > 1 and gy > 0:
            axis, at = 1, at_y
        else:
            out += sorted(now, key=lambda b: (b[1], b[0]))
            continue
        todo += [[b for b in now if b[axis + 2] > at], [b for b in now if b[axis + 2] <= at]]
    return out


def joined(texts: list[str]) -> str:
    """Lines as one text: a word parted by a hyphen is joined where the rest begins in lower case."""
    out = ""
    for t in texts:
        if re.search(r"[^\W\d_]-$", out) and t[:1].islower():
            out = out[:-1] + t
        else:
            out = f"{out} {t}" if out else t
    return out


def neighbours(own: np.ndarray, least_cover: float, gaps: tuple[float, float], ratio: float) -> np.ndarray:
    """Which lines (x0, y0, x1, y1, size) follow which: row above, column below.

    They cover enough of each other's width, the gap between them is within so many heights of the lower one, and sizes differ
    by less than a ratio.
    """
    x0, y0, x1, y1, size = own.T
    cover = np.minimum(x1[:, None], x1) - np.maximum(x0[:, None], x0)
    wide = np.minimum((x1 - x0)[:, None], x1 - x0)
    gap = (y0 - y1[:, None]) / np.maximum(y1 - y0, 1e-9)
    alike = np.maximum(size[:, None], size) < ratio * np.maximum(0.1, np.minimum(size[:, None], size))
    return (cover > least_cover * wide) & (gap > gaps[0]) & (gap < gaps[1]) & alike & (y0[:, None] < y0)


def blocks(own: list[tuple]) -> list[list[tuple]]:
    """Lines (x0, y0, x1, y1, size, text) of one page in blocks, each line with the lowest one above that it follows."""
    if not own:
        return []
    own = sorted(own, key=lambda s: (s[1], s[0]))
    at = np.array([s[:5] for s in own], float)
    follows = neighbours(at, 0.5, (-0.6, 0.9), 1.25)
    block = list(range(len(own)))
    for below in range(len(own)):
        above = np.flatnonzero(follows[:, below])
        if len(above):
            block[below] = block[above[np.argmax(at[above, 3])]]
    members: dict[int, list[tuple]] = {}
    for b, s in zip(block, own):
        members.setdefault(b, []).append(s)
    frame = lambda ls: (min(s[0] for s in ls), min(s[1] for s in ls), max(s[2] for s in ls), max(s[3] for s in ls))
    return [b[4] for b in reading_order([(*frame(ls), ls) for ls in members.values()])]


def zones(own: list[tuple]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Header, body and footer of a page's lines; a wide line in a margin that follows the body, or that the body follows, belongs to it."""
    if not own:
        return [], [], []
    own = sorted(own, key=lambda s: (s[1], s[0]))
    at = np.array([s[:5] for s in own], float)
    head, foot = at[:, 3] <= ZONE + 0.005, at[:, 1] >= 1 - ZONE - 0.005
    body = ~head & ~foot
    next_to = neighbours(at, 0.3, (-0.3, 0.8), 1.15)
    wide = at[:, 2] - at[:, 0] > 0.25
    # From the body outwards: what is taken in may take in the next line.
    for i in [*np.flatnonzero(foot), *np.flatnonzero(head)[::-1]]:
        body[i] = wide[i] and bool((next_to[:, i] & body).any() if foot[i] else (next_to[i] & body).any())
    part = lambda which: [s for s, k in zip(own, which & ~body) if k]
    return part(head), [s for s, k in zip(own, body) if k], part(foot)


def laid_out(page_lines: DataFrame, page: list[str]) -> DataFrame:
    """page, place, zone (header, body, footer), block, text: one row for each block of the body and each line of the margins, in reading order."""
    kinds = dict(page_lines.dtypes)
    row = F.struct("x0", "y0", "x1", "y1", "size", "text")
    pages = page_lines.groupBy(*page).agg(F.sort_array(F.collect_list(row)).alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in structure.small(batches, 200):
            out = []
            for keys, own in zip(pdf[page].itertuples(index=False), pdf["own"]):
                head, body, foot = zones([tuple(s[c] for c in ("x0", "y0", "x1", "y1", "size", "text")) for s in own])
                found = [("header", None, s[5]) for s in head] + [("body", i, joined([s[5] for s in sorted(b, key=lambda s: s[1])])) for i, b in enumerate(blocks(body))] + [("footer", None, s[5]) for s in foot]
                out += [(*keys, i, *f) for i, f in enumerate(found)]
            if out:
                yield pd.DataFrame(out, columns=[*page, "place", "zone", "block", "text"]).astype({"block": "Int32"})

    schema = ", ".join(f"{c} {kinds[c]}" for c in page) + ", place int, zone string, block int, text string"
    return pages.mapInPandas(run, schema)
