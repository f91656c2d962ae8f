"""Printed page numbers: candidates on a page, the best sequence, and filling of gaps."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_ROMAN = re.compile("^(?=.)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_VALUE = dict(zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)))


def from_roman(s: str) -> int | None:
    s = s.lower()
    if not _ROMAN.match(s):
        return None
    v = [_VALUE[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def candidates(header: str | None, footer: str | None, body: str | None) -> list[tuple[int, bool, float]]:
    """(value, roman, weight) of numbers at the edges of a page: footer 1, header 0.9, first and last line alone 0.6; likely years less."""
    out: dict[tuple[int, bool], float] = {}
    lines = [s for s in (body or "").split("\n") if s.strip()]
    for part, weight in ((footer, 1.0), (header, 0.9), (lines[0] if lines else None, 0.6), (lines[-1] if lines else None, 0.6)):
        if not part:
            continue
        words = part.strip().strip("-–—[]() ").split()
        if weight < 0.9 and len(words) != 1:
            continue
        for w in {words[0], words[-1]} if words else ():
            w = w.strip("-–—[]().,")
            n = int(w) if re.fullmatch(r"\d{1,4}", w) else from_roman(w)
            if n:
                roman = not w.isdigit()
                weight_of = weight * (0.5 if not roman and 1400 <= n <= 2100 else 1) * (0.7 if roman and len(w) == 1 else 1)
                out[(n, roman)] = max(out.get((n, roman), 0), weight_of)
    return [(n, r, w) for (n, r), w in sorted(out.items())]


# What a link between two readings adds to a chain.
EXACT, BREAK, MISSING_LEAF, ARABIC_AFTER_ROMAN, LATE_ARABIC = 1.0, -3.0, -1.0, 0.3, -1.0


def link(value_a, roman_a, page_a, value_b, roman_b, page_b, step: float = 1.0) -> np.ndarray:
    """Strength of reading b after reading a, over arrays: one more number for each page; plates and missing leaves cost, breaks cost most."""
    gap = page_b - page_a
    off = value_b - (value_a + step * gap)
    plates = -off / step
    s = np.full(np.broadcast(off, gap).shape, BREAK)
    s = np.where((off < 0) & (np.abs(plates - np.round(plates)) < 1e-3) & (plates <= np.minimum(4, gap - 1)), -0.9 - 0.1 * plates, s)
    s = np.where((off > 0) & (off <= 2 * max(1.0, step)), MISSING_LEAF, s)
    s = np.where(np.abs(off) < 1e-9, EXACT, s)
    s = np.where(roman_a & ~roman_b, np.where(value_b <= 1 + step * gap, ARABIC_AFTER_ROMAN, LATE_ARABIC), s)
    return np.where(~roman_a & roman_b, BREAK, s)


def sequence(pages: list[int], cands: list[list[tuple[int, bool, float]]], window: int = 150, step: float = 1.0) -> list[tuple[int, bool] | None]:
    """The reading of each page on the strongest chain (None: no reading on it)."""
    flat = [(p, i, *c) for i, (p, cs) in enumerate(zip(pages, cands)) for c in cs]
    out: list[tuple[int, bool] | None] = [None] * len(pages)
    if not flat:
        return out
    page, slot, value, roman, weight = (np.array(x) for x in zip(*flat))
    best, back = weight.astype(float), np.full(len(flat), -1)
    for k in range(len(flat)):
        before = np.flatnonzero((page[:k] < page[k]) & (page[:k] >= page[k] - window))
        if len(before):
            s = best[before] + link(value[before], roman[before], page[before], value[k], roman[k], page[k], step)
            j = int(np.argmax(s))
            if s[j] > 0:
                best[k], back[k] = weight[k] + s[j], before[j]
    k = int(np.argmax(best))
    while k >= 0:
        out[slot[k]] = (int(value[k]), bool(roman[k]))
        k = back[k]
    return out


def fill(pages: list[int], read: list[tuple[int, bool] | None]) -> list[tuple[int | None, bool, str, float]]:
    """(number, roman, origin, confidence): read, deduced between readings that agree, or extrapolated with less and less confidence.

    A document without any reading gets no numbers.
    """
    out: list[tuple[int | None, bool, str, float]] = [(None, False, "none", 0.0)] * len(pages)
    have = [i for i, r in enumerate(read) if r]
    for i in have:
        out[i] = (*read[i], "read", 0.98)
    for a, b in zip(have, have[1:]):
        if read[a][1] == read[b][1] and read[b][0] - read[a][0] == pages[b] - pages[a]:
            for i in range(a + 1, b):
                out[i] = (read[a][0] + pages[i] - pages[a], read[a][1], "deduced", 0.9)
    if have:
        for edge, run in ((have[0], range(have[0] - 1, -1, -1)), (have[-1], range(have[-1] + 1, len(pages)))):
            for i in run:
                n = read[edge][0] + pages[i] - pages[edge]
                if n >= 1:
                    out[i] = (n, read[edge][1], "extrapolated", max(0.5, 0.9 - 0.005 * abs(pages[i] - pages[edge])))
    return out


def deduce(rows: DataFrame, doc: str, page: str, header: str, footer: str, body: str) -> DataFrame:
    """doc, page, printed, roman, origin, confidence: one group for each document."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(page)
        clean = lambda s: [x if isinstance(x, str) else None for x in s]
        cands = [candidates(*x) for x in zip(clean(pdf[header]), clean(pdf[footer]), clean(pdf[body]))]
        pages = [int(p) for p in pdf[page]]
        got = fill(pages, sequence(pages, cands))
        return pd.DataFrame({doc: pdf[doc].to_numpy(), page: pages, "printed": pd.array([g[0] for g in got], "Int32"), "roman": [g[1] for g in got], "origin": [g[2] for g in got], "confidence": [g[3] for g in got]})

    return rows.groupBy(doc).applyInPandas(one, f"{doc} {rows.schema[doc].dataType.simpleString()}, {page} int, printed int, roman boolean, origin string, confidence double")


def estimate_step(cands: DataFrame, doc: str, page: str, value: str, roman: str, weight: str) -> DataFrame:
    """doc, step, and the votes for 1, 2 and 1/2: by how much printed numbers grow from page to page.

    Reliable readings (weight 0.5 or more) of one kind, one to four pages apart, vote with the smaller weight; 2 or
    1/2 needs half as much again as 1 has, and two votes.
    """
    c = cands.where(F.col(weight) >= 0.5).select(doc, F.col(page).alias("_p"), F.col(value).alias("_v"), F.col(roman).alias("_r"), F.col(weight).alias("_w"))
    later = c.select(doc, F.col("_p").alias("_q"), F.col("_v").alias("_u"), F.col("_r").alias("_r"), F.col("_w").alias("_x"))
    ahead = c.withColumn("_q", F.explode(F.array(*[F.col("_p") + i for i in (1, 2, 3, 4)])))
    slope = (F.col("_u") - F.col("_v")) / (F.col("_q") - F.col("_p"))
    votes = ahead.join(later, [doc, "_r", "_q"]).select(doc, slope.alias("_s"), F.least("_w", "_x").alias("_w"))
    by = lambda s: F.round(F.sum(F.when(F.abs(F.col("_s") - s) < 1e-9, F.col("_w")).otherwise(0.0)), 6)
    got = votes.groupBy(doc).agg(by(1).alias("v1"), by(2).alias("v2"), by(0.5).alias("v05"))
    step = F.when((F.col("v2") > F.col("v1") * 1.5) & (F.col("v2") >= 2), 2.0).when((F.col("v05") > F.col("v1") * 1.5) & (F.col("v05") >= 2), 0.5).otherwise(1.0)
    return got.withColumn("step", step)


#: Headings that mark parts of a book, as patterns over comparison keys; a parameter of ``markers``.
MARKERS = {
    "contents": r"^(table of )?contents$|^(tabla de contenidos|indice( general)?|sumario|table des matieres|inhalt(sverzeichnis)?)$",
    "preface": r"^(preface|foreword|prologo|prefacio|avant propos|vorwort|prefazione)( |$)",
    "introduction": r"^(introduction|introduccion|einleitung|introduzione)( |$)",
    "chapter": r"^(chapter|capitulo|chapitre|kapitel|capitolo) (\d+|[ivxlc]+)( |$)",
    "part": r"^(part|parte|partie|teil) (\d+|[ivxlc]+|primera|segunda|first|second)( |$)",
    "index": r"^(index|indice (analitico|onomastico|de nombres)|register)$",
    "references": r"^(references|bibliography|bibliografia|bibliographie|literatur(verzeichnis)?)$",
}


def markers(line: Column, patterns: dict[str, str] | None = None) -> Column:
    """Which part of a book a heading line begins; null for other lines."""
    k = T.key(line)
    out = F.lit(None).cast("string")
    for name, pattern in reversed((patterns or MARKERS).items()):
        out = F.when(k.rlike(pattern), name).otherwise(out)
    return out


def zones(pages: list[int], read: list[tuple[int, bool] | None]) -> list[tuple[int, int, int, bool]]:
    """(from, to, page less number, roman) of stretches that agree on the difference; two misses in a row are borne, two readings are needed."""
    out = []
    for kind in (True, False):
        rows = [(p, r[0]) for p, r in zip(pages, read) if r is not None and r[1] == kind]
        at = 0
        while at < len(rows):
            shift, last, agreed, missed = rows[at][0] - rows[at][1], at, 0, 0
            for j in range(at, len(rows)):
                if rows[j][0] - rows[j][1] == shift:
                    agreed, last, missed = agreed + 1, j, 0
                else:
                    missed += 1
                    if missed > 2:
                        break
            if agreed >= 2 or (agreed == 1 and len(rows) <= 2):
                out.append((rows[at][0], rows[last][0], shift, kind))
            at = last + 1
    return sorted(out)


def by_zones(pages: list[int], read: list[tuple[int, bool] | None]) -> list[tuple[int | None, bool, str, float]]:
    """(number, roman, origin, confidence) of every page from its zones: read 0.98, within 0.9, beyond the last reading less and less, before the first at most six pages."""
    found = zones(pages, read)
    none = (None, False, "none", 0.0)
    if not found:
        return [(*r, "read", 0.5) if r else none for r in read]
    out = []
    for p, r in zip(pages, read):
        i = max((i for i, z in enumerate(found) if z[0] <= p), default=None)
        if i is not None:
            _, to, shift, roman = found[i]
            n = p - shift
            if n < 1:
                out.append(none)
            elif r == (n, roman):
                out.append((n, roman, "read", 0.98))
            else:
                sure = 0.9 if p <= to else max(0.55, 0.88 - 0.01 * (p - to))
                out.append((n, roman, "deduced", round(sure - (0.1 if r else 0), 6)))
            continue
        begin, _, shift, roman = found[0]
        if not roman and p - shift >= 1 and begin - p <= 6:
            out.append((p - shift, False, "deduced", 0.6))
        elif r and r[0] <= len(pages) + 20:
            out.append((*r, "read", 0.4))
        else:
            out.append(none)
    return out


def deduce_by_zones(rows: DataFrame, doc: str, page: str, value: str, roman: str) -> DataFrame:
    """doc, page, printed, roman, origin, confidence: pages whose visible number is ``value`` (null where none), one group for each document."""
    kind = rows.schema[doc].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(page)
        read = [None if pd.isna(v) else (int(v), bool(r)) for v, r in zip(pdf[value], pdf[roman])]
        got = by_zones(pdf[page].astype(int).tolist(), read)
        out = pd.DataFrame(got, columns=["printed", "roman", "origin", "confidence"])
        out.insert(0, "page", pdf[page].astype(int).tolist())
        out.insert(0, doc, pdf[doc].tolist())
        out["printed"] = out["printed"].astype("Int64")
        return out

    return rows.groupBy(doc).applyInPandas(run, f"{doc} {kind}, page int, printed long, roman boolean, origin string, confidence double")


def reanchor(rows: DataFrame, folios: DataFrame, doc: str, columns: dict[str, str]) -> DataFrame:
    """Rows with their printed numbers taken anew from ``folios`` (doc, page, printed): ``columns`` maps each physical page column to its printed one; adds changed."""
    out = rows
    for i, physical in enumerate(columns):
        f = folios.select(F.col(doc), F.col("page").alias(physical), F.col("printed").alias(f"_p{i}"))
        out = out.join(f, [doc, physical], "left")
    differs = [~F.col(f"_p{i}").eqNullSafe(F.col(printed)) for i, printed in enumerate(columns.values())]
    changed = differs[0]
    for x in differs[1:]:
        changed = changed | x
    new = {printed: F.col(f"_p{i}") for i, printed in enumerate(columns.values())}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns], changed.alias("changed"))
