"""Windows, highlights, claims, sentences and marks in texts; evidence narrowed to literal quotations."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .structure import sentences, skeleton, small


def term_pattern(terms: list[str], extra: int = 3) -> str:
    """Whole words, or with up to ``extra`` letters more."""
    return r"\b(?:" + "|".join(sorted(map(re.escape, terms), key=len, reverse=True)) + rf")\p{{L}}{{0,{extra}}}\b"


def n_matches(x: Column, terms: list[str]) -> Column:
    return F.size(F.regexp_extract_all(T.fold(x), F.lit(term_pattern(terms)), F.lit(0)))


def distinct_matches(x: Column, terms: list[str]) -> Column:
    """How many of the terms a text has."""
    low = T.fold(x)
    out = F.lit(0)
    for t in terms:
        out = out + low.rlike(term_pattern([t])).cast("int")
    return out


def marked(x: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text, safe for HTML, with its matches between marks (terms with their accents, either case)."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    loose = "|".join("".join(f"[{c}{''.join(a for a, p in zip(T.ACCENTED, T.PLAIN) if p == c)}]" if c.isalpha() else re.escape(c) for c in t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(x, rf"(?iu)\b(?:{loose})\p{{L}}{{0,3}}\b", f"{before}$0{after}")


def best_window(text: str, terms: set[str], size: int = 280) -> tuple[int, int]:
    """The stretch of ``size`` characters with most matches; it starts a quarter before the first of them."""
    low = text.lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))
    at = [m.start() for m in re.finditer(r"[^\W_]+", low) if any(m[0].startswith(t) and len(m[0]) <= len(t) + 3 for t in terms)]
    if not at:
        return 0, min(size, len(text))
    best = max(at, key=lambda p: (bisect_left(at, p + size * 3 // 4) - bisect_left(at, p), -p))
    start = max(0, min(best - size // 4, len(text) - size))
    return start, min(len(text), start + size)


def windows(docs: DataFrame, terms: list[str], key: str, text: str, size: int = 280) -> DataFrame:
    """key, start, end of each text's best window."""
    wanted = set(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small(batches):
            found = [best_window(t or "", wanted, size) for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "start": [a for a, _ in found], "end": [b for _, b in found]})

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInPandas(run, f"{key} long, start int, end int")


_CITED = re.compile(r"\([^()]*\b(?:1[5-9]|20)\d{2}[a-z]?[^()]*\)|\[\d+(?:[,;–-]\s*\d+)*\]|\[\^\w+\]")


def paragraphs(text: str, least: int = 200) -> list[tuple[int, int]]:
    """Spans of paragraphs; short ones join the next, headings close one."""
    out: list[list[int]] = []
    closed = True
    for m in re.finditer(r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*", text):
        heading = m[0].lstrip().startswith("#") or (len(m[0]) < 80 and not re.search(r"[.!?:;,]$", m[0].strip()))
        if out and not closed and out[-1][1] - out[-1][0] < least and not heading:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
        closed = heading
    return [(a, b) for a, b in out]


def claims(text: str, least: int = 25) -> list[tuple[int, int, bool]]:
    """Sentences long enough to be claims, and whether each has a citation already."""
    return [(a, b, bool(_CITED.search(text[a:b]))) for a, b in sentences(text) if b - a >= least and not text[a:b].lstrip().startswith("#")]


def claim_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, claim, start, end, cited: the claims of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small(batches):
            rows = [(k, i, a, b, c) for k, t in zip(pdf[key], pdf[text]) for i, (a, b, c) in enumerate(claims(t or ""))]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "claim", "start", "end", "cited"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInPandas(run, f"{key} long, claim int, start int, end int, cited boolean")


def insertion_point(x: Column, note: bool) -> Column:
    """Where a citation goes in a sentence (characters from its start): a note after the closing mark, author and date before it."""
    body = F.length(F.regexp_replace(x, r"\s+$", ""))
    mark = F.length(F.regexp_extract(F.regexp_replace(x, r"\s+$", ""), r"[.!?…]+[\"'»”)\]]*$", 0))
    return body if note else body - mark


def group_insertions(rows: DataFrame, point: str, doc: str, anchor: str, rank: str) -> DataFrame:
    """point, citations: what is cited at one place, each document and anchor once, in order of rank."""
    once = rows.groupBy(point, doc, anchor).agg(F.min(rank).alias(rank))
    return once.groupBy(point).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank, doc, anchor))), lambda x: F.concat_ws(" ", x[doc].cast("string"), x[anchor].cast("string"))), "; ").alias("citations"))


def marks_before_stop(x: Column) -> Column:
    """Evidence marks that follow a full stop moved before it."""
    return F.regexp_replace(x, r"([.!?])(\s*)((?:\[\d+\])+)", "$3$1")


def without_locators(x: Column) -> Column:
    """Prose without page, clock and minute locators in brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*[\[(](?:pp?\.\s*\d+(?:[-–]\d+)?|\d{1,2}:\d{2}(?::\d{2})?(?:[-–]\d{1,2}:\d{2}(?::\d{2})?)?|min\.?\s*\d+)[\])]", ""), r" {2,}", " "))


def anchors_in_prose(x: Column) -> Column:
    """Pages and clock times named in prose: array of (kind, from, to); a clock time lasts 20 s."""
    pages = F.regexp_extract_all(x, F.lit(r"\bpp?\.\s*(\d+(?:[-–]\d+)?)"), F.lit(1))
    times = F.regexp_extract_all(x, F.lit(r"\b(\d{1,2}:\d{2}(?::\d{2})?)\b"), F.lit(1))
    as_page = F.transform(pages, lambda p: F.struct(F.lit("page").alias("kind"), F.element_at(F.split(p, "[-–]"), 1).cast("double").alias("from"), F.element_at(F.split(p, "[-–]"), -1).cast("double").alias("to")))
    as_time = F.transform(times, lambda t: F.struct(F.lit("time").alias("kind"), T.clock_seconds(t).alias("from"), (T.clock_seconds(t) + 20).alias("to")))
    return F.concat(as_page, as_time)


def separate_speakers(x: Column) -> Column:
    """Turns «Name: words» of a text as array of (speaker, words)."""
    lines = F.filter(F.split(x, "\n"), lambda s: F.length(F.trim(s)) > 0)
    name = r"^\s*(\p{Lu}[\p{L}.' -]{0,40}):\s+"
    return F.transform(lines, lambda s: F.struct(F.nullif(F.regexp_extract(s, name, 1), F.lit("")).alias("speaker"), F.regexp_replace(s, name, "").alias("words")))


def narrow(evidence: str, claim_terms: set[str], least: int = 400) -> tuple[int, int] | None:
    """The answering sentence of a long piece of evidence: the one with most terms of the claim, two at least."""
    if len(evidence) < least:
        return None
    best, at = 1, None
    for a, b in sentences(evidence):
        words = set(re.findall(r"[^\W_]+", evidence[a:b].lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))))
        if len(words & claim_terms) > best:
            best, at = len(words & claim_terms), (a, b)
    return at


def across_pages(quote: str, pages: list[str]) -> list[tuple[int, int, int]] | None:
    """(page, start, end) pieces of a quotation that runs over following pages, by letters; null if it stands nowhere."""
    q, _ = skeleton(quote)
    parts = [skeleton(p) for p in pages]
    whole = "".join(s for s, _ in parts)
    i = whole.find(q) if q else -1
    if i < 0:
        return None
    out, base, end = [], 0, i + len(q)
    for n, (s, at) in enumerate(parts):
        a, b = max(i, base) - base, min(end, base + len(s)) - base
        if a < b:
            out.append((n, at[a], at[b - 1] + 1))
        base += len(s)
    return out


def union_boxes(lines: DataFrame, by: list[str], x: str, y: str, w: str, h: str, gap: float = 0.03) -> DataFrame:
    """by, x, y, w, h of the tallest group of lines that lie at most ``gap`` apart."""
    order = Window.partitionBy(*by).orderBy(y)
    new = F.when(F.col(y) - F.max(F.col(y) + F.col(h)).over(order.rowsBetween(Window.unboundedPreceding, -1)) > gap, 1).otherwise(0)
    g = lines.withColumn("_new", new).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    box = g.groupBy(*by, "_g").agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(F.col(x) + F.col(w)).alias("x1"), F.max(F.col(y) + F.col(h)).alias("y1"))
    top = box.groupBy(*by).agg(F.max(F.struct("n", (-F.col("_g")).alias("o"), "x0", "y0", "x1", "y1")).alias("b"))
    return top.select(*by, F.col("b.x0").alias("x"), F.col("b.y0").alias("y"), (F.col("b.x1") - F.col("b.x0")).alias("w"), (F.col("b.y1") - F.col("b.y0")).alias("h"))
