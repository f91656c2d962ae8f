"""Filters: metadata filter language, allowed documents, filters said in a query."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def compile_filter(spec: dict) -> Column:
    """A column predicate of a dictionary: equality, or $eq $ne $in $nin $lt $lte $gt $gte; an unknown operator holds for no row."""
    out = F.lit(True)
    for name, want in spec.items():
        c = F.col(name)
        for op, v in want.items() if isinstance(want, dict) else [("$eq", want)]:
            one = {
                "$eq": lambda: c == v,
                "$ne": lambda: c.isNull() | (c != v),
                "$in": lambda: c.isin(v) if v else F.lit(False),
                "$nin": lambda: c.isNull() | ~c.isin(v) if v else F.lit(True),
                "$lt": lambda: c < v,
                "$lte": lambda: c <= v,
                "$gt": lambda: c > v,
                "$gte": lambda: c >= v,
            }.get(op, lambda: F.lit(False))()
            out = out & F.coalesce(one, F.lit(False))
    return out


def allowed(docs: DataFrame, ids: list | None = None, types: list[str] | None = None, authors: list[str] | None = None, languages: list[str] | None = None, years: tuple[int | None, int | None] | None = None, key: str = "doc_id", columns: dict[str, str] | None = None) -> DataFrame:
    """Documents that meet every given filter; None means no filter, an empty list no document.

    Years are bounds on the original year or else the edition's; an unknown year or language meets no bound.
    """
    c = {"type": "type", "authors": "authors", "language": "lang", "year": "year", "original": "original_year"} | (columns or {})
    tests = []
    if ids is not None:
        tests.append(F.col(key).isin(ids) if ids else F.lit(False))
    if types is not None:
        tests.append(F.col(c["type"]).isin(types) if types else F.lit(False))
    if authors is not None:
        name = T.fold(F.col(c["authors"]))
        tests.append(reduce(lambda a, b: a | b, [name.contains(a.lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))) for a in authors], F.lit(False)))
    if languages is not None:
        tests.append(F.substring(F.lower(F.col(c["language"])), 1, 2).isin([x[:2].lower() for x in languages]) if languages else F.lit(False))
    if years is not None:
        y = F.coalesce(F.col(c["original"]), F.col(c["year"])) if c["original"] in docs.columns else F.col(c["year"])
        tests += [t for t in (y >= years[0] if years[0] is not None else None, y <= years[1] if years[1] is not None else None) if t is not None]
        tests.append(y.isNotNull())
    return docs.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def merge_years(a: tuple[int | None, int | None], b: tuple[int | None, int | None]) -> tuple[int | None, int | None]:
    """Bounds that meet both: the larger lower and the smaller upper one."""
    low = [x for x in (a[0], b[0]) if x is not None]
    high = [x for x in (a[1], b[1]) if x is not None]
    return (max(low) if low else None, min(high) if high else None)


_YEAR = r"(1\d{3}|20\d{2})"


def said_years(query: Column) -> tuple[Column, Column]:
    """Year bounds said in a query (between, from-to, before, after, until, since), null where not said."""
    k = T.key(query)
    pair = rf"(?:between|entre|from|de|zwischen|desde) {_YEAR} (?:and|y|et|to|a|und|hasta) {_YEAR}"
    before, after = rf"(?:before|antes de|avant|vor) {_YEAR}", rf"(?:after|despues de|apres|nach) {_YEAR}"
    until, since = rf"(?:until|hasta|jusqu en|bis) {_YEAR}", rf"(?:since|desde|depuis|seit) {_YEAR}"
    num = lambda p, g=1: F.nullif(F.regexp_extract(k, p, g), F.lit("")).cast("int")
    low = F.coalesce(num(pair), num(after) + 1, num(since))
    high = F.coalesce(num(pair, 2), num(before) - 1, num(until))
    return low, high


# What a query that asks for a page begins with, how it says page, and what comes before a title.
GO_TO = "ir a, ir a la, ve a, ve a la, abre, abre la, go to, go to page, aller a la"
PAGE = "pagina, pag, pag., p., p, page, folio, fol., seite, pagine"
OF = "de, del, of, in, en, di, von"


def said_folio(query: Column) -> tuple[Column, Column]:
    """(folio, title) of a query that asks for a page and nothing else («p. xiv», «page 199 of Don Quixote»); null where not said.

    Folios are as written, in Arabic or small Roman numbers; the title is as the query has it.
    """
    among = lambda words: "(?:" + "|".join(sorted((re.escape(w) for w in words.split(", ")), key=len, reverse=True)) + ")"
    k = T.fold(query)
    form = rf"^\s*(?:{among(GO_TO)}\s+)?(?:{among(PAGE)}\s*)?([0-9]{{1,5}}|[ivxlcdm]{{1,8}})(?![\p{{L}}\p{{N}}])(?:\s+{among(OF)}\s+(.+?))?\s*$"
    asked = k.rlike(rf"^\s*(?:{among(GO_TO)}\s+)?{among(PAGE)}(?!\p{{L}})\s*([0-9]|[ivxlcdm])") | k.rlike(r"^\s*go to page\s")
    folio = F.when(asked, F.nullif(F.regexp_extract(k, form, 1), F.lit("")))
    rest = F.when(asked, F.regexp_extract(k, form, 2))
    # Folding keeps lengths, so the title is cut from the query itself.
    tail = F.regexp_replace(query, r"\s+$", "")
    return folio, F.nullif(F.trim(F.substring(tail, F.length(tail) - F.length(rest) + 1, F.length(rest))), F.lit(""))


def said_page(query: Column) -> Column:
    """Number of the page asked for in a query («go to page 12», «p. 12»), else null."""
    return F.try_to_number(said_folio(query)[0], F.lit("99999")).cast("int")


def said_authors(query: Column, authors: Column) -> Column:
    """Which of a list of known authors a query names, as whole words, of three characters or more."""
    k = F.concat(F.lit(" "), T.key(query), F.lit(" "))
    return F.array_distinct(F.filter(authors, lambda a: (F.length(T.key(a)) >= 3) & F.contains(k, F.concat(F.lit(" "), T.key(a), F.lit(" ")))))


def overlaps_span(lo: Column, hi: Column, start, end) -> Column:
    """Whether [lo, hi] meets [start, end]; null borders meet nothing."""
    return F.coalesce((lo <= F.lit(end)) & (hi >= F.lit(start)), F.lit(False))


def is_paratext(title: Column, body: Column) -> Column:
    """Indexes and tables of contents: by heading, by more than half of lines ending in a number, or by many «word number» pairs in a short text."""
    lines = F.filter(F.split(body, "\n"), lambda s: F.length(F.trim(s)) > 0)
    toc = F.size(F.filter(lines, lambda s: s.rlike(r"[.…\s]{2,}\d+\s*$")))
    by_title = T.key(title).rlike("^(index|indice|contents|table of contents|tabla de contenidos|table des matieres|inhalt|inhaltsverzeichnis)$")
    pairs = F.size(F.regexp_extract_all(body, F.lit(r"\p{L}+,? \d+[.;]"), F.lit(0)))
    return F.coalesce(by_title, F.lit(False)) | ((F.size(lines) > 0) & (toc * 2 > F.size(lines))) | ((F.length(body) < 300) & (pairs >= 3))


def year_pattern() -> re.Pattern:
    return re.compile(_YEAR)
