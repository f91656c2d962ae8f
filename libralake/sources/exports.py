"""Exports: tables as NDJSON with a manifest, reports as CSV, JSON lines, BibTeX, RIS, TEI, HTML."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import counts


def ndjson(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes every table as JSON lines and the manifest (name, n) beside them; gives the manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    manifest = counts(tables)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def escaped(x: Column) -> Column:
    """Text safe inside XML and HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def tei(df: DataFrame, text: str, source: str) -> DataFrame:
    """One TEI quotation for each row."""
    return df.select(F.concat(F.lit('<cit><quote>'), escaped(F.col(text)), F.lit("</quote><bibl>"), escaped(F.col(source)), F.lit("</bibl></cit>")).alias("value"))


def html_rows(df: DataFrame) -> DataFrame:
    """One table row for each row."""
    cells = [F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", re.S)
_ACCENT = {"'": "\u0301", "`": "\u0300", '"': "\u0308", "^": "\u0302", "~": "\u0303", "c": "\u0327"}


def latex_to_text(s: str) -> str:
    """Accents written as commands become letters; braces go."""
    import unicodedata

    s = re.sub(r"\\([\'`\"^~c])\s*\{?\\?([A-Za-z])\}?", lambda m: unicodedata.normalize("NFC", m[2] + _ACCENT[m[1]]), s)
    return re.sub(r"[{}]", "", s.replace("--", "–").replace("\\&", "&")).strip()


def parse_bibtex(text: str) -> list[dict[str, str]]:
    """Entries of a BibTeX text: type, key and fields, with balanced braces and quoted values."""
    out = []
    for m in _ENTRY.finditer(text):
        fields, at, depth = {"type": m[1].lower(), "key": m[2]}, m.end(), 1
        while at < len(text) and depth:
            f = re.compile(r"\s*,?\s*(\w+)\s*=\s*").match(text, at)
            if not f:
                break
            at = f.end()
            if text[at] == "{":
                start, level = at + 1, 1
                at += 1
                while at < len(text) and level:
                    level += {"{": 1, "}": -1}.get(text[at], 0)
                    at += 1
                value = text[start : at - 1]
            elif text[at] == '"':
                end = text.index('"', at + 1)
                value, at = text[at + 1 : end], end + 1
            else:
                v = re.compile(r"[^,}\s]+").match(text, at)
                value, at = (v[0], v.end()) if v else ("", at + 1)
            fields[f[1].lower()] = latex_to_text(value)
        out.append(fields)
    return out


def authors(names: str) -> list[tuple[str, str]]:
    """(surname, given names) of «A and B» lists; particles stay with the surname."""
    out = []
    for n in re.split(r"\s+and\s+|;", names):
        n = n.strip()
        if not n:
            continue
        if "," in n:
            a, b = n.split(",", 1)
            out.append((a.strip(), b.strip()))
        else:
            w = n.split()
            k = len(w) - 1
            while k > 1 and w[k - 1].islower():
                k -= 1
            out.append((" ".join(w[k:]), " ".join(w[:k])))
    return out
