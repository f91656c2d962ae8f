"""Formats to blocks of text: HTML, Markdown, plain text, RTF, EPUB, DOCX, XLSX, PPTX, CSV, by magic bytes."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_html(html: Column) -> Column:
    """Text of a page by patterns only: scripts, styles, comments and tags out, white space as one space."""
    x = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "))


def kind_of(head: bytes, name: str = "", names: list[str] | None = None) -> str:
    """Format by first bytes, then what a zip holds, then the file's name."""
    for magic, kind in ((b"%PDF", "pdf"), (b"{\\rtf", "rtf"), (b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg"), (b"ID3", "mp3"), (b"OggS", "ogg"), (b"RIFF", "riff"), (b"\x1f\x8b", "gzip"), (b"SQLite format 3", "sqlite")):
        if head.startswith(magic):
            return kind
    if head.startswith(b"PK"):
        inside = " ".join(names or [])
        for part, kind in (("word/document.xml", "docx"), ("ppt/slides/", "pptx"), ("xl/workbook.xml", "xlsx"), ("META-INF/container.xml", "epub"), ("content.xml", "odt")):
            if part in inside:
                return kind
        return "zip"
    text = head[:512].lstrip().lower()
    if text.startswith((b"<!doctype html", b"<html")):
        return "html"
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return {"htm": "html", "markdown": "md"}.get(ext, ext) or "txt"


def decode(data: bytes) -> str:
    """Text of bytes: by byte order mark, else UTF-8, else Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


Block = tuple[str, int, str]  # kind (heading, paragraph, row, note), level, text


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[Block] = []
        self.words: list[str] = []
        self.kind, self.level, self.skip = "paragraph", 0, 0

    def _end(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append((self.kind, self.level, text))
        self.kind, self.level = "paragraph", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.skip += 1
        if re.fullmatch("h[1-6]", tag):
            self._end()
            self.kind, self.level = "heading", int(tag[1])
        elif tag in ("p", "div", "li", "tr", "blockquote", "pre", "section", "article", "td", "th", "dt", "dd", "figcaption"):
            self._end()
        elif tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]|p|div|li|tr|blockquote|pre|section|article|td|th|dt|dd|figcaption", tag):
            self._end()

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def from_html(text: str) -> list[Block]:
    p = _Blocks()
    p.feed(text)
    p.close()
    p._end()
    return p.out


def from_markdown(text: str) -> list[Block]:
    out: list[Block] = []
    for part in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        part = part.strip()
        if m := re.match(r"(#{1,6})\s+(.*)", part):
            out.append(("heading", len(m[1]), re.sub(r"\s*#+$", "", m[2].split("\n")[0])))
            part = part[m.end() :].strip()
        elif m := re.fullmatch(r"(.+)\n(=+|-+)", part):
            out.append(("heading", 1 if m[2][0] == "=" else 2, m[1]))
            continue
        if m := re.match(r"\[\^([^\]]+)\]:\s*(.*)", part, re.S):
            out.append(("note", 0, m[2]))
        elif part:
            plain = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", part)
            out.append(("paragraph", 0, " ".join(re.sub(r"[*_`]{1,3}", "", plain).split())))
    return out


def from_text(text: str) -> list[Block]:
    return [("paragraph", 0, " ".join(p.split())) for p in re.split(r"\n\s*\n", text.replace("\r\n", "\n")) if p.strip()]


def from_rtf(text: str) -> list[Block]:
    text = re.sub(r"\{\\\*[^{}]*\}|\{\\(?:fonttbl|colortbl|stylesheet|info)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\s?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n\n", text)
    return from_text(re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text))


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def from_docx(z: zipfile.ZipFile) -> list[Block]:
    out: list[Block] = []
    for p in _xml(z, "word/document.xml").iter():
        if _local(p.tag) != "p":
            continue
        text = " ".join("".join(t.text or "" if _local(t.tag) == "t" else " " if _local(t.tag) in ("tab", "br") else "" for t in p.iter()).split())
        style = next((v for s in p.iter() if _local(s.tag) == "pStyle" for v in s.attrib.values()), "")
        m = re.match(r"(?:Heading|Ttulo|Titre|berschrift)\s?(\d)", style)
        if text:
            out.append(("heading", int(m[1]), text) if m else ("paragraph", 0, text))
    return out


def from_pptx(z: zipfile.ZipFile) -> list[Block]:
    out: list[Block] = []
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for n in slides:
        for i, p in enumerate(x for x in _xml(z, n).iter() if _local(x.tag) == "p"):
            text = "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip()
            if text:
                out.append(("heading" if i == 0 else "paragraph", 1 if i == 0 else 0, text))
    return out


def from_xlsx(z: zipfile.ZipFile) -> list[Block]:
    shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    out: list[Block] = []
    for n in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        rows = []
        for r in (x for x in _xml(z, n).iter() if _local(x.tag) == "row"):
            cells = []
            for c in r:
                v = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v else v)
            rows.append(cells)
        out += from_rows(rows)
    return out


def from_rows(rows: list[list[str]]) -> list[Block]:
    """Table rows as blocks: trailing empty cells go, the first row that has any cell is the header, unnamed columns are ColN."""
    rows = [[(c or "").strip() for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if not rows:
        return []
    width = max(max(i + 1 for i, c in enumerate(r) if c) for r in rows)
    head = [(rows[0][i] if i < len(rows[0]) else "") or f"Col{i + 1}" for i in range(width)]
    return [("row", 0, "; ".join(f"{h}: {c}" for h, c in zip(head, r) if c)) for r in rows[1:]]


def from_csv(text: str) -> list[Block]:
    first = text.split("\n", 1)[0]
    mark = max(",;\t|", key=first.count)
    return from_rows(list(csv.reader(io.StringIO(text), delimiter=mark)))


def from_epub(z: zipfile.ZipFile) -> list[Block]:
    root = next(e.attrib["full-path"] for e in _xml(z, "META-INF/container.xml").iter() if _local(e.tag) == "rootfile")
    book = _xml(z, root)
    items = {e.attrib["id"]: e.attrib["href"] for e in book.iter() if _local(e.tag) == "item"}
    base = root.rsplit("/", 1)[0] + "/" if "/" in root else ""
    out: list[Block] = []
    for ref in (e.attrib["idref"] for e in book.iter() if _local(e.tag) == "itemref"):
        if ref in items and base + items[ref] in z.namelist():
            out += from_html(decode(z.read(base + items[ref])))
    return out


def from_odt(z: zipfile.ZipFile) -> list[Block]:
    out: list[Block] = []
    for e in _xml(z, "content.xml").iter():
        if _local(e.tag) in ("h", "p"):
            text = " ".join("".join(e.itertext()).split())
            level = next((int(v) for k, v in e.attrib.items() if _local(k) == "outline-level"), 1)
            if text:
                out.append(("heading", level, text) if _local(e.tag) == "h" else ("paragraph", 0, text))
    return out


def blocks(data: bytes, name: str = "") -> list[Block]:
    """Blocks of a file of any known format; unknown binary formats give none."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            kind = kind_of(data, name, z.namelist())
            reader = {"docx": from_docx, "pptx": from_pptx, "xlsx": from_xlsx, "epub": from_epub, "odt": from_odt}.get(kind)
            return reader(z) if reader else []
    kind = kind_of(data[:600], name)
    reader = {"html": from_html, "md": from_markdown, "txt": from_text, "rtf": from_rtf, "csv": from_csv, "tsv": from_csv}.get(kind)
    return reader(decode(data)) if reader else []


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, place, kind, level, text, section (headings above, joined by >): files of any format under a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                above: list[tuple[int, str]] = []
                for i, (kind, level, text) in enumerate(blocks(bytes(data), p)):
                    if kind == "heading":
                        above = [h for h in above if h[0] < level] + [(level, text)]
                    rows.append((p, i, kind, level, unescape(text), " > ".join(t for _, t in above)))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "place", "kind", "level", "text", "section"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, place int, kind string, level int, text string, section string")
