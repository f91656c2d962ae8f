"""Documents read page by page: fragments across pages with sections, footnotes and both ends; contents anchored to paragraphs.

Paragraphs are rows; what goes on over a page end, where sections and batches begin, and which paragraphs
belong together are windows over a document.  Only the cutting of a section into fragments and the choice of anchors
are sequential: they work on the arrays of one section or of one table of contents.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import structure

_HEADING = r"^#{1,6}\s+(.+?)\s*#*$"
_ENDED = r"[.!?…:][\"'»”)\]]*(?:\[\^[^\]]+\])?\s*$"
_STUB = r"^[\p{Ll}(«\"“,;]"
_RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def paragraphs(units: DataFrame, doc: str, unit: str, text: str) -> DataFrame:
    """doc, unit, paragraph (from 0), text: the paragraphs of every unit, parted by empty lines."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return units.select(doc, unit, F.posexplode(parts).alias("paragraph", "text"))


def groups(paras: DataFrame, doc: str, unit: str, sections: DataFrame | None = None, cuts: DataFrame | None = None) -> DataFrame:
    """doc, group, section, parts (unit, paragraph, text, title, goes_on): what may be in one fragment, in order.

    A group ends where a section begins: at every heading, or where ``sections`` (doc, unit, paragraph, title) says so.  The first paragraph of a page
    goes on from the one before if that ended no sentence and it begins like the rest of one.  ``cuts`` (doc, unit) are
    units where a batch begins: a group ends there, after the rest of a paragraph, so that batches alone give the same groups inside.
    """
    w = Window.partitionBy(doc).orderBy(unit, "paragraph")
    head = F.nullif(F.regexp_extract("text", _HEADING, 1), F.lit(""))
    rows = paras.withColumn("_title", head)
    if sections is None:
        rows = rows.withColumn("_section", F.col("_title"))
    else:
        rows = rows.join(sections.select(doc, unit, "paragraph", F.col("title").alias("_section")), [doc, unit, "paragraph"], "left")
    rows = rows.join(cuts.select(doc, unit, F.lit(True).alias("_cut")), [doc, unit], "left") if cuts is not None else rows.withColumn("_cut", F.lit(False))
    plain = F.col("_title").isNull() & ~F.contains("text", F.lit("\n"))
    before = lambda c: F.lag(c).over(w)
    rows = rows.withColumns({"_p": plain, "_open": plain & ~F.col("text").rlike(_ENDED), "_stub": F.col("_title").isNull() & F.col("text").rlike(_STUB), "_cut": F.coalesce("_cut", F.lit(False)) & (F.col("paragraph") == 0)})
    goes_on = F.col("_p") & F.col("_stub") & (F.col("paragraph") == 0) & F.col("_section").isNull() & F.coalesce(before("_open") & (before(unit) < F.col(unit)), F.lit(False))
    rows = rows.withColumn("goes_on", goes_on)
    opens = F.col("_section").isNotNull() | (F.col("_cut") & ~F.col("goes_on")) | F.coalesce(before(F.col("_cut") & F.col("_section").isNull() & (F.col("goes_on") | F.col("_stub"))), F.lit(False))
    rows = rows.withColumns({"group": F.sum(opens.cast("int")).over(w), "_section": F.last("_section", ignorenulls=True).over(w)})
    part = F.struct(F.col(unit).alias("unit"), "paragraph", "text", F.col("_title").alias("title"), "goes_on")
    return rows.groupBy(doc, "group").agg(F.first("_section", ignorenulls=True).alias("section"), F.sort_array(F.collect_list(part)).alias("parts"))


def laid_out(parts: list) -> tuple[str, list[int], list[tuple[int, int, bool]]]:
    """The text of a group, and where in it each paragraph begins: offsets, and (unit, paragraph, whether it is a title)."""
    text, offsets, marks = "", [], []
    for p in parts:
        if p["title"] is not None:
            own = "## " + p["title"]
        else:
            own = p["text"]
        if p["goes_on"] and text:
            text = text[:-1] if re.search(r"[^\W\d_]-$", text) else text + " "
        elif text:
            text += "\n\n"
        offsets.append(len(text))
        marks.append((p["unit"], p["paragraph"], p["title"] is not None))
        text += own
    return text, offsets, marks


def fragments(parts: list, least: int, target: int, most: int) -> list[tuple[int, int, int, str]]:
    """(unit, paragraph, last unit, text) of the fragments of a group; the place is that of the first text, not of its title; titles alone are none."""
    text, offsets, marks = laid_out(parts)
    out, waiting = [], None
    for a, b in structure.fragments(text, least, target, most):
        first, last = max(0, bisect_right(offsets, a) - 1), bisect_right(offsets, b - 1) - 1
        body = next((i for i in range(first, last + 1) if not marks[i][2]), None)
        a, waiting = (a if waiting is None else waiting), None
        if body is None:
            waiting = a
            continue
        out.append((marks[body][0], marks[body][1], marks[last][0], text[a:b]))
    return out


def chunk(units: DataFrame, doc: str, unit: str, text: str, notes: str | None = None, sections: DataFrame | None = None, cuts: DataFrame | None = None, least: int = 250, target: int = 350, most: int = 450) -> DataFrame:
    """doc, place, unit, paragraph, unit_end, section, fragment, n_tokens: fragments that never cross a section.

    ``notes`` is an array of the footnotes of each unit: a note goes with the first fragment over its page that calls it, notes that
    nobody calls are a fragment of their page.
    """
    schema = f"{doc} long, `group` int, i int, unit int, paragraph int, unit_end int, section string, fragment string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in structure.small(batches, 100):
            rows = [(k, g, i, *f[:3], s, f[3]) for k, g, s, parts in zip(pdf[doc], pdf["group"], pdf["section"], pdf["parts"]) for i, f in enumerate(fragments(parts, least, target, most))]
            if rows:
                yield pd.DataFrame(rows, columns=[doc, "group", "i", "unit", "paragraph", "unit_end", "section", "fragment"])

    grouped = groups(paragraphs(units, doc, unit, text), doc, unit, sections, cuts)
    cut = grouped.select(F.col(doc).cast("long").alias(doc), F.col("group").cast("int").alias("group"), "section", "parts").mapInPandas(run, schema)
    placed = cut.withColumn("_at", F.struct(F.col("unit"), F.lit(0).alias("kind"), F.col("group"), F.col("i")))
    if notes:
        placed = _with_notes(placed, units.select(F.col(doc).cast("long").alias(doc), F.col(unit).cast("int").alias("_u"), F.posexplode(notes).alias("_i", "note")), doc)
    order = Window.partitionBy(doc).orderBy("_at")
    return placed.withColumn("place", F.row_number().over(order) - 1).select(doc, "place", "unit", "paragraph", "unit_end", "section", "fragment", T.token_estimate(F.col("fragment")).alias("n_tokens"))


def note_label(note: Column) -> Column:
    """What a footnote is called by: [^3]: …, 3. …, ³ …, * …; null where it has no label."""
    got = lambda p: F.nullif(F.regexp_extract(note, p, 1), F.lit(""))
    raised = F.translate(F.coalesce(got(rf"^\s*([{_RAISED}]+)"), F.lit("")), _RAISED, "0123456789")
    return F.coalesce(got(r"^\s*\[\^([^\]]+)\]:?"), F.nullif(raised, F.lit("")), got(r"^\s*(\d{1,3})[.)]?\s"), got(r"^\s*([*†‡§]+)"))


def note_calls(x: Column) -> Column:
    """Labels of the footnotes that a text calls: [^3], ³."""
    raised = F.transform(F.regexp_extract_all(x, F.lit(rf"(?<=[\p{{L}}.,;:!?»”\")])([{_RAISED}]+)"), F.lit(1)), lambda c: F.translate(c, _RAISED, "0123456789"))
    return F.array_distinct(F.concat(F.regexp_extract_all(x, F.lit(r"\[\^([^\]]+)\]"), F.lit(1)), raised))


def _with_notes(placed: DataFrame, notes: DataFrame, doc: str) -> DataFrame:
    labelled = notes.withColumn("label", note_label(F.col("note"))).withColumn("_n", F.struct("_u", "_i", "note"))
    calls = placed.select(doc, "unit", "unit_end", "_at", F.explode(note_calls(F.col("fragment"))).alias("label"))
    met = labelled.join(calls, [doc, "label"]).where("_u between unit and unit_end").groupBy(doc, "_n").agg(F.min("_at").alias("_at"))
    own = met.groupBy(doc, "_at").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_n")), lambda n: n["note"]), "\n").alias("_notes"))
    with_own = placed.join(own, [doc, "_at"], "left").withColumn("fragment", F.concat_ws("\n\n", "fragment", "_notes")).drop("_notes")
    rest = labelled.join(met.select(doc, "_n"), [doc, "_n"], "left_anti").groupBy(doc, "_u").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_n")), lambda n: n["note"]), "\n").alias("fragment"))
    none = F.lit(0)
    orphans = rest.select(doc, none.alias("group"), none.alias("i"), F.col("_u").alias("unit"), none.alias("paragraph"), F.col("_u").alias("unit_end"), F.lit(None).cast("string").alias("section"), "fragment", F.struct(F.col("_u").alias("unit"), F.lit(1).alias("kind"), none.alias("group"), none.alias("i")).alias("_at"))
    return with_own.unionByName(orphans)


_NUMBER = r"(?i)^\s*(?:(?:chapter|cap[ií]tulo|part|parte|libro|book)\s+)?(?:[\divxlc]+[.)]?)+(?:\s*[.:—–-])?\s+"


def increasing(candidates: list[tuple[int, int, int, float]]) -> dict[int, tuple[int, int]]:
    """Of (entry, unit, paragraph, weight) the places of entries that ascend with them and weigh most together."""
    ranks = {p: i + 1 for i, p in enumerate(sorted({c[1:3] for c in candidates}))}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(ranks) + 1)  # best weight and its chain, by rank
    chain: list[tuple[tuple[int, int, int, float], int]] = []
    by: dict[int, list] = {}
    for c in sorted(candidates):
        by.setdefault(c[0], []).append(c)
    best = (0.0, -1)
    for own in by.values():
        made = []
        for c in own:
            i, top = ranks[c[1:3]] - 1, (0.0, -1)
            while i > 0:
                top = max(top, tree[i], key=lambda t: t[0])
                i -= i & -i
            chain.append((c, top[1]))
            made.append((ranks[c[1:3]], (top[0] + c[3], len(chain) - 1)))
        for i, now in made:
            best = max(best, now, key=lambda t: t[0])
            while i < len(tree):
                tree[i] = max(tree[i], now, key=lambda t: t[0])
                i += i & -i
    out, at = {}, best[1]
    while at >= 0:
        (entry, unit, paragraph, _), at = chain[at]
        out[entry] = (unit, paragraph)
    return out


def anchored_contents(entries: DataFrame, paras: DataFrame, doc: str, no: str, title: str, unit: str, alike: float = 0.6) -> DataFrame:
    """doc, no, unit, paragraph, found: where the entries of a table of contents begin, never going back.

    An entry (doc, no, title, unit: the page it names) may be a paragraph of its page or one of the first six of the next that is like
    its title, numbers aside, or begins with it.  Of all assignments in which places ascend the one with the greatest likeness is taken; an
    entry without a place begins with its page, or where the entry before it does.
    """
    bare = lambda x: F.when(F.trim(F.regexp_replace(x, _NUMBER, "")) != "", F.trim(F.regexp_replace(x, _NUMBER, ""))).otherwise(x)
    e = entries.select(doc, F.col(no).cast("int").alias("no"), T.key(bare(F.col(title))).alias("t"), F.col(unit).cast("int").alias("page"))
    head = F.nullif(F.regexp_extract("text", _HEADING, 1), F.lit(""))
    p = paras.select(doc, F.col(unit).cast("int").alias("u"), "paragraph", T.key(bare(F.coalesce(head, F.substring("text", 1, 300)))).alias("k"), (head.isNotNull() | (F.length("text") < 120)).alias("short"))
    near = e.withColumn("u", F.explode(F.array("page", F.col("page") + 1))).join(p, [doc, "u"]).where((F.col("u") == F.col("page")) | (F.col("paragraph") < 6))
    score = F.greatest(T.dice(F.col("k"), F.col("t")), T.dice(F.trim(F.substring("k", F.lit(1), F.length("t") + 2)), F.col("t")) - 0.05) + F.when(F.col("short"), 0.1).otherwise(0.0)
    found = near.select(doc, "no", "u", "paragraph", score.alias("s")).where(F.col("s") >= alike).groupBy(doc).agg(F.collect_list(F.struct("no", "u", "paragraph", "s")).alias("c"))
    all_entries = e.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("no", "page"))).alias("e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in structure.small(batches, 100):
            rows = []
            for k, own, cands in zip(pdf[doc], pdf["e"], pdf["c"]):
                at = increasing([(c["no"], c["u"], c["paragraph"], c["s"]) for c in cands]) if cands is not None else {}
                ahead, following = (1 << 31, 0), {}
                for x in reversed(list(own)):
                    following[x["no"]] = ahead
                    ahead = at.get(x["no"], ahead)
                before = (-1, 0)
                for x in own:
                    place = at.get(x["no"])
                    if place is None:
                        place = (x["page"], 0) if before < (x["page"], 0) < following[x["no"]] else before if before[0] >= 0 else min((x["page"], 0), following[x["no"]])
                    rows.append((k, x["no"], *place, x["no"] in at))
                    before = place
            if rows:
                yield pd.DataFrame(rows, columns=[doc, "no", "unit", "paragraph", "found"])

    both = all_entries.join(found, doc, "left").select(F.col(doc).cast("long").alias(doc), "e", "c")
    return both.mapInPandas(run, f"{doc} long, no int, unit int, paragraph int, found boolean")
