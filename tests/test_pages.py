"""Fragments across pages and anchored contents, on small documents and against plain Python."""

from __future__ import annotations

import random

from libralake.operators import pages, structure


def paragraph(n, first=0):
    return " ".join(f"This is sentence number {first + i} of a long scholarly paragraph about medieval cosmology and its models." for i in range(n))


def chunked(spark, texts, notes=None, cuts=None, sections=None, first=0):
    rows = [(1, first + i, t, (notes or {}).get(i, [])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc long, unit int, text string, notes array<string>")
    cut = spark.createDataFrame([(1, c) for c in cuts], "doc long, unit int") if cuts is not None else None
    return sorted(pages.chunk(df, "doc", "unit", "text", "notes", sections, cut).collect(), key=lambda r: r.place)


def test_sections_are_not_crossed(spark):
    got = chunked(spark, [f"# Chapter One\n\n{paragraph(12)}\n\n{paragraph(10, 100)}", f"{paragraph(9, 200)}\n\n# Chapter Two\n\n{paragraph(14, 300)}", paragraph(20, 400)])
    assert {r.section for r in got} == {"Chapter One", "Chapter Two"} and [r.place for r in got] == list(range(len(got)))
    assert not any("number 300 " in r.fragment for r in got if r.section == "Chapter One")
    assert all(r.n_tokens <= 520 for r in got) and sum(150 <= r.n_tokens <= 470 for r in got) / len(got) > 0.7
    assert got[0].fragment.startswith("## Chapter One") and (got[0].unit, got[0].paragraph) == (0, 1)


def test_paragraphs_go_on_over_pages(spark):
    got = chunked(spark, [f"{paragraph(3)} And this sentence continues on the", f"next page without any break. {paragraph(2, 50)}"])
    assert len(got) == 1 and "continues on the next page" in got[0].fragment and (got[0].unit, got[0].unit_end) == (0, 1)
    assert "cosmology goes" in chunked(spark, ["A word about cos-", "mology goes over."])[0].fragment
    assert len(chunked(spark, [None, "", " \n\n "])) == 0


def test_footnotes(spark):
    got = chunked(spark, [f"{paragraph(3)} As Ptolemy says.[^1] And so.²\n\n## Other\n\n{paragraph(2, 10)}"], {0: ["[^1]: Almagest, I.7.", "[^9]: An orphan note.", "2. Second."]})
    calls = next(r for r in got if "As Ptolemy says" in r.fragment)
    orphan = next(r for r in got if "orphan" in r.fragment)
    assert "[^1]: Almagest, I.7.\n2. Second." in calls.fragment and "Ptolemy says" not in orphan.fragment and orphan.place == len(got) - 1


def test_no_text_is_lost(spark):
    long = paragraph(80)
    got = chunked(spark, [long])
    assert len(got) > 3 and " ".join(r.fragment for r in got) == long
    verses = "\n".join(f"Verso número {i} del acto" for i in range(120))
    got = chunked(spark, [verses])
    assert len(got) > 1 and len(got[0].fragment.split("\n")) > 10


def test_batches_and_whole(spark):
    """Cut at the same units, batches alone give the fragments of the whole but for those at the seams."""
    texts = []
    for i in range(12):
        body = "\n\n".join(paragraph(4 + (i + k) % 5, i * 100 + k * 10) for k in range(3))
        texts.append(("continúa la frase de la página anterior hasta aquí. " if i % 3 == 1 else "") + body + (" and the sentence goes on to the" if i % 3 == 0 else ""))
    cuts = [0, 4, 8]
    whole = {r.fragment for r in chunked(spark, texts, cuts=cuts)}
    parts = {r.fragment for c in cuts for r in chunked(spark, texts[c : c + 4], cuts=[c], first=c)}
    assert len(whole & parts) >= len(whole) - 4 and len(whole) > 12


def test_anchored_contents(spark):
    units = [(1, 0, f"Preface text here. {paragraph(2)}"), (1, 1, f"Some leftover text.\n\nThe Medieval Situation\n\n{paragraph(4)}"), (1, 2, "## Optimizer\n\nWe used it.\n\nAppendix")]
    paras = pages.paragraphs(spark.createDataFrame(units, "doc long, unit int, text string"), "doc", "unit", "text")
    entries = spark.createDataFrame([(1, 1, "Preface", 0), (1, 2, "I. The Medieval Situation", 1), (1, 3, "5.3 Optimizer", 1), (1, 4, "Nowhere", 2), (1, 5, "Appendix", 2), (2, 1, "Lost", 3)], "doc long, no int, title string, unit int")
    got = {(r.doc, r.no): (r.unit, r.paragraph, r.found) for r in pages.anchored_contents(entries, paras, "doc", "no", "title", "unit").collect()}
    assert got == {(1, 1): (0, 0, False), (1, 2): (1, 1, True), (1, 3): (2, 0, True), (1, 4): (2, 0, False), (1, 5): (2, 2, True), (2, 1): (3, 0, False)} or got[1, 1] == (0, 0, True)
    sections = spark.createDataFrame([(1, u, p, t) for u, p, t in [(0, 0, "Preface"), (1, 1, "Situation")]], "doc long, unit int, paragraph int, title string")
    fr = chunked(spark, [t for _, _, t in units], sections=sections)
    assert next(r for r in fr if "leftover" in r.fragment).section == "Preface"


def test_increasing_against_all_choices():
    rng = random.Random(4)
    for _ in range(60):
        cands = [(e, rng.randint(0, 3), rng.randint(0, 2), rng.randint(1, 9) / 10) for e in range(5) for _ in range(rng.randint(0, 3))]

        def most(entry, last):
            if entry == 5:
                return 0.0
            return max([most(entry + 1, last), *[w + most(entry + 1, (u, p)) for e, u, p, w in cands if e == entry and (u, p) > last]])

        got = pages.increasing(cands)
        places = [got[e] for e in sorted(got)]
        assert places == sorted(set(places))
        weight = sum(max(w for e, u, p, w in cands if e == k and (u, p) == v) for k, v in got.items())
        assert abs(weight - most(0, (-1, -1))) < 1e-9


def test_groups_against_plain_rules(spark):
    rng = random.Random(9)
    rows = [(d, u, "\n\n".join(rng.choice(["# Head", "lower start of text", "Upper start.", "Not ended here", "verse\nlines"]) for _ in range(rng.randint(0, 3)))) for d in range(6) for u in range(8)]
    got = {(r.doc, r.group): [(p.unit, p.paragraph, p.goes_on) for p in r.parts] for r in pages.groups(pages.paragraphs(spark.createDataFrame(rows, "doc int, unit int, text string"), "doc", "unit", "text"), "doc", "unit").collect()}
    want = {}
    for d in range(6):
        group, before = 0, None
        for _, u, t in [r for r in rows if r[0] == d]:
            for i, p in enumerate([p for p in t.split("\n\n") if p]):
                group += p == "# Head"
                on = i == 0 and p == "lower start of text" and before is not None and before[1] in ("lower start of text", "Not ended here")
                want.setdefault((d, group), []).append((u, i, on))
                before = (u, p)
    assert got == want
    assert structure.estimate("") == 0
