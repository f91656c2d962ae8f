"""The library's front, passages, media and library files on small cases."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from libralake.functions.register import register
from libralake.library import Library
from libralake.operators import graph, ingest, media, passages
from libralake.sources import sqlite


@pytest.fixture(scope="module")
def library(spark):
    texts = {
        1: "In a village of La Mancha there lived a gentleman with a lance.\n\nHis niece feared his books of chivalry.",
        2: "Natural selection preserves favourable variations and rejects injurious ones.",
        3: "Natural selection preserves favourable variations and rejects injurious ones.",
        4: "Philosophy is the consolation of the prisoner. Fortune turns her wheel.",
    }
    docs = spark.createDataFrame([(k, t, "en", 1600 + k) for k, t in texts.items()], "doc_id long, text string, lang string, year int")
    return Library.of_documents(docs)


def test_search(library):
    hits = library.search("favourable variations of selection", 5).collect()
    assert hits[0].doc == 2 and sum(h.doc in (2, 3) for h in hits) == 1 and "<mark>selection</mark>" in hits[0].marked.lower()
    assert {h.doc for h in library.search("selection", 5, years=(1604, 1604)).collect()} == {4}
    assert library.search('"her wheel"', 3).first().doc == 4
    assert library.search("selection", 5, ids=[]).count() == 0
    assert library.cite("Natural selection preserves favourable variations").first().decision == "accept"
    assert library.more_like("2:0", 2).first().doc == 3
    cards = library.fragments.where("doc = 4").select(F.lit("c1").alias("key"), "text")
    assert {r.layer for r in library.layered("fortune and philosophy", cards).collect()} == {"text", "card"}


def test_old_spelling(spark, tmp_path):
    """Modern words and quotations find old prints, and modern texts as before."""
    texts = [
        (1, "prenden a los que hallan en palacio, y no pudiendo prenderlos, puedē matarlos, ſi con rieſgo de muerte ſe les defienden", "es", None),
        (2, "el qual apedimiento del reyno eſtablecio ley del numero dellos que dize aſsi.", "es", None),
        (3, "Don Sancho Fernandez, hijo del famoſo Conde Fernan Gonçalez, y de la Condeſſa Doña Sancha ſu muger, la qual deſſeando caſar con vn Rey Moro", "es", None),
        (4, "La libertad, Sancho, es uno de los más preciosos dones que a los hombres dieron los cielos; por la libertad se puede y debe aventurar la vida", "es", 1605),
        (5, "This preservation of favourable variations and the rejection of injurious variations, I call Natural Selection.", "en", 1859),
        (6, "Gallia est omnis divisa in partes tres", "la", None),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, year int")
    shelf = Library.of_documents(docs, lang="lang", year="year").indexed(str(tmp_path / "lists"))
    shelf = __import__("dataclasses").replace(shelf, vectors=None)
    for query, doc in {"riesgo de muerte": 1, "mujer": 3, "famoso conde": 3, "estableció ley": 2, "aventurar la vida": 4, "natural selection": 5, "«Doña Sancha»": 3, "«riesgo de muerte»": 1, "partem galliae": 6}.items():
        assert shelf.search(query, 5).first().doc == doc, query
    assert shelf.search("mujer", 5, ids=[1, 2]).count() == 0 and shelf.search("zzz", 5).count() == 0
    plain = Library.of_documents(docs).indexed(str(tmp_path / "plain"))
    assert [r.doc for r in plain.search("natural selection", 1).collect()] == [5]


def test_passages(spark):
    assert passages.claims("Short. This is a claim that is long enough (Mill, 1859). Here stands another long claim.")[0][2] is True
    assert passages.paragraphs("# Head\n\nBody one.\n\nBody two.") == [(0, 6), (8, 28)]
    assert passages.best_window("x " * 300 + "wheel of fortune", {"wheel", "fortune"})[1] == 616
    assert passages.across_pages("end of page. Start of", ["at the end of page.", "Start of next"]) == [(0, 7, 18), (1, 0, 8)]
    assert passages.narrow("Nothing here. The wheel of fortune turns. " * 12, {"wheel", "fortune"}) is not None
    df = spark.createDataFrame([("He left.[1] She stayed (p. 12) at 1:05.",)], "x string")
    r = df.select(passages.marks_before_stop(F.col("x")).alias("a"), passages.without_locators(F.col("x")).alias("b"), passages.anchors_in_prose(F.col("x")).alias("c"), passages.insertion_point(F.col("x"), False).alias("d")).first()
    assert r.a.startswith("He left[1].") and "(p. 12)" not in r.b and [(x["kind"], x["from"], x["to"]) for x in r.c] == [("page", 12.0, 12.0), ("time", 65.0, 85.0)] and r.d == 38


def test_media(spark):
    speech = spark.createDataFrame([("k", 0.0, 60.0)], "k string, t0 double, t1 double")
    words = spark.createDataFrame([("k", 1.0, 20.0), ("k", 30.0, 59.0)], "k string, t0 double, t1 double")
    assert [(round(r.t0, 1), round(r.t1, 1)) for r in media.uncovered(speech, words, "k", "t0", "t1").collect()] == [(21.2, 28.8)]
    region = "page int, id string, box struct<x:double,y:double,w:double,h:double>, cap string"
    a = spark.createDataFrame([(1, "a1", (0.0, 0.0, 0.5, 0.5), "x"), (1, "a2", (0.5, 0.5, 0.2, 0.2), "y"), (1, "a3", (0.9, 0.9, 0.1, 0.1), None)], region)
    b = spark.createDataFrame([(1, "b1", (0.0, 0.0, 0.4, 0.5), None), (1, "b2", (0.0, 0.9, 0.1, 0.1), "y"), (1, "b3", (0.3, 0.6, 0.1, 0.1), "z")], region)
    assert sorted((r.a, r.b, r.rule) for r in media.match_regions(a, b, "page", "box", "id", "cap").collect()) == [("a1", "b1", "area"), ("a2", "b2", "caption"), ("a3", "b3", "alone")]
    side = lambda n: spark.createDataFrame([("p", i) for i in range(n)], "pair string, place int")
    assert sorted((r.a, r.b) for r in media.proportional(side(4), side(2), "pair", "place").collect()) == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_names_and_pages(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    L = F.lit
    assert one(ingest.title_match(L("Origin of Species: a study"), L("Origin of Species"))) is True
    assert one(ingest.title_match(L("On Liberty"), L("on liberty."))) is True and one(ingest.title_match(L(""), L("x"))) is False
    assert one(ingest.authors_match(F.array(L("mill")), F.array().cast("array<string>"))) is None
    assert one(ingest.author_key(L("de la Cruz, Juana Inés"))) == "cruz j" and one(ingest.author_key(L("Charles Darwin"))) == "darwin c"
    assert one(ingest.page_accepted(L("la la " * 40), L(0.9), L(0))) is False and one(ingest.page_accepted(L("A plain page of text."), L(0.9), L(0))) is True
    assert one(ingest.people_in_title(L("Ana Lopez y Juan Perez, hoy"))) == ["Ana Lopez", "Juan Perez"]
    assert ingest.inflections("casa", "es")[:2] == ["casa", "casas"]


def test_graph_views(spark):
    e = spark.createDataFrame([(1, 2, 2.0), (1, 3, 1.0), (2, 3, 0.9), (3, 2, 0.9), (2, 4, 5.0)], "node int, other int, weight double")
    assert sorted((r.node, r.other) for r in graph.neighbourhood(e, 1).collect()) == [(1, 2), (1, 3), (2, 3)]
    ent = spark.createDataFrame([(1, "The Thames", ["River Thames"], 3), (2, "Thames Street", [], 9)], "k int, name string, aliases array<string>, w int")
    assert [r.k for r in graph.search_entities(ent, "the thames", "k", "name", "aliases", "w").collect()] == [2, 1]


def test_library_files(spark, tmp_path):
    tables = {"docs": pd.DataFrame({"id": ["a", "b"], "v": [b"\x00\x00\x80?", None]})}
    data = sqlite.write(tables)
    assert data == sqlite.write(tables)
    (tmp_path / "x.lib").write_bytes(data)
    got = sqlite.read_table(spark, str(tmp_path / "x.lib"), "docs", ["id", "v"]).select("id", sqlite.floats(F.col("v")).alias("v")).orderBy("id").collect()
    assert [(r.id, r.v) for r in got] == [("a", [1.0]), ("b", None)]


def test_registered(spark):
    register(spark)
    assert spark.sql("SELECT spelling_key('muger', 'es') = spelling_key('mujer', 'es') AS same").first().same
    assert spark.sql("SELECT count(*) AS n FROM fragments('One sentence. Two.')").first().n == 1


def test_marks_far_into_a_fragment(spark):
    frags = spark.createDataFrame([("a", 1, 0, "Plain words go on. " * 40 + "Here turns the wheel of fortune at last."), ("b", 2, 0, "Nothing of it.")], "key string, doc int, place int, text string")
    hit = Library(frags).search("wheel fortune", 2).first()
    assert hit.key == "a" and "<mark>wheel</mark>" in hit.marked and "<mark>fortune</mark>" in hit.marked
