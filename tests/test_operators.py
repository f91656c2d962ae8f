"""Operators without SQL, on small cases worked out by hand or against plain Python."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from libralake.functions import text as T
from libralake.operators import align, bibliography, citations, filters, folios, fusion, graph, intervals, normalizer, structure, tables, transcripts
from libralake.sources import documents, exports


def one(spark, column, **values):
    from pyspark.sql import functions as F

    rows = [tuple(values.values())]
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame(rows, schema).select(column(*[F.col(k) for k in values]).alias("v")).first().v


def test_text_functions(spark):
    assert one(spark, T.fold, x="ÁRBOL Ñandú çà") == "arbol nandu ca"
    assert one(spark, T.key_keeping_ene, x="El Niño, ¡oh!") == "el niño oh"
    assert one(spark, T.quoted, x='a «uno dos» b "tres"') == ["uno dos", "tres"]
    assert [one(spark, T.clock_seconds, x=x) for x in ("1:02:03", "2:05,5", "77", "x")] == [3723.0, 125.5, 77.0, None]
    assert [one(spark, T.clock, x=x) for x in (3723.0, 65.9)] == ["1:02:03", "1:05"]
    assert [one(spark, T.roman, x=x) for x in ("xiv", "MCMXC", "iiii", "")] == [14, 1990, None, None]
    assert one(spark, lambda x: T.truncate_words(x, 10), x="uno dos tres cuatro") == "uno dos…"
    assert [one(spark, T.isbn_valid, x=x) for x in ("0-306-40615-2", "978-0-306-40615-7", "9780306406158", "12")] == [True, True, False, False]
    assert one(spark, T.to_isbn13, x="0306406152") == "9780306406157"
    assert one(spark, T.dice, a="night", b="nacht") == pytest.approx(0.25)
    assert one(spark, T.intent, x="¿cuando fue la batalla?") == "temporal"
    assert one(spark, T.language, x="the cat and the dog") == "en"


def test_said_filters(spark):
    low, high = filters.said_years(__import__("pyspark.sql.functions", fromlist=["col"]).col("q"))
    df = spark.createDataFrame([("letters between 1600 and 1650",), ("cartas antes de 1700",), ("since 1900",), ("none",)], "q string").select(low.alias("a"), high.alias("b"))
    assert [tuple(r) for r in df.collect()] == [(1600, 1650), (None, 1699), (1900, None), (None, None)]
    folio = lambda q: one(spark, lambda x: F.struct(*filters.said_folio(x)), q=q)
    assert tuple(folio("página 199 de Don Quijote")) == ("199", "Don Quijote") and tuple(folio("ir a la p. xiv")) == ("xiv", None) and tuple(folio("go to page 12")) == ("12", None)
    assert tuple(folio("the page 12 of it")) == (None, None) and tuple(folio("pages of 12")) == (None, None) and tuple(folio("12")) == (None, None)
    assert one(spark, filters.said_page, q="go to page 12") == 12 and one(spark, filters.said_page, q="p. xiv") is None
    assert one(spark, lambda q, a: filters.said_authors(q, F.split(a, ",")), q="la libertad en Cervantes antes de 1900", a="Cervantes,Darwin,en") == ["Cervantes"]
    assert filters.merge_years((1600, None), (1500, 1700)) == (1600, 1700)
    docs = spark.createDataFrame([(1, "es", 1999, 1605, "Cervantes"), (2, "en", None, None, "Mill")], "doc_id int, lang string, year int, original_year int, authors string")
    assert [r.doc_id for r in filters.allowed(docs, years=(1600, 1700)).collect()] == [1]
    assert filters.allowed(docs, ids=[]).count() == 0 and filters.allowed(docs).count() == 2
    assert filters.allowed(docs, authors=["cervántes"]).count() == 1
    assert docs.where(filters.compile_filter({"year": {"$near": 3}})).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int").selectExpr("'a' route", "id", "rank")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int").selectExpr("'b' route", "id", "rank")
    got = {r.id: (round(r.score, 6), r.routes) for r in fusion.rrf([a, b], "id").collect()}
    assert got == {1: (round(1 / 11, 6), "a"), 2: (round(1 / 12 + 1 / 11, 6), "a+b"), 3: (round(1 / 12, 6), "b")}
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, s double")
    assert [r.scaled for r in fusion.min_max(flat, "s").collect()] == [1.0, 1.0]
    frag = spark.createDataFrame([("d", 1, 0.9), ("d", 2, 0.8), ("d", 4, 0.7), ("e", 2, 0.1)], "doc string, ord int, s double")
    assert sorted((r.doc, r.ord) for r in fusion.adjacent_merge(frag, "doc", "ord", "s").collect()) == [("d", 1), ("d", 4), ("e", 2)]


def test_interval_difference(spark):
    rng = random.Random(1)
    spans = lambda: [("k", float(a), float(a + rng.randint(1, 9))) for a in (rng.randint(0, 60) for _ in range(12))]
    a, b = spans(), spans()
    frame = lambda x: spark.createDataFrame(x, "k string, t0 double, t1 double")
    got = intervals.difference(frame(a), frame(b), ["k"], "t0", "t1").collect()
    inside = lambda x, s: any(p <= x < q for _, p, q in s)
    for i in range(0, 80):
        x = i + 0.5
        assert inside(x, [tuple(r) for r in got]) == (inside(x, a) and not inside(x, b))


def synthetic_book(seed):
    """Pages with their true numbers: roman front matter, arabic body, a plate, some numbers unread or misread."""
    rng = random.Random(seed)
    rows, truth = [], []
    roman = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii"]
    n = 0
    for page in range(1, 70):
        if page <= 8:
            label, value = roman[page - 1], (page, True)
        elif page == 40:
            label, value = None, None
        else:
            n += 1
            label, value = str(n), (n, False)
        if label and rng.random() < 0.25:
            label = None
        elif label and rng.random() < 0.08:
            label = str(rng.randint(200, 900))
        rows.append(("book", page, None, label, "line one\nline two"))
        truth.append(value)
    return rows, truth


@pytest.mark.parametrize("seed", range(4))
def test_folios(spark, seed):
    rows, truth = synthetic_book(seed)
    df = spark.createDataFrame(rows, "doc string, page int, h string, f string, b string")
    got = {r.page: r for r in folios.deduce(df, "doc", "page", "h", "f", "b").collect()}
    right = sum(got[i + 1].printed == v[0] and got[i + 1].roman == v[1] for i, v in enumerate(truth) if v and got[i + 1].printed is not None)
    numbered = sum(got[i + 1].printed is not None for i, v in enumerate(truth) if v)
    assert numbered >= 60 and right >= numbered - 1
    blank = spark.createDataFrame([("x", i, None, None, "text only\nmore") for i in range(1, 5)], "doc string, page int, h string, f string, b string")
    assert all(r.printed is None for r in folios.deduce(blank, "doc", "page", "h", "f", "b").collect())
    assert folios.from_roman("xiv") == 14 and folios.from_roman("iiii") is None


def test_alignment():
    a = [100, 200, 50, 300, 120]
    assert align.by_length(a, a) == [([i], [i]) for i in range(5)]
    assert ([1, 2], [1]) in align.by_length(a, [100, 250, 300, 120])
    beads = align.by_length([50], [40] * 600)
    assert sorted(j for _, js in beads for j in js) == list(range(600)) and beads[0][1]
    assert align.by_length([], []) == [] and align.by_length([10], []) == [([0], [])]
    assert align.words("the cat sat".split(), "the dog sat down".split()) == [(0, 0), (1, 1), (2, 2), (None, 3)]
    old = [("the", 0.0, 1.0), ("cat", 1.0, 2.0), ("sat", 2.0, 3.0)]
    assert align.inherit_times(old, ["the", "Cat", "sat"]) == [("the", 0.0, 1.0), ("Cat", 1.0, 2.0), ("sat", 2.0, 3.0)]
    assert align.inherit_times(old, ["quite", "other", "words", "here", "now"]) is None


def test_structure():
    text = "Dr. Smith came. He left!\n\n" + " ".join(f"Sentence number {i} has some words in it." for i in range(120)) + "\n\nEnd."
    spans = structure.sentences(text)
    assert text[slice(*spans[0])] == "Dr. Smith came." and text[slice(*spans[1])] == "He left!"
    parts = structure.fragments(text)
    assert all(a < b for a, b in parts) and all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))
    assert "".join("".join(text[a:b].split()) for a, b in parts) == "".join(text.split())
    assert all(structure.estimate(text[a:b]) <= 500 for a, b in parts) and structure.fragments("") == []
    assert structure.locate("some words", "Here are some words.") == (9, 19, 1.0)
    assert structure.locate("some  WORDS", "Here are sóme, words.") == (9, 20, 0.95)
    assert structure.locate("absent", "Here") is None and structure.locate("", "x") is None
    assert text[slice(*structure.passage(text, {"smith", "left"})[:2])] == "Dr. Smith came. He left!"


def test_pack_and_units(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([5, 5, 5, 12, 1])], "doc string, i int, n int")
    assert [r.batch for r in structure.pack(df, "doc", "i", "n", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    words = [("k", float(i), i + 0.5, w, "a" if i < 6 else "b") for i, w in enumerate("one two. three four. five six seven eight".split())]
    s = transcripts.sentence_numbers(spark.createDataFrame(words, "k string, t0 double, t1 double, w string, who string"), "k", "t0", "t1", "w", "who")
    assert [r.sentence for r in s.orderBy("t0").collect()] == [1, 1, 2, 2, 3, 3, 4, 4]
    sents = spark.createDataFrame([("k", 10.0 * i, 10.0 * i + 9, "a" if i < 4 else "b") for i in range(9)], "k string, t0 double, t1 double, who string")
    assert [r.unit for r in transcripts.time_units(sents, "k", "t0", "t1", "who").orderBy("t0").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 1]


def test_normalizer(spark):
    same = [("es", "muger", "mujer"), ("es", "dixo", "dijo"), ("es", "honrra", "honra"), ("es", "quando", "cuando"), ("es", "agora", "ahora"), ("la", "causae", "cause"), ("la", "iuuenis", "juvenis"), ("fr", "estoit", "etait"), ("it", "huomo", "uomo")]
    for lang, old, new in same:
        assert normalizer.key_of(old, lang) == normalizer.key_of(new, lang), (lang, old, new)
    es = lambda t: " ".join(normalizer.key_of(w, "es") for w in t.split())
    for old, new in {
        "aſsi": "así", "q̃": "que", "viẽto": "viento", "cõpañia": "compañía", "tãbien": "también", "vengarfe": "vengarse", "fiempre": "siempre", "hiço": "hizo", "çiudad": "ciudad", "vn": "un", "cauallo": "caballo", "iuez": "juez",
        "traygo": "traigo", "aora": "ahora", "havemos": "habemos", "Quantos": "cuántos", "frequente": "frecuente", "Enrrique": "Enrique", "prission": "prisión", "Exercito": "ejército", "Ximena": "Jimena", "philosophia": "filosofía",
        "monarcha": "monarca", "sancto": "santo", "sciencia": "ciencia", "spiritu": "espíritu", "conoscer": "conocer", "fermosa": "hermosa", "escrevir": "escribir", "vuessa merced": "vuestra merced", "desta": "de esta", "dellos": "de ellos",
    }.items():
        assert es(old) == es(new), (old, es(old), es(new))
    assert es("examen éxito texto acción calle perro mayor") == "examen exito texto aczion calle perro mayor"
    assert [normalizer.long_s(w) for w in ("efte", "mifmo", "afsi", "nafta", "oftalmologia", "fiesta")] == ["este", "mismo", "assi", "nafta", "oftalmologia", "fiesta"]
    assert [normalizer.enclitic(w) for w in ("uirumque", "atque", "estne", "nonne", "bene", "plusue")] == [("uirum", "que"), ("atque", ""), ("est", "ne"), ("non", "ne"), ("bene", ""), ("plus", "ue")]
    assert [normalizer.verb_stem(w) for w in ("amabant", "amauerunt", "legebatur", "amabo")] == ["amaba", "amaui", "legeba", "amabi"]
    assert normalizer.variants("honra") == ["onra", "honr"] and normalizer.variants("así es la vida") == ["asi es la bida", "asi es la uida"] and "que" not in normalizer.variants("virumque")
    assert normalizer.key_of("il", "fr") == "il" and [normalizer.key_of(w, "it") for w in ("ho", "et", "operatione")] == ["ho", "e", "operazione"]
    assert normalizer.prepare("ſeñor Æneas".split()[0]) == "señor" and normalizer.stem("rosarum") == "rosar"
    assert one(spark, lambda x: normalizer.is_old(x, __import__("pyspark.sql.functions", fromlist=["lit"]).lit("es"), __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("int")), x="assi dixo la muger quando vino") is True


def test_graphs(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}
    m = spark.createDataFrame([("d", 1, "x", 0), ("d", 1, "y", 400), ("d", 2, "z", 0)], "doc string, part int, e string, at int")
    w = {(r.a, r.b): r.weight for r in graph.cooccurrence(m, "doc", "part", "e", "at").collect()}
    assert w == {("x", "y"): round(0.4 + 0.6 * 2.718281828459045**-1, 3), ("x", "z"): 0.15, ("y", "z"): 0.15}
    docs = spark.createDataFrame([(1, "New York City is not York")], "doc_id int, text string")
    forms = spark.createDataFrame([("a", "New York City"), ("b", "York"), ("c", "city")], "owner string, form string")
    assert sorted((r.owner, r.start) for r in graph.mentions(docs, forms, "doc_id", "text", "owner", "form").collect()) == [("a", 1), ("b", 6)]


def test_references(spark):
    refs = spark.createDataFrame([(1, "Mill, J. S. (1859). On liberty and other essays. London."), (2, "Smith, A. 1776. x doi:10.1000/ABC."), (3, "Unknown 1999"), (4, "Mill, J. 1859")], "ref_id int, entry string")
    shelf = spark.createDataFrame([(10, "On liberty and other essays", 1859, "mill", None), (11, "Wealth", 1776, "smith", "10.1000/abc")], "doc_id int, title string, year int, surname string, doi string")
    got = {r.ref_id: (r.doc_id, r.rule) for r in bibliography.resolve(bibliography.parse(refs, "entry"), shelf).collect()}
    assert got == {1: (10, "title"), 2: (11, "doi"), 4: (10, "name")}
    assert "author = {A B}" in one(spark, bibliography.bibtex, k="k1", a="A B", t="T{x}", y="1999")
    assert exports.parse_bibtex('@book{k1, title = {A {B} c}, author = "Garc\\\'ia, Ana and Luis de la Cruz", year = 1999}')[0] == {"type": "book", "key": "k1", "title": "A B c", "author": "García, Ana and Luis de la Cruz", "year": "1999"}
    assert exports.authors("García, Ana and Luis de la Cruz") == [("García", "Ana"), ("de la Cruz", "Luis")]


def test_citations(spark):
    said = {
        "Cervantes no menciona la imprenta de Gutenberg.": "la imprenta de Gutenberg", "Darwin does not discuss the printing press.": "the printing press", "El panóptico es una torre.": None,
        "The novel is not only a satire.": None, "There is no doubt that Darwin wrote it.": None, "He never came": None, "Il n'aborde jamais la guerre": "la guerre", "Non menziona Dante": "Dante",
    }
    for claim, subject in said.items():
        assert one(spark, citations.absent_subject, x=claim) == subject and one(spark, citations.is_negative, x=claim) == (subject is not None)
    missing = lambda a, b: one(spark, lambda x, y: citations.missing_terms(x, y), a=a, b=b)
    assert missing("El modelo de Bentham llegó al 40 % de las cárceles.", "El Panóptico de Bentham es la figura") == ["40 %"]
    assert missing("Then Darwin met Huxley in 1860. And so did Ácana of the BBC.", "darwin alone") == ["Huxley", "Ácana"]
    rows = spark.createDataFrame([(0.9, "context", False, "plausible", False), (0.9, "direct", False, "plausible", False), (0.9, "direct", True, "plausible", False), (0.9, "direct", False, "impossible", False), (0.9, "direct", False, "plausible", True)], "s double, k string, c boolean, p string, n boolean")
    assert [r.decision for r in citations.decide(rows, "s", "k", "c", "p", "n").collect()] == ["review", "accept", "review", "discard", "review"]


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


def test_sources(spark, tmp_path):
    assert documents.blocks(b"<html><body><h1>T</h1><p>a <b>b</b></p><script>x</script></body></html>") == [("heading", 1, "T"), ("paragraph", 0, "a b")]
    assert documents.blocks(b"# T\n\nSome *text* [link](u)\n\n[^1]: note", "x.md") == [("heading", 1, "T"), ("paragraph", 0, "Some text link"), ("note", 0, "note")]
    assert documents.blocks(b"{\\rtf1\\ansi caf\\'e9\\par next}") == [("paragraph", 0, "café"), ("paragraph", 0, "next")]
    assert documents.blocks(b"a;b;\n1;2;\n;;\n", "t.csv") == [("row", 0, "a: 1; b: 2")]
    docx = zipped({"word/document.xml": '<w:document xmlns:w="w"><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t></w:r></w:p></w:document>'})
    assert documents.blocks(docx) == [("heading", 2, "T"), ("paragraph", 0, "x")]
    epub = zipped({"META-INF/container.xml": '<c xmlns="c"><rootfile full-path="o/b.opf"/></c>', "o/b.opf": '<p xmlns="o"><item id="a" href="a.html"/><itemref idref="a"/></p>', "o/a.html": "<h2>C</h2><p>t</p>"})
    assert documents.blocks(epub) == [("heading", 2, "C"), ("paragraph", 0, "t")]
    assert documents.kind_of(b"%PDF-1.7") == "pdf" and documents.decode("é".encode("latin-1")) == "é"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\n## U\n\ntext")
    got = documents.read(spark, str(tmp_path / "in")).orderBy("place").collect()
    assert [(r.kind, r.section) for r in got] == [("heading", "T"), ("heading", "T > U"), ("paragraph", "T > U")]
    m = exports.ndjson({"t": spark.range(3)}, str(tmp_path / "out"))
    assert [tuple(r) for r in m.collect()] == [("t", 3)] and spark.read.json(str(tmp_path / "out" / "t")).count() == 3


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(tables.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(tables.insert_missing(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(tables.cascade_delete({"t": old}, new, "k")["t"]) == [(1, "a")]


def test_stream_alerts(spark, tmp_path):
    from libralake.streaming import watchers, windows

    src = tmp_path / "docs"
    src.mkdir()
    schema = "doc_id long, text string"
    batches = [[(1, "alpha beta"), (2, "gamma")], [(3, "beta alpha"), (1, "alpha beta")], [(4, "none")], [(5, "alpha and beta")]]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").json(str(src))
        found = watchers.matches(stream, {"w": ["alpha", "beta"]})
        q = watchers.alerts(found).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.schema("watch string, n_new long, total long").json(str(tmp_path / "out")).collect())
    assert got == [("w", 1, 2), ("w", 1, 3)]
    ev = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 00:50:00", 2.0), (2, "2024-01-01 01:10:00", 3.0)], "user_id int, ts string, value double").selectExpr("user_id", "cast(ts as timestamp_ntz) ts", "value")
    ev.write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = windows.counts(live, "1 hour", None, ["user_id"], late="10 minutes").writeStream.format("memory").queryName("w1").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("w1").collect())) == sorted(map(str, windows.counts(ev, "1 hour", None, ["user_id"]).collect()))
