"""Registered queries do the whole job of their operators, on small tables against brute force."""

from __future__ import annotations

import random
import re

import duckdb
from pyspark.sql import functions as F

from libralake.operators import bibliography, ingest, structure, works
from libralake.plans.catalogue import ORACLE_SQL, QUERIES


def looped(text):
    lines = [x.strip(" ") for x in (text or "").split("\n") if len(x.strip(" ")) > 3]
    top = max(map(lines.count, lines), default=0)
    if len(lines) >= 8 and top >= 6 and top > 0.4 * len(lines):
        return True
    t = text or ""
    return any(t[i : i + n] * 13 == t[i : i + 13 * n] for n in range(4, 41) for i in range(len(t) - 13 * n + 1))


def test_loops(spark, tmp_path):
    texts = ["the end " * 13, "the end " * 12, "x " * 30, "x" * 52, "x" * 51, "before " + "0123456789abcdefghijklmnopqrstuvwxyz0123" * 13 + " after", "a line\n" * 8, "a\nb\nc", "", None, "one\ntwo\n" * 13]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.stuck for r in QUERIES["repetition_loops_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: looped(t) for i, t in enumerate(texts)} and sum(got.values()) >= 5


def test_quotes(spark, tmp_path, monkeypatch):
    long = "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness"
    quotes = [long, "Two words", "é", "—", "", None, "ΑΣ", "To be or not to be that is the question of this whole long evening here"]
    texts = [
        "He said: " + long, long.replace("worst", "wor-\nst").replace("best", "be-\nst"), long.replace("the age of wisdom", "another one"), long.upper(),
        "Here are two, WORDS", "İ é — x", "a — b", "ΑΣ ΣΑΣΑ", "to BE or not TO be, that is the quest; of this whole long evening here", "", None, "nothing of it",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in QUERIES["quote_locate"](spark, str(tmp_path)).collect())
    monkeypatch.setattr(structure, "QUOTE_CHARS", 60)
    parted = sorted(tuple(r) for r in QUERIES["quote_locate"](spark, str(tmp_path)).collect())
    assert parted == got
    want = sorted((k, i, *hit) for k, t in enumerate(texts) for i, q in enumerate(quotes) if (hit := structure.locate(q or "", t or "")))
    assert got == want and {(1, 0), (2, 0), (4, 1), (5, 2), (5, 3), (8, 7)} <= {x[:2] for x in got}


def test_titles(spark):
    rng = random.Random(4)
    pool = ["the", "art", "war", "of", "history", "nature", "law", "on", "peace", "music", "and", "letters"] + [f"rare{i}" for i in range(30)]
    titles = ["The Art of War", "Thermodynamics", "Wars of Roses", "On Liberty and Peace"] + [" ".join(rng.sample(pool, rng.randint(1, 12))) for _ in range(120)]
    shelf = [(i, t, 1900 + i % 7 if i % 5 else None, None, None) for i, t in enumerate(titles)]
    refs = [(0, "The Art of War", 1900, "x"), (1, "zThermodynamics", None, "Smith. Thermodynamics zThermodynamics"), (2, "On Liberty and Peace: a new study", 1903, "Mill. On Liberty and Peace: a new study. London")]
    for i in range(150):
        own = rng.choice(titles).split()
        if i % 3:
            own[rng.randrange(len(own))] = "mispelt"
        refs.append((10 + i, " ".join(own), rng.choice([None, 1900, 1903]), "Name, N. " + " ".join(own) + (" with a longer tail of words" if i % 2 else "")))
    words = lambda t: {w for w in re.findall(r"\w+", t.lower()) if len(w) > 2}
    key = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {}
    for k, title, year, entry in refs:
        found = []
        for i, t, y, *_ in shelf:
            a, b = words(title), words(t)
            alike = max(len(a & b) / max(len(a), len(b), 1), 0.9 if key(t) in key(entry) and len(t) > 12 else 0)
            if a & b and alike >= 0.85 and (year is None or y is None or abs(year - y) <= 1):
                found.append((-alike, i))
        if found:
            want[k] = min(found)[1]
    rows = spark.createDataFrame([(k, t, y, e, None, None) for k, t, y, e in refs], "ref_id int, title string, year int, entry string, doi string, surname string")
    got = {r.ref_id: r.doc_id for r in bibliography.resolve(rows, spark.createDataFrame(shelf, "doc_id int, title string, year int, surname string, doi string")).collect()}
    assert got == want and got[0] == 0 and got[2] == 3


def test_missing_terms_query(spark, tmp_path):
    """Numbers at any place keep their digits; a capital of two letters is none; a text that is away lacks all."""
    texts = ["56 lines", "ßheit of 99 %", "17 and 12 %", None, "Ärzte 14 %", "0 and 1"]
    spark.createDataFrame([(7 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.missing for r in QUERIES["missing_terms"](spark, str(tmp_path)).collect()}
    assert got == {7 + i: ["Zyxwvut", f"{17 + i} %"] for i in range(6)}


def test_people_query(spark, tmp_path):
    """Parts keep digits that equal their place, and lose spaces of any kind at their ends."""
    texts = ["010 Ann Lee, 11 Bob Ray and 2 Cy Doe 2", "\u00a0Ann Lee\u00a0, Bob\u3000Ray\u2003", "Ann Lee\x0band\x0bBob Ray", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.people for r in QUERIES["people_in_titles"](spark, str(tmp_path)).collect()}
    assert got == {0: "010 Ann Lee|11 Bob Ray|2 Cy Doe 2", 1: "Ann Lee", 2: "Ann Lee\x0band\x0bBob Ray", 3: "", 4: None}


def test_lens_query(spark, tmp_path):
    """Case, word edges and lines as SQL's patterns have them."""
    texts = {"ARTÍCULO 1 artículo 2 ARTICLE 3 Ley 4 ſection 5 aſection 6": "law", "éley 1 " * 5: "law", "Article\x0b1 " * 5: "essay", "artİcle 1 " * 5: "essay", "é1234 1234é " * 5: "history", "1234_ " * 10: "essay", "x\r- Ab\r" * 10: "essay", "x\n- Ab\n" * 10: "drama", "x\x85- Ab" * 10: "essay", "dearé": "letters", "\x0bdear x": "essay"}
    spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.lens for r in QUERIES["genre_lens"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [*texts.values(), "essay"]


def test_merge_query(spark, tmp_path):
    """Forms of two letters count; unknown numbers of mentions are the least, those that are no numbers the most; keys come once; rows without a key are no entities."""
    nan = float("nan")
    rows = [(0, 1, 2.0), (2, 1, None), (3, 2, -5.0), (14, 1, None), (12, 1, 9.0), (15, 1, None), (20, 1, 1.0), (20, 1, 9.0), (21, 1, 2.0), (26, 1, 7.0), (27, 1, nan), (30, 1, 3.0), (33, 1, nan), (32, 2, 4.0), (None, 1, 1.0)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted((r.c_custkey, r.winner) for r in QUERIES["entity_merges"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL["entity_merges"]).fetchall()) and len(got) == 13 and (0, 3) in got


def test_resolve_sends_no_titles(spark, tmp_path, monkeypatch):
    """Titles stay where they are, though their file is small: a broadcast of more than 40 MB would fail."""
    rows = spark.range(10_000).selectExpr("id as p_partkey", "concat('Title ', sha1(string(id)), ' ', id) as p_name")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")
    try:
        asked = spark.createDataFrame([("title",), ("17",), ("9999",), ("nothing like it",), ("é",)], "q string")
        got = []
        for few in (10, 2):
            monkeypatch.setattr(ingest, "FEW_QUERIES", few)
            got.append(sorted(map(tuple, ingest.resolve_document(asked, spark.read.parquet(f"{tmp_path}/part.parquet"), "q", "p_partkey", "p_name").collect())))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got[0] == got[1] == [("17", 17), ("9999", 9999), ("title", 0), ("é", 0)]


def dealt_by_pair(df):
    """Whether pairs are dealt out again once they are made."""
    return re.search(r"hashpartitioning\((?:a|a_key)#", df._jdf.queryExecution().executedPlan().toString())


def test_pairs_once(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i % 90, [rng.choice(["x", "y", "z", "w", "", None]) for _ in range(rng.randrange(4))], i) for i in range(100)] + [(None, ["x"], 0)]
    df = spark.createDataFrame(rows, "k int, ks array<string>, n int")
    own = {}
    for k, ks, _ in rows:
        own.setdefault(k, set()).update(x for x in ks if x)
    want = sorted((a, b) for a in own for b in own if a is not None and b is not None and a < b and own[a] & own[b])
    for part in (1000, 3):
        got = works.pairs(df, "k", F.col("ks"), part)
        assert sorted(map(tuple, got.collect())) == want and not dealt_by_pair(got)
    more = works.pairs(df.where("n < 90"), "k", F.col("ks"), 3, ("n",))
    assert more.columns == ["a", "b", "a_n", "b_n"] and all(r.a_n == r.a and r.b_n == r.b for r in more.collect())
    spark.createDataFrame([(i, "A name" if i % 3 else None, i % 2, "B") for i in range(20)], "p_partkey long, p_name string, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["work_pairs"](spark, str(tmp_path))
    assert got.count() == sum(a % 3 > 0 and b % 3 > 0 and a % 2 == b % 2 for a in range(20) for b in range(a + 1, 20)) and not dealt_by_pair(got)


def test_relation_query(spark, tmp_path):
    """Relations of works as in the SQL, also where author, title or year is away; works of other authors are not compared."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["Red ring", "red Ring", "rod", None]), rng.choice(["A", "a.", "B", None]), rng.choice([1, 3, 12]), rng.choice(["T", "U"])) for i in range(150)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["work_relations"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    cur = con.execute(ORACLE_SQL["work_relations"])
    columns = [c[0] for c in cur.description]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cur.fetchall()) and not dealt_by_pair(df)


def test_similar_titles_query(spark, tmp_path):
    """Pairs as in the SQL; names, not parts, are compared, and no part is broadcast."""
    rng = random.Random(8)
    rows = [(i, " ".join(["of", rng.choice(["red", "ring", "bolt"]), *rng.choices(["red", "ring", "of", "bolt", "old", "rod"], k=rng.randrange(6))]), rng.choice(["A", "B"]), rng.choice([1, 2, None])) for i in range(300)] + [(400, None, "A", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["title_similarity_pairs"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["title_similarity_pairs"]).fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.select("a", "b", "sim").collect())) == want and len(want) > 3000
    assert plan.count("SortMergeJoin") >= 2 and "intersect" not in plan


def test_title_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 4 + str(rng.randrange(40)) for _ in range(30))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.ref_id: (r.doc_id, r.rule) for r in QUERIES["reference_titles"](spark, str(tmp_path)).collect()}
    assert all(got.get(i) == (i, "title") for i in range(60) if i % 3 != 1)


def test_title_query_of_copies(spark, tmp_path):
    """Texts without words are no error; copies meet the smallest key of their title and year."""
    text = "Natural selection preserves favourable variations of every species here"
    rows = [(i, text if i % 5 else f"Other words about thing{i} stand here, never twice seen") for i in range(300)] + [(300, "... --- !"), (301, ""), (302, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.ref_id: (r.doc_id, r.rule) for r in QUERIES["reference_titles"](spark, str(tmp_path)).collect()}
    for i in range(300):
        near = [k for k in range(300) if k % 5 and abs(k % 100 - i % 100 - (5 if i % 3 == 1 else 0)) <= 1]
        assert i % 5 == 0 or got.get(i) == ((min(near), "title") if near else None)
