"""Queries: filters, table maintenance, names and titles, folios, transcripts and choices of fragments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations, dense, filters, folios, fusion, graph, ingest, intervals, layout, media, structure, tables
from .registry import query, sql_fold, sql_key, sql_tokens, table
from .works import SQL_LINES, pick

YEARS = r"(1\d{3}|20\d{2})"


# ---- filters ----------------------------------------------------------------


@query("allowed_documents", f"SELECT doc_id FROM documents WHERE lang[1:2] IN ('en', 'fr') AND (contains({sql_fold('source')}, 'src1') OR contains({sql_fold('source')}, 'src2')) AND 1500 + doc_id % 400 BETWEEN 1600 AND 1850 AND doc_id % 3 = 0")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("year", (1500 + F.col("doc_id") % 400).cast("int")).withColumn("type", F.when(F.col("doc_id") % 3 == 0, "book").otherwise("web"))
    return filters.allowed(docs, types=["book"], authors=["SRC1", "src2"], languages=["EN-gb", "fr"], years=filters.merge_years((1600, None), (1500, 1850)), columns={"authors": "source"}).select("doc_id")


@query("said_filters", """WITH q AS (SELECT o_orderkey, o_orderkey % 9 AS k, 1500 + o_custkey % 500 AS y, 'Márquez ' || o_custkey AS c FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN y WHEN 2 THEN y + 1 WHEN 4 THEN y END::INTEGER AS low, CASE k WHEN 0 THEN y + 20 WHEN 1 THEN y - 1 WHEN 3 THEN y END::INTEGER AS high, CASE WHEN k IN (5, 6) THEN y END::INTEGER AS page, CASE WHEN k IN (5, 6) THEN y::VARCHAR WHEN k = 7 THEN 'xiv' END AS folio, CASE k WHEN 6 THEN 'Çaín y ' || c END AS title, CASE WHEN k IN (1, 6) THEN [c] ELSE [] END AS authors FROM q""")
def _(spark, d):
    y = (1500 + F.col("o_custkey") % 500).cast("string")
    k = F.col("o_orderkey") % 9
    author = F.concat(F.lit("Márquez "), F.col("o_custkey").cast("string"))
    q = (
        F.when(k == 0, F.concat(F.lit("letters between "), y, F.lit(" and "), (y.cast("int") + 20).cast("string")))
        .when(k == 1, F.concat(F.lit("liberty in "), author, F.lit(" before "), y)).when(k == 2, F.concat(F.lit("después de "), y)).when(k == 3, F.concat(F.lit("until "), y))
        .when(k == 4, F.concat(F.lit("seit "), y)).when(k == 5, F.concat(F.lit("go to page "), y)).when(k == 6, F.concat(F.lit("Página "), y, F.lit(" de Çaín y "), author, F.lit(" ")))
        .when(k == 7, "ir a la p. xiv").otherwise(F.concat(F.lit("the page of liberty "), y))
    )
    asked = T.computed(table(spark, d, "orders"), ["o_orderkey"], q=q, author=author)
    q = F.col("q")
    low, high = filters.said_years(q)
    folio, title = filters.said_folio(q)
    return asked.select("o_orderkey", low.alias("low"), high.alias("high"), filters.said_page(q).alias("page"), folio.alias("folio"), title.alias("title"), filters.said_authors(q, F.array("author", F.lit("zz"))).alias("authors"))


@query("span_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity <= 30 AND l_quantity + l_linenumber >= 20")
def _(spark, d):
    lo = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    return table(spark, d, "lineitem").where(filters.overlaps_span(lo, lo + F.col("l_linenumber"), 20, 30)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("entity_filter", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 7) OR o_custkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 7)")
def _(spark, d):
    """Fragments with a mention of an entity, or on a page where it appears."""
    m = table(spark, d, "lineitem").where("l_partkey = 7")
    o = table(spark, d, "orders")
    return o.join(m.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey").unionByName(o.join(m.select(F.col("l_suppkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")).distinct()


@query("quality_floor", f"WITH {SQL_LINES}, s AS (SELECT *, doc_id % 5 AS sec FROM u WHERE length(regexp_replace(unit, '[^\\p{{L}}]', '', 'g')) >= 12), f AS (SELECT *, min(place) OVER (PARTITION BY doc_id, sec, unit) AS first FROM s) SELECT doc_id, place::INTEGER AS place FROM f WHERE length(unit) <= 200 OR first = place")
def _(spark, d):
    u = structure.units(table(spark, d, "documents"), "doc_id", "text").withColumn("sec", F.col("doc_id") % 5)
    return ingest.quality_floor(u, "doc_id", "sec", "unit", "place").select("doc_id", "place")


@query("similar_above", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 5) b WHERE a.label <> 1 ORDER BY score DESC, a.vec_id LIMIT 20")
def _(spark, d):
    """Passages of other sources most like a query."""
    e = table(spark, d, "embeddings")
    q = [float(x) for x in e.where("vec_id = 5").first()["embedding"]]
    return dense.knn(e, q, 20, where=F.col("label") != 1).select("vec_id", F.round("score", 6).alias("score"))


@query("most_important", "SELECT p_partkey, p_size FROM part WHERE p_size >= 4 ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 40")
def _(spark, d):
    return table(spark, d, "part").where("p_size >= 4").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(40).select("p_partkey", "p_size")


@query("enum_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders")
def _(spark, d):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, F.desc("o_totalprice"), "o_orderkey")).alias("place"))


SQL_NATURAL = "array_to_string(list_transform(regexp_extract_all({x}, '\\d+|[^\\d]+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(ltrim(p, '0'), 20, '0') ELSE p END), '')"


@query("natural_order", f"WITH n AS (SELECT p_partkey, p_brand, p_name || ' ' || p_size || ' v' || (p_partkey % 12) AS name FROM part) SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {SQL_NATURAL.format(x=sql_fold('name'))}, p_partkey)::INTEGER AS place FROM n")
def _(spark, d):
    name = F.concat_ws("", "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" v"), (F.col("p_partkey") % 12).cast("string"))
    return table(spark, d, "part").withColumn("k", ingest.natural_key(name)).select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("k", "p_partkey")).alias("place"))


# ---- tables -----------------------------------------------------------------


@query("cascade_delete", "SELECT 'orders' AS name, count(*)::BIGINT AS n FROM orders WHERE o_custkey % 5 <> 2 UNION ALL SELECT 'events', count(*) FROM events WHERE user_id % 5 <> 2 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 5 <> 2")
def _(spark, d):
    gone = table(spark, d, "customer").where("c_custkey % 5 = 2").select(F.col("c_custkey").alias("k")).unionByName(table(spark, d, "events").where("user_id % 5 = 2").select(F.col("user_id").alias("k"))).unionByName(table(spark, d, "orders").where("o_custkey % 5 = 2").select(F.col("o_custkey").alias("k"))).distinct()
    kept = {"orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "events": table(spark, d, "events").withColumnRenamed("user_id", "k"), "customer": table(spark, d, "customer").withColumnRenamed("c_custkey", "k")}
    return tables.counts(tables.cascade_delete(kept, gone, "k"))


@query("vector_upsert", "SELECT vec_id, label FROM embeddings WHERE vec_id % 10 <> 3 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 10 = 3")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return tables.upsert(e, e.where("vec_id % 10 = 3").withColumn("label", F.col("label") + 100), ["vec_id"])


@query("export_manifest", "SELECT 'nation' AS name, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def _(spark, d):
    return tables.counts({n: table(spark, d, n) for n in ("nation", "documents", "lineitem")})


@query("steps_once", "SELECT o_custkey, min(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS first_even, count(*) FILTER (o_orderkey % 2 = 0)::BIGINT AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, -1, 1 FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 2 = 0) = 0")
def _(spark, d):
    """Steps are recorded where no record of them is there yet."""
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_even"), F.count(F.lit(1)).alias("n"))
    new = o.select("o_custkey", F.lit(-1).cast("long").alias("first_even"), F.lit(1).cast("long").alias("n")).distinct()
    return tables.insert_missing(old, new, ["o_custkey"])


@query("reconciled_relations", """WITH old AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS mine, 'a' AS rel, o_custkey AS made FROM orders WHERE o_orderkey % 3 > 0), new AS (SELECT o_orderkey AS k, false AS mine, 'b' AS rel, -1::BIGINT AS made FROM orders WHERE o_orderkey % 2 = 0), ev AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 < 3)
SELECT * FROM old WHERE mine OR k NOT IN (SELECT k FROM ev) UNION ALL SELECT n.k, n.mine, n.rel, coalesce(o.made, n.made) FROM (SELECT * FROM new WHERE k IN (SELECT k FROM ev)) n LEFT JOIN old o ON o.k = n.k WHERE n.k NOT IN (SELECT k FROM old WHERE mine)""")
def _(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("mine"), F.lit("a").alias("rel"), F.col("o_custkey").alias("made"))
    seen = o.where("o_orderkey % 5 < 3").select(F.col("o_orderkey").alias("k"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit(False).alias("mine"), F.lit("b").alias("rel"), F.lit(-1).cast("long").alias("made")).join(seen, "k", "left_semi")
    return tables.reconcile(old, new, seen, ["k"], "mine", "made")


@query("renumbered", "SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS place FROM lineitem")
def _(spark, d):
    """Alignments in the order of both their sides."""
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).alias("place"))


# ---- names and titles -------------------------------------------------------


@query("author_overlap", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 > 0 AND l_suppkey % 5 > 0 THEN l_partkey % 4 = 1 AND l_suppkey % 5 <= 2 OR l_partkey % 4 = 2 AND l_suppkey % 5 IN (2, 3) OR l_partkey % 4 = 3 AND l_suppkey % 5 = 4 END AS shared FROM lineitem")
def _(spark, d):
    a = F.when(F.col("l_partkey") % 4 == 0, F.array().cast("array<string>")).when(F.col("l_partkey") % 4 == 1, F.array(F.lit("a"))).when(F.col("l_partkey") % 4 == 2, F.array(F.lit("b"))).otherwise(F.array(F.lit("z")))
    b = F.when(F.col("l_suppkey") % 5 == 0, F.array().cast("array<string>")).when(F.col("l_suppkey") % 5 == 1, F.array(F.lit("a"))).when(F.col("l_suppkey") % 5 == 2, F.array(F.lit("a"), F.lit("b"))).when(F.col("l_suppkey") % 5 == 3, F.array(F.lit("b"))).otherwise(F.array(F.lit("z")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ingest.authors_match(a, b).alias("shared"))


@query("people_in_titles", r"WITH p AS (SELECT doc_id, list_transform(regexp_split_to_array(split_part(text, chr(10), 1), '\s*,\s*|\s+(?:y|e|and|&)\s+'), lambda x: trim(x)) AS p FROM documents) SELECT doc_id, array_to_string(list_filter(p, lambda x: len(regexp_split_to_array(x, '\s+')) BETWEEN 2 AND 5), '|') AS people FROM p")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(ingest.people_in_title(F.split_part("text", F.lit("\n"), F.lit(1))), "|").alias("people"))


@query("presence_scores", "WITH c AS (SELECT doc_id, text, (length(text) - length(replace(text, 'that', ''))) // 4 AS n, (length(text) - length(replace(text, 'of that', ''))) // 7 AS f FROM documents) SELECT doc_id, (n + 2 * f + CASE WHEN doc_id % 2 = 0 AND n >= 2 THEN 10 ELSE 0 END)::DOUBLE AS score FROM c")
def _(spark, d):
    s = ingest.presence(F.col("text"), F.lit("that"), F.lit("of that"), F.col("doc_id") % 2 == 0)
    return table(spark, d, "documents").select("doc_id", s.cast("double").alias("score"))


SQL_LAST = "'Ruiz' || chr((97 + c_custkey % 26)::INTEGER) || chr((97 + c_custkey // 26 % 26)::INTEGER)"


@query("author_keys", f"SELECT c_custkey, lower({SQL_LAST}) || ' ' || chr((97 + c_nationkey)::INTEGER) AS k FROM customer")
def _(spark, d):
    """Names of customers in four ways of writing them, by their last name and nation."""
    letter = lambda n, base: F.char((F.lit(base) + n).cast("int"))
    last = F.concat(F.lit("Ruiz"), letter(F.col("c_custkey") % 26, 97), letter(F.expr("c_custkey div 26") % 26, 97))
    first = F.concat(letter(F.col("c_nationkey"), 65), F.lit("na"))
    ways = F.array(F.format_string("de %s, %s", last, first), F.format_string("van %s, %s", last, first), F.format_string("%s %s", first, last), F.format_string("%s. C. %s", letter(F.col("c_nationkey"), 65), last))
    name = F.element_at(ways, (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", ingest.author_key(name).alias("k"))


@query("clean_authors", "SELECT s_suppkey, ['Maria Lopez Garcia|', 'Ana Ruiz;Juan Perez|Canal Norte', 'Museo del Prado|', '|'][1 + s_suppkey % 4] AS who FROM supplier")
def _(spark, d):
    lists = F.array(
        F.array(F.lit("Maria Lopez"), F.lit("Maria Lopez Garcia (ed.)"), F.lit("M. Lopez")),
        F.array(F.lit("Canal Norte"), F.lit("Ana Ruiz"), F.lit("Juan Perez (dir.)"), F.lit("Ruiz, Ana")),
        F.array(F.lit("Museo del Prado")),
        F.array(F.lit("(anon)")),
    )
    c = ingest.clean_authors(F.element_at(lists, (1 + F.col("s_suppkey") % 4).cast("int")))
    return table(spark, d, "supplier").select("s_suppkey", F.concat_ws("|", F.array_join(c["people"], ";"), F.array_join(c["channels"], ";")).alias("who"))


@query("metadata_scores", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size % 8 = 0 ELSE p_size % 3 > 0 END AS title_ok, p_size % 2 = 0 AS year_ok, p_size % 5 < 3 AS authors_ok FROM part")
def _(spark, d):
    p, c = table(spark, d, "part"), F.col
    gold = p.select("p_partkey", F.when(c("p_size") % 4 != 0, F.lower("p_name")).alias("title"), c("p_size").alias("year"), F.array(F.lit("Cervantes"), F.lit("Ruiz")).alias("authors"))
    none = F.lit(None).cast("string")
    title = F.when(c("p_size") % 4 == 0, F.when(c("p_size") % 8 == 0, none).otherwise("x")).otherwise(F.when(c("p_size") % 3 > 0, F.upper("p_name")).otherwise("other"))
    names = F.when(c("p_size") % 5 == 0, F.array(F.lit("de Cervantes Saavedra"), F.lit("RUIZ"))).when(c("p_size") % 5 < 3, F.array(F.lit("Ruíz"), F.lit("Cervantes"), F.lit("More"))).when(c("p_size") % 5 == 3, F.array(F.lit("Ruiz"))).otherwise(F.array(F.lit("Ruiz"), F.lit("Cervantes"), F.lit("a"), F.lit("b")))
    found = p.select("p_partkey", title.alias("title"), F.when(c("p_size") % 2 == 0, c("p_size")).otherwise(0).alias("year"), names.alias("authors"))
    return ingest.metadata_scores(found, gold, "p_partkey", ["title", "year"], "authors")


@query("ene_keys", f"SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), '{T.ACCENTED.replace('ñ', '')}', '{T.PLAIN[:-1]}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.key_keeping_ene(F.col("text"))).alias("digest"))


@query("author_labels", "SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'A' WHEN 2 THEN 'A & B' WHEN 3 THEN 'A et al.' END || ', ' || CASE WHEN p_size % 5 > 0 THEN (1900 + p_size)::VARCHAR ELSE 'n.d.' END AS label FROM part WHERE p_size % 4 > 0")
def _(spark, d):
    who = F.slice(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.lit(1), F.col("p_size") % 4)
    return table(spark, d, "part").where("p_size % 4 > 0").select("p_partkey", T.author_label(who, F.when(F.col("p_size") % 5 > 0, 1900 + F.col("p_size"))).alias("label"))


@query("word_cuts", r"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(text[1:80], '\s+\S*\z', '') || '…' END AS cut FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_words(F.col("text"), 80).alias("cut"))


@query("language_vote", r"WITH n AS (SELECT source, lang, sum(len(regexp_extract_all(text, '\S+'))) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) SELECT source, arg_min(lang, (-n, lang)) AS lang FROM n GROUP BY 1")
def _(spark, d):
    return ingest.language_vote(table(spark, d, "documents"), "source", "lang", "text")


# ---- passages and claims ----------------------------------------------------


@query("negative_claims", f"""WITH w AS (SELECT doc_id, array_to_string({sql_tokens('text')}[1:4], ' ') AS s, doc_id % 12 AS k FROM documents) SELECT doc_id, CASE WHEN k < 7 AND s <> '' THEN s WHEN k = 7 THEN 'Of this the print ' || s || ' is notably absent' END AS subject FROM w""")
def _(spark, d):
    """Claims in four languages about the first words of each document; the last five deny no mention."""
    s = F.array_join(F.slice(T.tokens(F.col("text")), 1, 4), " ")
    said = ("The author does not mention %s.", "Cervantes nunca habla de %s", "L'auteur ne mentionne pas %s!", "C'è assenza di menzione di %s;", "There is a lack of any discussion about %s", "Hay omisión de toda referencia a %s.", "They NEVER discuss %s",
            "Of this the print %s is notably absent", "It is not only a satire of %s", "There is no doubt that %s", "He never came to %s", "No one minds %s")
    claim = F.element_at(F.array(*[F.format_string(c, s) for c in said]), (F.col("doc_id") % 12 + 1).cast("int"))
    claims = T.computed(table(spark, d, "documents"), ["doc_id"], claim=claim)
    return claims.select("doc_id", citations.absent_subject(F.col("claim")).alias("subject"))


@query("missing_terms", f"""WITH w AS (SELECT doc_id, text, {sql_tokens('text')} AS t, doc_id % 90 + 10 AS n FROM documents), c AS (SELECT *, upper(t[1][1]) || t[1][2:] AS a FROM w)
SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN length(a) >= 3 AND regexp_matches(a, '^\\p{{Lu}}') AND a <> upper(a) AND NOT contains({sql_fold('text')}, {sql_fold('a')}) THEN [a] ELSE [] END || ['Zyxwvut'] || CASE WHEN contains(text, n || ' %') THEN [] ELSE [n || ' %'] END AS missing FROM c""")
def _(spark, d):
    """A name of the text, one that no text has, a share and a year."""
    docs = T.computed(table(spark, d, "documents"), ["doc_id", "text"], word=F.coalesce(F.get(T.tokens(F.col("text")), F.lit(0)), F.lit("x")))
    # A letter without a capital of one letter (ß) stays as it is.
    capital = F.upper(F.substring("word", 1, 1))
    first = F.when(F.length(capital) == 1, F.concat(capital, F.substring("word", F.lit(2), F.length("word")))).otherwise(F.col("word"))
    claim = F.concat(F.lit("Then "), first, F.lit(" met Zyxwvut. Both ABC took "), (F.col("doc_id") % 90 + 10).cast("string"), F.lit(" % in 1860."))
    return T.computed(docs, ["doc_id", "text"], claim=claim).select("doc_id", citations.missing_terms(F.col("claim"), F.col("text")).alias("missing"))


@query("closest_units", """WITH u AS (SELECT user_id, min(event_id) AS unit, epoch_us(ts) AS t0, epoch_us(ts) + 300000000 AS t1 FROM events WHERE event_type = 'view' GROUP BY user_id, ts), k AS (SELECT * FROM u QUALIFY coalesce(t0 >= lag(t1) OVER (PARTITION BY user_id ORDER BY t0), true)), f AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
d AS (SELECT event_id, unit, t >= t0 AND t < t1 AS inside, CASE WHEN t >= t0 AND t < t1 THEN -1 WHEN t0 <= t THEN t - t1 ELSE t0 - t END AS gap, t0 FROM f JOIN k USING (user_id)) SELECT f.event_id, arg_min(unit, (gap, t0)) AS unit, coalesce(bool_or(inside), false) AS inside FROM f LEFT JOIN d USING (event_id) GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    u = e.where("event_type = 'view'").groupBy("user_id", F.col("t").alias("t0")).agg(F.min("event_id").alias("unit")).withColumn("t1", F.col("t0") + 300000000)
    w = Window.partitionBy("user_id").orderBy("t0")
    u = u.withColumn("_l", F.lag("t1").over(w)).where("_l is null or t0 >= _l").drop("_l")
    frames = e.where("event_type = 'error'").select("event_id", "user_id", "t")
    return media.closest_units(frames, u, "user_id", "t", "t0", "t1", "unit").select("event_id", "unit", "inside")


ASKED = ["small ring", "RING", "red wid", "id", "12", "nothing like it", "é", "large"]


@query("resolve_titles", f"""WITH q(q) AS (VALUES {', '.join(f"('{q}')" for q in ASKED)}), k AS (SELECT q, p_partkey, {sql_key('p_name')} AS t, {sql_key('q')} AS k FROM part, q), r AS (SELECT q, p_partkey, CASE WHEN p_partkey::VARCHAR = q THEN 0 WHEN t = k THEN 1 WHEN k <> '' AND starts_with(t, k) THEN 2 WHEN k <> '' AND contains(t, k) THEN 3 END AS r FROM k)
SELECT q, arg_min(p_partkey, (r, p_partkey)) AS p_partkey FROM r WHERE r IS NOT NULL GROUP BY q""")
def _(spark, d):
    return ingest.resolve_document(spark.createDataFrame([(q,) for q in ASKED], "q string"), table(spark, d, "part"), "q", "p_partkey", "p_name")
