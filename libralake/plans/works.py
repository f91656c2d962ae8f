"""Queries: works and their relations, entities, references, logs, and the decisions around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bibliography, dense, graph, history, ingest, structure, works
from .registry import query, sql_key, sql_tokens, table

SQL_LINES = "u AS (SELECT doc_id, p.i - 1 AS place, p.u AS unit FROM (SELECT doc_id, unnest(list_transform(list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) > 0), lambda s, i: {'i': i, 'u': s})) AS p FROM documents))"


def pick(values, i):
    return F.element_at(F.array(*map(F.lit, values)), i.cast("int"))


# ---- works and links --------------------------------------------------------


SQL_TITLES = f"w AS (SELECT item_id, array_to_string({sql_tokens('text')}[1:3], ' ') AS t, {sql_tokens('text')}[4] AS s FROM benchmark)"


@query("content_signals", rf"""WITH {SQL_TITLES}, own AS (SELECT t, min(item_id) AS item_id, min(s) AS s, len(string_split(t, ' ')) AS n FROM w WHERE length(t) >= 6 GROUP BY t HAVING count(*) = 1), toks AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents),
m AS (SELECT doc_id, item_id, t, s, ' ' || substr(' ' || array_to_string(w[greatest(1, p - 111) : p - 1], ' ') || ' ', greatest(1, length(array_to_string(w[greatest(1, p - 111) : p - 1], ' ')) + 3 - 220)) || t || substr(' ' || array_to_string(w[p + n : p + n + 110], ' '), 1, 220) || ' ' AS near
 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM toks) JOIN own ON array_to_string(w[p : p + 2], ' ') = t),
b AS (SELECT *, contains(near, ' ' || s || ' ') AND s <> '' AS by_author, CASE WHEN list_aggregate([contains(near, ' ' || c || ' ') FOR c IN string_split('{works.TRANSLATION}', ', ')], 'bool_or') THEN 'translation' WHEN list_aggregate([contains(near, ' ' || c || ' ') FOR c IN string_split('{works.ADAPTATION}', ', ')], 'bool_or') THEN 'adaptation' ELSE 'cites' END AS relation FROM m)
SELECT doc_id, item_id, relation, max(CASE WHEN relation = 'translation' THEN 0.75 WHEN relation = 'adaptation' THEN CASE WHEN by_author THEN 0.85 ELSE 0.75 END WHEN by_author THEN 0.5 ELSE 0.35 END)::DOUBLE AS weight, count(*) AS n_places FROM b WHERE by_author OR (length(t) >= 10 AND contains(t, ' ')) GROUP BY ALL""")
def _(spark, d):
    """Three words of a benchmark text as a title, the fourth as its author; every fifth document says that it translates or adapts."""
    words = T.tokens(F.col("text"))
    w = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(words, 1, 3), " ").alias("t"), F.get(words, F.lit(3)).alias("s"))
    return works.content_signals(table(spark, d, "documents"), w, "doc_id", "text", "item_id", "t", "s")


@query("card_similarity", """WITH p AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 0.4 + 0.6 AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), v AS (SELECT *, greatest(0, least(1, (c - 0.62) / 0.3)) AS v FROM p) SELECT vec_id, CASE WHEN v >= 0.2 THEN round(v * 0.6 + 1e-9, 2) END AS weight FROM v""")
def _(spark, d):
    from ..functions.vectors import cosine

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return p.select("vec_id", works.card_similarity(cosine(F.col("embedding").cast("array<double>"), F.col("other").cast("array<double>")) * 0.4 + 0.6 + 1e-9).alias("weight"))


@query("work_pairs", f"WITH k AS (SELECT p_partkey, {sql_key('p_name')} || p_size AS k FROM part) SELECT DISTINCT a.p_partkey AS a, b.p_partkey AS b FROM k a JOIN k b USING (k) WHERE a.p_partkey < b.p_partkey")
def _(spark, d):
    return works.pairs(table(spark, d, "part"), "p_partkey", F.array(F.concat(T.key(F.col("p_name")), F.col("p_size").cast("string"))))


@query("work_relations", f"""WITH k AS (SELECT p_partkey AS key, p_name AS title, p_brand AS author, 1900 + p_size AS year, p_type AS lang FROM part), p AS (SELECT a.key AS a_key, b.key AS b_key, {sql_key('a.author')} = {sql_key('b.author')} AS sa, a.lang <> b.lang AS ol, a.year <> b.year AS oy, b.key % 50 = 7 AND a.key = b.key - 7 AS part FROM k a JOIN k b ON {sql_key('a.title')} = {sql_key('b.title')} AND a.key < b.key AND a.year // 10 = b.year // 10)
SELECT a_key, b_key, CASE WHEN part THEN 'part_of' WHEN sa AND ol THEN 'translation' WHEN sa AND oy THEN 'edition' WHEN sa THEN 'same_work' END AS relation, CASE WHEN part THEN 0.95 WHEN sa AND ol THEN 0.8 WHEN sa AND oy THEN 0.75 WHEN sa THEN 0.9 END::DOUBLE AS weight FROM p WHERE part OR sa""")
def _(spark, d):
    """Signals of metadata over pairs of works with one title of one decade: those of one author, and parts with their wholes."""
    kept, author, title = ("titled", "named", "year", "lang", "parent"), T.key(F.col("p_brand")), T.key(F.col("p_name"))
    p = table(spark, d, "part").select("p_partkey", (1900 + F.col("p_size")).alias("year"), F.col("p_type").alias("lang"), F.when(F.col("p_partkey") % 50 == 7, F.col("p_partkey") - 7).alias("parent"), F.coalesce(author, F.lit("")).alias("by"), (F.length(title) > 0).alias("titled"), author.isNotNull().alias("named"), title.alias("block"))
    p = p.withColumn("block", F.concat("block", F.lit("/"), F.floor(F.col("year") / 10).cast("string")))
    # Titles and authors of a block are the same, so nothing is compared for each pair.
    one = works.pairs(p, "p_partkey", F.array(F.concat("block", F.lit("/"), "by")), carried=kept)
    side = lambda s: p.select(F.col("p_partkey").alias(s), F.col("block").alias(f"{s}_block"), F.col("by").alias(f"{s}_by"), *[F.col(c).alias(f"{s}_{c}") for c in kept])
    part = side("b").where("b_parent is not null").join(side("a"), F.col("b_parent") == F.col("a")).where("a < b and a_block = b_block and a_by <> b_by")
    rows = one.unionByName(part.select(*one.columns)).withColumnsRenamed({"a": "a_key", "b": "b_key"})
    return ingest.relation_signals(rows, F.col("a_titled"), F.col("a_named") & F.col("b_named")).select("a_key", "b_key", "relation", "weight")


@query("entity_overlap", """WITH own AS (SELECT DISTINCT l_suppkey AS doc, l_partkey AS e FROM lineitem), n AS (SELECT count(DISTINCT doc) AS n FROM own), idf AS (SELECT e, ln(1 + n / count(*)) AS w FROM own, n GROUP BY e, n), mass AS (SELECT doc, e, w FROM own JOIN idf USING (e)), t AS (SELECT doc, sum(w) AS t FROM mass GROUP BY 1), p AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier),
c AS (SELECT a, b, sum(w) AS c FROM p JOIN mass x ON x.doc = a JOIN own y ON y.doc = b AND y.e = x.e GROUP BY ALL) SELECT a, b, round(c / least(x.t, y.t), 6) AS overlap FROM c JOIN t x ON x.doc = a JOIN t y ON y.doc = b""")
def _(spark, d):
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return graph.idf_overlap(table(spark, d, "lineitem"), pairs, "l_suppkey", "l_partkey", "a", "b").withColumn("overlap", F.round("overlap", 6))


@query("correspondences", "WITH al AS (SELECT l_orderkey, l_quantity * 10 AS a0, l_quantity * 10 + 15 AS a1, l_tax * 100 AS b0, l_tax * 100 + 5 AS b1, l_linenumber::VARCHAR AS t FROM lineitem), an AS (SELECT o_orderkey, o_custkey % 500 AS s, o_custkey % 500 + 40 AS e FROM orders) SELECT o_orderkey AS l_orderkey, s, e, b0 AS other_start, b1 AS other_end, t AS other_text FROM an JOIN al ON o_orderkey = l_orderkey AND s < a1 AND a0 < e")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") * 10).alias("a_start"), (F.col("l_quantity") * 10 + 15).alias("a_end"), (F.col("l_tax") * 100).alias("b_start"), (F.col("l_tax") * 100 + 5).alias("b_end"), F.col("l_linenumber").cast("string").alias("b_text"))
    anchors = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 500).alias("s"), (F.col("o_custkey") % 500 + 40).alias("e"))
    return works.correspondences(anchors, li, "l_orderkey", "s", "e", 50.0)


@query("link_choice", """WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'work' WHEN l_orderkey % 3 = 1 THEN 'person' ELSE 'place' END AS kind, min(l_partkey) % 3 > 0 AS exact, min(l_partkey) % 11 = 0 AS dis, min(l_partkey) % 7 > 0 AS described, min(l_suppkey) % 2 = 0 AS author, min(l_quantity) > 25 AS year, min(l_returnflag) = 'R' AS derived, min(l_linestatus) = 'F' AS is_work FROM lineitem GROUP BY l_orderkey, l_linenumber),
p AS (SELECT *, CASE kind WHEN 'person' THEN author::INT * 2 + year::INT WHEN 'work' THEN 3 + year::INT * 2 - derived::INT * 3 ELSE 0 END AS points, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first FROM c), f AS (SELECT *, lead(points) OVER w AS nxt, row_number() OVER w AS r FROM p WHERE exact AND described AND NOT dis AND (kind <> 'work' OR (is_work AND author)) WINDOW w AS (PARTITION BY l_orderkey ORDER BY points DESC, l_linenumber))
SELECT l_orderkey, l_linenumber, points::INTEGER AS points FROM f WHERE r = 1 AND (nxt IS NULL OR nxt < points OR l_linenumber = first) AND (kind <> 'work' OR points >= 2)""")
def _(spark, d):
    c = F.col
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(x).alias(x) for x in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")])
    kind = F.when(c("l_orderkey") % 3 == 0, "work").when(c("l_orderkey") % 3 == 1, "person").otherwise("place")
    return works.choose_link(li, "l_orderkey", "l_linenumber", kind, c("l_partkey") % 3 > 0, c("l_partkey") % 11 == 0, c("l_partkey") % 7 > 0, c("l_suppkey") % 2 == 0, c("l_quantity") > 25, c("l_returnflag") == "R", c("l_linestatus") == "F")


@query("candidate_works", """WITH d AS (SELECT p_partkey AS doc, p_retailprice / 10000 AS s FROM part WHERE p_size = 7), f AS (SELECT l_partkey AS doc, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS r FROM lineitem QUALIFY r < 24), p AS (SELECT doc, 3 * s + 1 AS p FROM d UNION ALL SELECT doc, 1 / (r + 2) FROM f),
b AS (SELECT doc, sum(p) AS points FROM p GROUP BY 1 ORDER BY round(points, 9) DESC, doc LIMIT 12), r AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part), m AS (SELECT DISTINCT o AS doc FROM (SELECT a AS i, b AS o FROM r UNION ALL SELECT b, a FROM r) WHERE i IN (SELECT doc FROM b) AND o NOT IN (SELECT doc FROM b)) SELECT doc, round(points, 6) AS points FROM (SELECT * FROM b UNION ALL SELECT doc, 0 FROM m) ORDER BY round(points, 9) DESC, doc LIMIT 12""")
def _(spark, d):
    docs = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("doc"), (F.col("p_retailprice") / 10000).alias("s"))
    top = table(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(24)
    # 24 rows: one small window.
    frags = top.select(F.col("l_partkey").alias("doc"), (F.row_number().over(Window.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) - 1).alias("r"))
    rel = table(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return works.candidate_works(docs, frags, rel, "doc", "s", "r").withColumn("points", F.round("points", 6))


@query("catalogue_rows", """WITH m AS (SELECT l_suppkey AS doc, l_partkey AS e FROM lineitem), c AS (SELECT doc, e, count(*) AS n FROM m GROUP BY ALL), t AS (SELECT doc, string_agg(e::VARCHAR, ',' ORDER BY r) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, e) AS r FROM c) WHERE r <= 12 GROUP BY 1), rel AS (SELECT s_suppkey AS a, s_suppkey * 2 AS b FROM supplier WHERE s_suppkey > 0), e AS (SELECT a AS doc FROM rel UNION ALL SELECT b FROM rel)
SELECT s_suppkey AS doc, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_linenumber = 1)::BIGINT AS n_segments, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')::BIGINT AS n_cards, (SELECT count(*) FROM m WHERE m.doc = s_suppkey)::BIGINT AS n_mentions, (SELECT count(*) FROM e WHERE e.doc = s_suppkey)::BIGINT AS n_relations, coalesce(t.entities, '') AS entities FROM supplier LEFT JOIN t ON t.doc = s_suppkey""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumnsRenamed({"l_suppkey": "doc", "l_partkey": "e"})
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "doc")
    rel = s.where("doc > 0").select(F.col("doc").alias("a"), (F.col("doc") * 2).alias("b"))
    return works.catalogue_rows(s, li.where("l_linenumber = 1"), li.where("l_returnflag = 'R'"), li.select("doc", "e"), rel, "doc", "e")


@query("context_lines", "SELECT p_partkey, concat_ws(' · ', nullif(trim(p_name), ''), nullif(concat_ws(', ', CASE WHEN p_size % 3 > 0 THEN p_brand END, CASE WHEN p_size % 2 = 0 THEN (1900 + p_size)::VARCHAR END), ''), CASE WHEN p_size % 5 = 0 THEN p_type END, CASE WHEN p_size % 4 > 0 THEN 'p. ' || p_size END) AS line FROM part WHERE p_size % 3 > 0 OR p_size % 2 = 0")
def _(spark, d):
    c = F.col
    line = works.context_line(c("p_name"), F.when(c("p_size") % 3 > 0, c("p_brand")), F.when(c("p_size") % 2 == 0, 1900 + c("p_size")), F.when(c("p_size") % 5 == 0, c("p_type")), F.when(c("p_size") % 4 > 0, c("p_size")))
    return table(spark, d, "part").where("p_size % 3 > 0 or p_size % 2 = 0").select("p_partkey", line.alias("line"))


@query("colophons", """WITH x AS (SELECT s_suppkey, s_suppkey % 4 AS k, ['Madrid', 'Alcala de Henares', 'Sevilla'][1 + s_suppkey % 3] AS c, ['Juan de la Cuesta', 'Pedro Madrigal', 'Ana Ruiz'][1 + s_suppkey % 3] AS n, 1500 + s_nationkey AS y FROM supplier)
SELECT s_suppkey, CASE WHEN k < 2 THEN c END AS place, CASE WHEN k < 3 THEN n END AS printer, CASE WHEN k = 0 THEN y WHEN k = 1 THEN 1605 END::INTEGER AS year FROM x""")
def _(spark, d):
    i = 1 + F.col("s_suppkey") % 3
    city, name, y = pick(["Madrid", "Alcala de Henares", "Sevilla"], i), pick(["Juan de la Cuesta", "Pedro Madrigal", "Ana Ruiz"], i), (1500 + F.col("s_nationkey")).cast("string")
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, F.concat(F.lit("En "), city, F.lit(", por "), name, F.lit(", año de "), y, F.lit("."))).when(k == 1, F.concat(F.lit("Con privilegio. En "), city, F.lit(": en casa de "), name, F.lit(", M.D.C.V."))).when(k == 2, F.concat(F.lit("printed by "), name)).otherwise("sin pie")
    c = works.colophon(text)
    return table(spark, d, "supplier").select("s_suppkey", c["place"].alias("place"), c["printer"].alias("printer"), c["year"].alias("year"))


@query("printer_years", """WITH x AS (SELECT s_suppkey, s_suppkey % 5 AS k, s_suppkey % 4 AS h FROM supplier), p(k, born, died, a, z) AS (VALUES (0, 1550, 1610, NULL, NULL), (1, NULL, 1600, 1580, 1599), (2, NULL, NULL, NULL, NULL), (3, NULL, 1620, NULL, NULL))
SELECT s_suppkey, CASE WHEN h = 0 THEN died ELSE coalesce(a, born + 18) END::INTEGER AS from_year, CASE WHEN h > 0 THEN coalesce(z, died) END::INTEGER AS to_year, CASE WHEN h = 0 THEN CASE WHEN died IS NOT NULL THEN 0.45 END WHEN a IS NOT NULL OR z IS NOT NULL THEN 0.5 WHEN coalesce(born, died) IS NOT NULL THEN 0.4 END::DOUBLE AS confidence FROM x LEFT JOIN p USING (k)""")
def _(spark, d):
    rows = [("Printer 0", 1550, 1610, None, None), ("Printer 1", None, 1600, 1580, 1599), ("Printer 2", None, None, None, None), ("Printer 3", None, 1620, None, None)]
    known = spark.createDataFrame(rows, "printer string, born int, died int, active_from int, active_to int")
    name = F.concat(F.when(F.col("s_suppkey") % 4 == 0, "Viuda de ").when(F.col("s_suppkey") % 4 == 1, "Imprenta de ").otherwise(""), F.lit("Printer "), (F.col("s_suppkey") % 5).cast("string"))
    return works.printer_years(table(spark, d, "supplier").select("s_suppkey", name.alias("name")), known, "name").drop("name")


# ---- entities ---------------------------------------------------------------


@query("entity_recount", "SELECT l_partkey, count(*)::BIGINT AS n_mentions, count(DISTINCT l_suppkey)::BIGINT AS n_docs FROM lineitem GROUP BY 1")
def _(spark, d):
    return graph.recount(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("entity_search", f"SELECT p_partkey FROM part WHERE contains({sql_key('p_name')}, 'ring') OR contains({sql_key('p_type')}, 'ring') ORDER BY starts_with({sql_key('p_name')}, 'ring') DESC, p_retailprice DESC, p_partkey LIMIT 20")
def _(spark, d):
    p = table(spark, d, "part").withColumn("aliases", F.array("p_type"))
    return graph.search_entities(p, "the Ring", "p_partkey", "p_name", "aliases", "p_retailprice").select("p_partkey")


@query("entities_of_document", "SELECT l_partkey, count(*)::BIGINT AS n, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS parts FROM lineitem WHERE l_suppkey = 3 GROUP BY 1")
def _(spark, d):
    return graph.entities_of(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_linenumber", 3).withColumn("parts", F.array_join("parts", ","))


@query("labels_to_redo", "WITH e AS (SELECT o_orderkey, o_custkey AS a, (o_custkey * 7) % (SELECT count(*) FROM customer) AS b, 'Customer ' || lpad(o_custkey::VARCHAR, 9, '0') || ' met customer ' || lpad(((o_custkey * 7 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % (SELECT count(*) FROM customer))::VARCHAR, 9, '0') AS s FROM orders) SELECT o_orderkey FROM e WHERE a < (SELECT count(*) FROM customer) AND o_orderkey % 3 = 0 AND a <> b")
def _(spark, d):
    names = table(spark, d, "customer").select("c_custkey", "c_name")
    n = names.count()
    other = F.col("o_custkey") * 7
    said = F.concat(F.lit("Customer "), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" met customer "), F.lpad(((other + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)) % n).cast("string"), 9, "0"))
    edges = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (other % n).alias("b"), said.alias("s"))
    return graph.labels_to_redo(edges, names, "c_custkey", "c_name", "a", "b", "s").select("o_orderkey")


SQL_COMPAT = """(len(list_intersect(list_filter({x}, lambda w: length(w) >= 3), list_filter({y}, lambda w: length(w) >= 3))) > 0 OR len(list_intersect(list_transform(list_filter({x}, lambda w: length(w) >= 5), lambda w: w[1:5]), list_transform(list_filter({y}, lambda w: length(w) >= 5), lambda w: w[1:5]))) > 0
 OR (len({x}) > 1 AND len(list_filter({x}, lambda w: length(w) > 1)) = 0 AND array_to_string({x}, '') = array_to_string(list_transform({y}, lambda w: w[1]), '')) OR (len({y}) > 1 AND len(list_filter({y}, lambda w: length(w) > 1)) = 0 AND array_to_string({y}, '') = array_to_string(list_transform({x}, lambda w: w[1]), '')))"""


def sql_compatible(a: str, b: str) -> str:
    return SQL_COMPAT.format(x=sql_tokens(a), y=sql_tokens(b))


FORMS = ["Johnny", "J. C.", "Johnny Carter", "Parkers", "Bird", "Ann"]
NAMES = ["Charlie Parker", "Johnny Carter", "Ana Ruiz"]
SQL_FORMS = "['Johnny', 'J. C.', 'Johnny Carter', 'Parkers', 'Bird', 'Ann'][1 + l_linenumber % 6]"
SQL_NAMES = "['Charlie Parker', 'Johnny Carter', 'Ana Ruiz'][1 + (l_partkey % 3)]"


@query("compatible_forms", f"SELECT l_orderkey, l_linenumber, l_partkey, {sql_compatible(SQL_FORMS, SQL_NAMES)} AS fits FROM lineitem")
def _(spark, d):
    fits = graph.compatible(pick(FORMS, 1 + F.col("l_linenumber") % 6), pick(NAMES, 1 + F.col("l_partkey") % 3))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fits.alias("fits"))


@query("mention_repair", f"""WITH m AS (SELECT DISTINCT l_orderkey AS doc, {SQL_NAMES} AS name, {SQL_FORMS} AS form FROM lineitem), o AS (SELECT DISTINCT doc, name AS other FROM m), l AS (SELECT * FROM m WHERE NOT {sql_compatible('form', 'name')}), h AS (SELECT doc, name, form, min(other) AS home, count(DISTINCT other) AS c FROM l JOIN o USING (doc) WHERE other <> name AND {sql_compatible('form', 'other')} GROUP BY ALL)
SELECT doc, name, form, name AS home FROM m WHERE {sql_compatible('form', 'name')} UNION ALL SELECT l.doc, l.name, l.form, CASE WHEN c = 1 THEN home ELSE l.form END FROM l LEFT JOIN h USING (doc, name, form)""")
def _(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit("person").alias("kind"), pick(NAMES, 1 + F.col("l_partkey") % 3).alias("name"), pick(FORMS, 1 + F.col("l_linenumber") % 6).alias("form"))
    return graph.rehome(m, "doc", "kind", "name", "form").drop("kind")


@query("corroborated", f"""WITH x AS (SELECT doc_id, ['the notion of a threat', 'american writer 1950', 'thinning thing', 'saxophonist'][1 + doc_id % 4] AS d, text FROM documents), w AS (SELECT doc_id, ' ' || {sql_key('text')} || ' ' AS c, list_filter(string_split({sql_key('d')}, ' '), lambda w: length(w) >= 5 AND w NOT IN ({', '.join(f"'{g}'" for g in graph.GENERIC)}) AND NOT regexp_matches(w, '^\\d+$')) AS ws FROM x)
SELECT doc_id, len(list_filter(ws, lambda w: contains(c, ' ' || w || ' ') OR (length(w) >= 7 AND contains(c, ' ' || w[1:length(w) - 2])))) > 0 AS told FROM w""")
def _(spark, d):
    said = pick(["the notion of a threat", "american writer 1950", "thinning thing", "saxophonist"], 1 + F.col("doc_id") % 4)
    return table(spark, d, "documents").select("doc_id", graph.corroborated(said, F.col("text")).alias("told"))


@query("name_lookup", f"""WITH f AS (SELECT DISTINCT {sql_key('p_name')} AS k, p_size % 40 AS o FROM part), s AS (SELECT k, min(o) AS o FROM f GROUP BY k HAVING count(DISTINCT o) = 1), h AS (SELECT split_part(k, ' ', 1) AS k, min(o) AS o FROM f GROUP BY 1 HAVING count(DISTINCT o) = 1), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) || ' of all' END AS name FROM orders JOIN part ON p_partkey = o_custkey), k AS (SELECT *, {sql_key('name')} AS k FROM n)
SELECT o_orderkey, coalesce(s.o, CASE WHEN k.k NOT IN (SELECT k FROM f) THEN h.o END)::INTEGER AS owner FROM k LEFT JOIN s ON s.k = k.k LEFT JOIN h ON h.k = split_part(k.k, ' ', 1)""")
def _(spark, d):
    p = table(spark, d, "part")
    names = table(spark, d, "orders").join(p, F.col("o_custkey") == F.col("p_partkey")).select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" of all"))).alias("name"))
    forms = p.select("p_name", (F.col("p_size") % 40).alias("owner"))
    return graph.lookup(names, forms, "name", "owner", "p_name").select("o_orderkey", "owner")


# ---- references -------------------------------------------------------------


@query("reference_entries", rf"""WITH {SQL_LINES}, l AS (SELECT doc_id, place, CASE WHEN place % 7 = 2 THEN 'References' WHEN place % 7 = 6 THEN 'Appendix' WHEN place % 7 = 4 THEN 'Smith, ' || unit ELSE unit END AS t, place % 7 IN (2, 6) AS h FROM u), s AS (SELECT *, last_value(CASE WHEN h THEN {sql_key('t')} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place) AS head FROM l),
r AS (SELECT *, sum(CASE WHEN regexp_matches(t, '^\s*(\[\d+\]|\d{{1,3}}\.|\p{{Lu}}[\p{{L}}''-]+,)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS n FROM s WHERE NOT h AND head = 'references' AND trim(t) <> ''), e AS (SELECT doc_id, n::BIGINT AS entry_no, string_agg(trim(t), ' ' ORDER BY place) AS entry FROM r GROUP BY ALL)
SELECT doc_id, entry_no, md5(entry) AS digest FROM e WHERE length(entry) >= 30""")
def _(spark, d):
    u = structure.units(table(spark, d, "documents"), "doc_id", "text")
    k = F.col("place") % 7
    lines = u.select("doc_id", "place", F.when(k == 2, "References").when(k == 6, "Appendix").when(k == 4, F.concat(F.lit("Smith, "), "unit")).otherwise(F.col("unit")).alias("t"), k.isin(2, 6).alias("h"))
    return bibliography.entries(lines, "doc_id", "place", "t", "h").select("doc_id", "entry_no", F.md5("entry").alias("digest"))


@query("citation_update", """WITH e AS (SELECT o_custkey AS citing, o_orderkey AS ref, o_orderkey % 97 AS cited FROM orders WHERE o_orderkey % 5 > 0), f AS (SELECT o_custkey AS citing, o_orderkey AS ref, o_orderkey % 89 AS cited FROM orders), a AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 = 3), l AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 = 4),
n AS (SELECT DISTINCT * FROM f WHERE cited IN (SELECT k FROM a) OR citing IN (SELECT k FROM a)), k AS (SELECT * FROM e WHERE citing NOT IN (SELECT k FROM l) AND cited NOT IN (SELECT k FROM l)) SELECT citing, ref, cited FROM k WHERE (citing, ref) NOT IN (SELECT (citing, ref) FROM n) UNION ALL SELECT * FROM n""")
def _(spark, d):
    o = table(spark, d, "orders")
    edges = o.where("o_orderkey % 5 > 0").select(F.col("o_custkey").alias("citing"), F.col("o_orderkey").alias("ref"), (F.col("o_orderkey") % 97).alias("cited"))
    fresh = o.select(F.col("o_custkey").alias("citing"), F.col("o_orderkey").alias("ref"), (F.col("o_orderkey") % 89).alias("cited"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("citing"))
    return bibliography.update_edges(edges, fresh, c.where("citing % 10 = 3"), c.where("citing % 10 = 4"), "citing", "cited", "ref")


# ---- the log ----------------------------------------------------------------


@query("redacted_log", "SELECT event_id, user_id, CASE WHEN NOT user_id % 4 = 0 THEN props END AS props, user_id % 4 = 0 AS redacted FROM events")
def _(spark, d):
    return history.redacted(table(spark, d, "events").select("event_id", "user_id", "props"), F.col("user_id") % 4 == 0, ["props"])


@query("replayable_searches", f"WITH l AS (SELECT user_id, ts, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS q FROM events WHERE event_id % 9 > 0) SELECT user_id, arg_max(q, (ts, q)) AS q, max(ts) AS last, count(*)::BIGINT AS n FROM l GROUP BY user_id, {sql_key('q')}")
def _(spark, d):
    q = F.when(F.col("event_id") % 9 > 0, F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return history.replay(table(spark, d, "events").select("user_id", "ts", q.alias("q")), "user_id", "ts", "q")


@query("recommendations", """WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: 0.0) AS z FROM embeddings GROUP BY 1), x AS (SELECT label, i, round(avg(v::DOUBLE), 9) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), cen AS (SELECT label, list(m ORDER BY i) AS cen FROM x GROUP BY 1),
s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], cen), 6) AS s FROM embeddings, cen WHERE vec_id % 3 = 0), n AS (SELECT vec_id, arg_min(label, (-s, label)) AS label, max(s) AS s FROM (SELECT e.vec_id, c.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.cen), 6) AS s FROM embeddings e, cen c WHERE e.vec_id % 3 = 0) GROUP BY 1), k AS (SELECT label, count(*) AS n FROM n WHERE s > 0.3 GROUP BY 1), z AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1)
SELECT e.vec_id, round(k.n * 10 + z.size / 1000, 6) AS weight, k.n::BIGINT AS n FROM embeddings e JOIN k USING (label) JOIN z USING (label) WHERE e.vec_id NOT IN (SELECT user_id FROM events)""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    cells = dense.centroids(e, "label").withColumnRenamed("label", "cell")
    size = e.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    got = history.recommendations(e.where("vec_id % 3 = 0"), cells, e.select("vec_id", "label").join(size, "label"), table(spark, d, "events").select(F.col("user_id").alias("vec_id")), "vec_id", "embedding", "label", "vec_id", "size")
    return got.withColumn("weight", F.round("weight", 6))


@query("lot_states", "SELECT o_custkey, count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS n_done, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS n_failed, count(*) FILTER (o_orderstatus NOT IN ('F', 'P'))::BIGINT AS n_open, count(*) > 12 AS over FROM orders GROUP BY 1")
def _(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("waiting")
    return history.lot_states(table(spark, d, "orders").withColumn("state", state), "o_custkey", "state", 12)


@query("job_progress", "SELECT l_orderkey, round(sum(l_quantity * least(greatest(l_discount * 12, 0), 1)) / sum(l_quantity), 6) AS progress FROM lineitem GROUP BY 1")
def _(spark, d):
    return history.progress(table(spark, d, "lineitem").withColumn("done", F.col("l_discount") * 12), "l_orderkey", "l_quantity", "done").withColumn("progress", F.round("progress", 6))


@query("spelling_scores", "WITH w AS (SELECT source, doc_id % 3 > 0 AS a, n_chars % 5 > 1 AS b FROM documents) SELECT source, round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a), 0), 6) AS recall, round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (b), 0), 6) AS precision FROM w GROUP BY GROUPING SETS ((source), ())")
def _(spark, d):
    s = history.spelling_scores(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", F.col("doc_id") % 3 > 0, F.col("n_chars") % 5 > 1)
    return s.select("source", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))
