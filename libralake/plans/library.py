"""Queries: structure, transcripts, citations, graphs, references, maps, insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, bibliography, citations, clusters, dense, filters, folios, graph, insights, metrics, normalizer, pages, structure, tables, transcripts
from .registry import query, sql_fold, sql_key, sql_tokens, table

SQL_UNITS = "units AS (SELECT doc_id, p.i - 1 AS place, p.u AS unit FROM (SELECT doc_id, unnest(list_transform(list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) > 0), lambda s, i: {'i': i, 'u': s})) AS p FROM documents))"


# ---- structure -------------------------------------------------------------


@query("unit_split", f"WITH {SQL_UNITS} SELECT doc_id, place::INTEGER AS place, length(unit)::INTEGER AS n, md5(unit) AS digest FROM units")
def _(spark, d):
    return structure.units(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "place", F.length("unit").alias("n"), F.md5("unit").alias("digest"))


@query("joined_lines", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(\p{L})-\n(\p{Ll})', '\1\2', 'g'), '\s*\n\s*', ' ', 'g')) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(structure.joined_lines(F.col("text"))).alias("digest"))


@query("running_titles", f"WITH {SQL_UNITS}, k AS (SELECT DISTINCT u.doc_id, source, {sql_key('regexp_replace(unit, ' + chr(39) + chr(92) + 'd+' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS title FROM units u JOIN documents USING (doc_id) WHERE place = 0), n AS (SELECT source, count(DISTINCT doc_id) AS n FROM k GROUP BY 1) SELECT source, title, count(*)::BIGINT AS c FROM k JOIN n USING (source) WHERE title <> '' GROUP BY source, title, n HAVING count(*) >= greatest(3, 0.05 * n)")
def _(spark, d):
    docs = table(spark, d, "documents")
    heads = structure.units(docs, "doc_id", "text").where("place = 0").join(docs.select("doc_id", "source"), "doc_id")
    return structure.running_titles(heads, "source", "doc_id", "unit").select(F.col("source"), "title", "c")


@query("section_tree", """WITH h AS (SELECT l_orderkey AS doc, l_linenumber AS place, min(1 + l_partkey % 3)::INTEGER AS level FROM lineitem GROUP BY ALL)
SELECT doc, place, level, (SELECT max(p.place) FROM h p WHERE p.doc = h.doc AND p.place < h.place AND p.level < h.level) AS parent, (SELECT min(n.place) FROM h n WHERE n.doc = h.doc AND n.place > h.place AND n.level <= h.level) AS next_place FROM h""")
def _(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("place")).agg(F.min(1 + F.col("l_partkey") % 3).cast("int").alias("level"))
    return structure.sections(h, "doc", "place", "level")


@query("chunker")
def _(spark, d):
    return structure.chunk(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "place", "start", "end", T.token_estimate(F.col("fragment")).alias("n_tokens"))


@query("page_chunks")
def _(spark, d):
    """Documents as pages of five lines, cut by their headings and across page ends."""
    lines = structure.units(table(spark, d, "documents"), "doc_id", "text").withColumn("page", F.expr("place div 5").cast("int"))
    units = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "unit"))), lambda x: x["unit"]), "\n\n").alias("text"))
    return pages.chunk(units, "doc_id", "page", "text").drop("fragment")


@query("contents_anchors", f"""WITH l AS (SELECT doc_id, trim(unnest(list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) > 0))) AS line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) > 0), 1) - 1 AS place FROM documents), u AS (SELECT doc_id, {sql_key('line')} AS k FROM l GROUP BY ALL HAVING count(*) = 1)
SELECT l.doc_id, place::INTEGER AS no, (place // 5)::INTEGER AS unit, (place % 5)::INTEGER AS paragraph, true AS found FROM l JOIN u ON l.doc_id = u.doc_id AND {sql_key('line')} = k WHERE place % 5 = 3 AND length(line) BETWEEN 30 AND 110 AND regexp_matches(line, '^[a-zA-Z ]+[.]?$') AND NOT regexp_matches(line, '^[dDiIvVxXlLcC]+ ')""")
def _(spark, d):
    """Every fourth of five lines of a page, where it stands once in its document, as an entry of the contents."""
    lines = structure.units(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "place", F.trim("unit").alias("line"))
    lines = lines.withColumns({"page": F.expr("place div 5").cast("int"), "n": F.count(F.lit(1)).over(Window.partitionBy("doc_id", T.key(F.col("line"))))})
    paras = lines.select("doc_id", "page", (F.col("place") % 5).cast("int").alias("paragraph"), F.col("line").alias("text"))
    entries = lines.where((F.col("n") == 1) & (F.col("place") % 5 == 3) & F.length("line").between(30, 110) & F.col("line").rlike("^[a-zA-Z ]+[.]?$") & ~F.col("line").rlike("^[dDiIvVxXlLcC]+ "))
    found = pages.anchored_contents(entries.select("doc_id", "place", "line", "page"), paras, "doc_id", "place", "line", "page")
    return found.select("doc_id", "no", "unit", "paragraph", "found")


@query("passages")
def _(spark, d):
    return structure.passages(table(spark, d, "documents"), ["thing", "threat", "of", "other"], "doc_id", "text")


@query("quote_locate")
def _(spark, d):
    """Benchmark items in all documents where they can be located, short ones and broken words too."""
    return structure.locate_all(table(spark, d, "documents"), table(spark, d, "benchmark").withColumnRenamed("text", "quote"), "doc_id", "text", "item_id", "quote")


@query("greedy_batches", """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), r AS (SELECT source, doc_id, n_chars, i, 0 AS batch, n_chars AS held FROM o WHERE i = 1 UNION ALL SELECT o.source, o.doc_id, o.n_chars, o.i, CASE WHEN r.held + o.n_chars > 48000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.held + o.n_chars > 48000 THEN o.n_chars ELSE r.held + o.n_chars END FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1)
SELECT source, doc_id, n_chars, batch::INTEGER AS batch FROM r""")
def _(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return structure.pack(docs, "source", "doc_id", "n_chars", 48_000)


@query("contiguous_ranges", "WITH g AS (SELECT lang, doc_id, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS g FROM documents) SELECT lang, min(doc_id) AS first, max(doc_id) AS last, count(*)::BIGINT AS size FROM g GROUP BY lang, g")
def _(spark, d):
    from ..operators.intervals import islands

    return islands(table(spark, d, "documents"), ["lang"], "doc_id")


@query("paratext_filter", r"""WITH u AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) > 0) AS l, text FROM documents)
SELECT doc_id, ((len(l) > 0 AND len(list_filter(l, lambda s: regexp_matches(s, '[.…\s]{2,}\d+\s*$'))) * 2 > len(l)) OR (length(text) < 300 AND len(regexp_extract_all(text, '\p{L}+,? \d+[.;]')) >= 3)) AS paratext FROM u""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", filters.is_paratext(F.lit(""), F.col("text")).alias("paratext"))


# ---- transcripts -----------------------------------------------------------


@query("speaker_turns", """WITH m AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::INTEGER AS turn_no FROM m)
SELECT conv_id, turn_no, role, min(turn) AS first, max(turn) AS last, count(*)::BIGINT AS n, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM g GROUP BY conv_id, turn_no, role""")
def _(spark, d):
    t = transcripts.turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return t.select("conv_id", "turn_no", "role", "first", "last", "n", F.md5("text").alias("digest"))


@query("speaker_share", r"WITH s AS (SELECT conv_id, role, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')))::BIGINT AS n_words FROM conversations GROUP BY ALL) SELECT conv_id, role, n_words, round(CASE WHEN sum(n_words) OVER p > 0 THEN n_words / sum(n_words) OVER p ELSE 0 END, 6) AS share FROM s WINDOW p AS (PARTITION BY conv_id)")
def _(spark, d):
    return transcripts.shares(table(spark, d, "conversations"), "conv_id", "role", "text").withColumn("share", F.round("share", 6))


@query("turn_gaps", "SELECT user_id, event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 3) AS gap FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("user_id", "event_id", F.round((us - F.lag(us).over(w)) / 1e6, 3).alias("gap"))


@query("scene_changes", """WITH c AS (SELECT label, vec_id, 1 - list_sum(list_transform(list_zip(embedding, lag(embedding) OVER w), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS d FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id FROM (SELECT *, avg(d) OVER p AS m, stddev_pop(d) OVER p AS s FROM c WINDOW p AS (PARTITION BY label)) WHERE d > greatest(0.06, m + s)""")
def _(spark, d):
    from ..functions.vectors import dot

    w, p = Window.partitionBy("label").orderBy("vec_id"), Window.partitionBy("label")
    c = table(spark, d, "embeddings").withColumn("before", F.lag("embedding").over(w)).withColumn("d", F.when(F.col("before").isNotNull(), 1 - dot(F.col("embedding"), F.col("before"))))
    return c.withColumn("m", F.avg("d").over(p)).withColumn("s", F.stddev_pop("d").over(p)).where(F.col("d") > F.greatest(F.lit(0.06), F.col("m") + F.col("s"))).select("label", "vec_id")


# ---- citations -------------------------------------------------------------


@query("anchor_format", """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, ['page', 'time', 'slide', 'rows', 'section', 'image'][1 + (l_partkey % 6)] AS kind, l_partkey AS a, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey + l_suppkey % 3 END AS b FROM lineitem),
c AS (SELECT *, CASE WHEN a >= 3600 THEN printf('%d:%02d:%02d', a // 3600, a % 3600 // 60, a % 60) ELSE printf('%d:%02d', a // 60, a % 60) END AS ca, CASE WHEN b >= 3600 THEN printf('%d:%02d:%02d', b // 3600, b % 3600 // 60, b % 60) ELSE printf('%d:%02d', b // 60, b % 60) END AS cb FROM a)
SELECT l_orderkey, l_linenumber, l_partkey, CASE kind WHEN 'page' THEN CASE WHEN b IS NULL OR a = b THEN 'p. ' || a ELSE 'pp. ' || a || '–' || b END WHEN 'time' THEN CASE WHEN b > a THEN ca || '–' || cb ELSE ca END
 WHEN 'slide' THEN CASE WHEN b IS NULL OR a = b THEN 'slide ' || a ELSE 'slides ' || a || '–' || b END WHEN 'rows' THEN CASE WHEN b IS NULL OR a = b THEN 'row ' || a ELSE 'rows ' || a || '–' || b END WHEN 'section' THEN '§ ' || a ELSE '' END AS printed FROM c""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("page", "time", "slide", "rows", "section", "image"))), (1 + F.col("l_partkey") % 6).cast("int"))
    b = F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey") + F.col("l_suppkey") % 3)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", citations.anchor_text(kind, F.col("l_partkey"), b).alias("printed"))


@query("claims_temporal", """WITH c AS (SELECT o_orderkey, o_orderkey % 9 AS k, year(o_orderdate) AS y, CASE WHEN o_orderkey % 9 <> 8 THEN 1900 + o_custkey % 110 END AS s FROM orders)
SELECT o_orderkey, CASE WHEN s IS NULL THEN 'plausible' WHEN k = 1 AND y <= s + 5 THEN 'impossible' WHEN k = 2 AND y > s + 1 THEN 'impossible' WHEN k = 3 AND abs(y - s) <= 1 AND 1543 <= s + 5 THEN 'impossible' WHEN k = 6 THEN 'impossible'
 WHEN k IN (0, 1, 3) AND y - s > 20 THEN 'framework' WHEN k = 4 AND 2007 > s THEN 'framework' ELSE 'plausible' END AS verdict FROM c""")
def _(spark, d):
    y = F.year("o_orderdate").cast("string")
    said = [
        F.concat(F.lit("This idea applies to networks of "), y),
        F.concat(F.lit("The author anticipated the school of "), y),
        F.concat(F.lit("The author was based on the method of "), y),
        F.concat(F.lit("The method of "), y, F.lit(" anticipated Copernicus")),
        F.lit("Nobody had a smartphone then"),
        F.lit("Nothing dated"),
        F.lit("Surname anticipated Darwin"),
        F.lit("Copernicus anticipated Surname"),
        F.concat(F.lit("This idea applies to networks of "), y),
    ]
    claim = F.element_at(F.array(*said), (1 + F.col("o_orderkey") % 9).cast("int"))
    year = F.when(F.col("o_orderkey") % 9 != 8, (1900 + F.col("o_custkey") % 110).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", citations.plausibility(claim, year, F.array(F.lit("Surname"))).alias("verdict"))


@query("autocite_decisions", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 AS support, CASE WHEN l_returnflag = 'R' THEN 'context' ELSE 'direct' END AS kind, l_tax > 0.07 AS contra, CASE WHEN l_discount > 0.09 THEN 'impossible' ELSE 'plausible' END AS pl, l_linestatus = 'F' AS neg FROM lineitem),
s AS (SELECT *, least(support, CASE WHEN kind = 'context' THEN 0.6 ELSE 1 END, CASE WHEN neg THEN 0.4 ELSE 1 END) AS score FROM c) SELECT CASE WHEN pl = 'impossible' THEN 'discard' WHEN contra THEN 'review' WHEN score >= 0.7 THEN 'accept' WHEN score >= 0.4 THEN 'review' ELSE 'discard' END AS decision, kind, count(*)::BIGINT AS n, round(sum(score), 4) AS score FROM s GROUP BY ALL""")
def _(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("support"), F.when(F.col("l_returnflag") == "R", "context").otherwise("direct").alias("kind"), (F.col("l_tax") > 0.07).alias("contra"), F.when(F.col("l_discount") > 0.09, "impossible").otherwise("plausible").alias("pl"), (F.col("l_linestatus") == "F").alias("neg"))
    return citations.decide(li, "support", "kind", "contra", "pl", "neg").groupBy("decision", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("answer_confidence", "WITH a AS (SELECT user_id, count(*) AS n, max(value) / 100 AS best FROM events GROUP BY 1) SELECT user_id, CASE WHEN n >= 3 AND best >= 0.5 THEN 'high' WHEN n >= 1 AND best >= 0.2 THEN 'medium' ELSE 'low' END AS confidence FROM a")
def _(spark, d):
    a = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.max("value") / 100).alias("best"))
    return a.select("user_id", citations.answer_confidence(F.col("n"), F.col("best")).alias("confidence"))


@query("orphan_citations", "WITH m AS (SELECT o_orderkey, unnest(['1', '2', '9'])::INTEGER AS mark FROM orders), k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT o_orderkey, mark, k.l_linenumber IS NOT NULL AS known FROM m LEFT JOIN k ON l_orderkey = o_orderkey AND l_linenumber = mark")
def _(spark, d):
    answers = table(spark, d, "orders").select("o_orderkey", F.lit("As said [1], and [2][9] and again [1].").alias("answer"))
    proofs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return citations.resolve_marks(answers, proofs, "o_orderkey", "answer", "l_linenumber")


@query("clock_to_seconds", "SELECT event_id, (epoch_us(ts) // 1000000 % 86400)::DOUBLE AS seconds FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.clock_seconds(F.date_format("ts", "H:mm:ss")).alias("seconds"))


@query("roman_numerals", "SELECT p_partkey, CASE WHEN p_partkey BETWEEN 1 AND 3999 THEN p_partkey END::INTEGER AS n FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.roman(T.to_roman(F.col("p_partkey"))).alias("n"))


@query("isbn_check", """WITH c AS (SELECT p_partkey, '978' || lpad((p_partkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS core FROM part), s AS (SELECT *, (SELECT sum(substr(core, i, 1)::INTEGER * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) FROM range(1, 13) r(i)) AS t FROM c)
SELECT p_partkey, core || ((10 - t % 10) % 10)::INTEGER::VARCHAR AS isbn13, true AS valid, core || ((11 - t % 10) % 10)::INTEGER::VARCHAR = core || ((10 - t % 10) % 10)::INTEGER::VARCHAR AS other_valid FROM s""")
def _(spark, d):
    core = F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")
    full = T.to_isbn13(F.concat(core, F.lit("X")))
    other = F.concat(F.substring(full, 1, 12), ((F.substring(full, 13, 1).cast("int") + 1) % 10).cast("string"))
    return table(spark, d, "part").select("p_partkey", full.alias("isbn13"), T.isbn_valid(full).alias("valid"), T.isbn_valid(other).alias("other_valid"))


@query("contexts_per_doc", f"""WITH t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term, generate_subscripts({sql_tokens('text')}, 1) AS pos FROM documents), m AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM t WHERE term = 'that') SELECT doc_id, pos::INTEGER AS pos FROM m WHERE k <= 4""")
def _(spark, d):
    toks = table(spark, d, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("p", "term")).where("term = 'that'").select("doc_id", (F.col("p") + 1).alias("pos"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return toks.withColumn("k", F.row_number().over(w)).where("k <= 4").select("doc_id", "pos")


@query("printed_page_asof", "WITH f AS (SELECT l_suppkey, l_quantity::INTEGER AS page, max(l_orderkey) AS unit FROM lineitem WHERE l_quantity::INTEGER % 5 = 0 GROUP BY ALL), p AS (SELECT s_suppkey AS l_suppkey, i AS page FROM supplier, range(1, 60, 3) r(i)) SELECT p.l_suppkey, p.page::INTEGER AS page, f.unit FROM p ASOF LEFT JOIN f ON p.l_suppkey = f.l_suppkey AND p.page >= f.page")
def _(spark, d):
    from ..operators.intervals import as_of

    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").alias("page"), F.col("l_orderkey").alias("unit"))
    facts = li.where("page % 5 = 0").groupBy("l_suppkey", "page").agg(F.max("unit").alias("unit"))
    points = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.sequence(F.lit(1), F.lit(58), F.lit(3))).alias("page"))
    return as_of(points, facts, ["l_suppkey"], "page", "page", ["unit"])


# ---- graphs ----------------------------------------------------------------


SQL_EDGES = "p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT a.l_partkey AS a, b.l_partkey AS b, 1.0 AS weight, a.l_orderkey FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"


def edges(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", F.lit(0).alias("part"), "l_partkey")
    return graph.cooccurrence(li, "l_orderkey", "part", "l_partkey")


@query("cooccurrence_edges", f"WITH {SQL_EDGES} SELECT a, b, count(*)::BIGINT AS n, round(sum(weight), 3)::DOUBLE AS weight FROM e GROUP BY a, b HAVING count(*) > 1")
def _(spark, d):
    return edges(spark, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("weight")).where("n > 1")


@query("neighbors_topk", f"WITH {SQL_EDGES}, b AS (SELECT a AS node, b AS other, weight, l_orderkey FROM e UNION ALL SELECT b, a, weight, l_orderkey FROM e), t AS (SELECT node, other, sum(weight)::DOUBLE AS weight, count(DISTINCT l_orderkey)::BIGINT AS n_docs FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other)::INTEGER AS rank FROM t) SELECT * FROM r WHERE rank <= 3")
def _(spark, d):
    return graph.neighbours(edges(spark, d), 3, doc="l_orderkey")


@query("shared_entities", "WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), s AS (SELECT b.l_suppkey, count(*)::BIGINT AS n_shared FROM p a JOIN p b USING (l_partkey) WHERE a.l_suppkey = 1 AND b.l_suppkey <> 1 GROUP BY 1) SELECT * FROM s ORDER BY n_shared DESC, l_suppkey LIMIT 8")
def _(spark, d):
    return graph.shared_entities(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", 1).select("l_suppkey", "n_shared")


@query("connected_components")
def _(spark, d):
    # Recursive SQL is too slow on whole tables; tests hold the operator against union-find.
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (1_000_000_000 + F.floor(F.col("o_totalprice"))).cast("long").alias("b"))
    return graph.components(o)


@query("entity_path", f"""WITH RECURSIVE {SQL_EDGES}, b AS (SELECT a AS node, b AS other, weight FROM e UNION ALL SELECT b, a, weight FROM e), t AS (SELECT node, other, sum(weight) AS weight FROM b GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS k FROM t), near AS (SELECT node, other, least(weight, 5) AS w FROM n WHERE k <= 40),
h1 AS (SELECT other AS node_at, w AS s, '1>' || other AS path FROM near WHERE node = 1), h2 AS (SELECT near.other AS node_at, s + w AS s, path || '>' || near.other AS path FROM h1 JOIN near ON h1.node_at = near.node), f AS (SELECT 1 AS hops, path, s FROM h1 WHERE node_at = 777 UNION ALL SELECT 2, path, s FROM h2 WHERE node_at = 777 AND node_at <> 1 AND node_at NOT IN (SELECT node_at FROM h1))
SELECT hops::INTEGER AS hops, round(s, 3)::DOUBLE AS strength FROM f ORDER BY hops, s DESC, path LIMIT 1""")
def _(spark, d):
    near = graph.neighbours(edges(spark, d), 1000)
    return graph.path(near, 1, 777, hops=2).select("hops", F.round("strength", 3).alias("strength"))


@query("entity_resolution", f"WITH k AS (SELECT p_partkey, {sql_key('p_name')} AS k, p_brand, p_size % 2 = 0 AS fic, p_retailprice FROM part) SELECT p_partkey, CASE WHEN k = '' THEN p_partkey ELSE first_value(p_partkey) OVER (PARTITION BY p_brand, fic, k ORDER BY p_retailprice DESC, p_partkey) END AS winner FROM k")
def _(spark, d):
    p = table(spark, d, "part").withColumn("fic", F.col("p_size") % 2 == 0).withColumn("linked", F.lit(False))
    return graph.resolve(p, "p_partkey", "p_name", "p_brand", "fic", "linked", "p_retailprice")


ENTITY = "'n' || c_custkey // 6 || CASE WHEN c_custkey % 6 < 2 THEN ' ' || chr((97 + c_custkey % 6)::INTEGER) || ' z' || c_custkey // 6 WHEN c_custkey % 6 = 2 THEN '' ELSE ' y' || c_custkey % 6 END"


@query("entity_merges", f"""WITH RECURSIVE e AS (SELECT c_custkey AS k, {ENTITY} AS name, c_nationkey AS doc, CASE WHEN c_custkey % 6 IN (2, 3) THEN c_custkey // 6 END AS q, 'n' || c_custkey // 6 AS alias, c_custkey % 6 AS r, c_acctbal AS m FROM customer),
l AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.q = b.q AND a.k <> b.k UNION SELECT a.k, b.k FROM e a JOIN e b ON a.r = 0 AND b.name = a.alias AND a.k <> b.k AND a.doc = b.doc),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach(k, o) AS (SELECT k, k FROM e UNION SELECT r.k, u.b FROM reach r JOIN u ON u.a = r.o)
SELECT k AS c_custkey, first(o ORDER BY q IS NULL, len(string_split(name, ' ')) DESC, m DESC, o) AS winner FROM (SELECT reach.k, o, e.q, e.name, e.m FROM reach JOIN e ON e.k = o) GROUP BY k""")
def _(spark, d):
    """Customers as entities: links by catalogue number, and by a form of one word within one nation."""
    six = F.expr("c_custkey div 6").cast("string")
    r = F.col("c_custkey") % 6
    name = F.concat(F.lit("n"), six, F.when(r < 2, F.concat(F.lit(" "), F.when(r == 0, "a").otherwise("b"), F.lit(" z"), six)).when(r == 2, "").otherwise(F.concat(F.lit(" y"), r.cast("string"))))
    e = table(spark, d, "customer").select("c_custkey", "c_nationkey", name.alias("name"), F.lit("work").alias("kind"), F.when(r.isin(2, 3), six).alias("q"), F.when(r == 0, F.array(F.concat(F.lit("n"), six))).otherwise(F.array().cast("array<string>")).alias("alias"), F.col("c_acctbal").alias("m"), F.lit(None).cast("boolean").alias("fic"))
    return graph.merged(e, e.select("c_custkey", F.col("c_nationkey").alias("doc")), "c_custkey", "doc", "name", "kind", "alias", "q", "m", "fic")


@query("mention_places", f"""WITH f AS (SELECT array_to_string({sql_tokens('text')}[1:2 + item_id % 5], ' ') AS form, CASE WHEN min(item_id) = max(item_id) THEN min(item_id) END AS item_id FROM benchmark GROUP BY 1), t AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS start, t FROM t), r AS MATERIALIZED (SELECT doc_id, start, k, array_to_string(t[start : start + k - 1], ' ') AS form FROM p, (SELECT unnest(range(2, 7)) AS k) WHERE start + k - 1 <= len(t)),
hits AS (SELECT doc_id, start, k AS n, item_id FROM r JOIN f USING (form)),
taken AS (SELECT doc_id, list_reduce(list([{{'s': start, 'n': n, 'o': item_id}}] ORDER BY n DESC, start), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].s + x[1].n AND x[1].s < y.s + y.n)) > 0 THEN a ELSE a || x END) AS m FROM hits GROUP BY doc_id)
SELECT doc_id, m.o AS item_id, m.s::INTEGER AS start, m.n::INTEGER AS n_words FROM (SELECT doc_id, unnest(m) AS m FROM taken) WHERE m.o IS NOT NULL""")
def _(spark, d):
    """Forms of two to six words, the first of the benchmark texts."""
    forms = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(T.tokens(F.col("text")), F.lit(1), (2 + F.col("item_id") % 5).cast("int")), " ").alias("form"))
    return graph.mentions(table(spark, d, "documents"), forms, "doc_id", "text", "item_id", "form")


@query("redirect_chains", "WITH RECURSIVE l AS (SELECT c_custkey AS s, c_custkey // 2 AS t FROM customer WHERE c_custkey > 1), r(s, t, n) AS (SELECT s, t, 1 FROM l UNION ALL SELECT r.s, l.t, n + 1 FROM r JOIN l ON r.t = l.s WHERE n < 16) SELECT s AS c_custkey, min(t) AS final FROM r GROUP BY s")
def _(spark, d):
    c = table(spark, d, "customer").where("c_custkey > 1").select("c_custkey", F.expr("c_custkey div 2").alias("to_key"))
    return graph.redirects(c, "c_custkey", "to_key", 16)


@query("graph_degree", "SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT o_custkey AS node, 1 AS o, 0 AS i FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT o_orderkey, 0, 1 FROM orders WHERE o_totalprice > 100000) GROUP BY node")
def _(spark, d):
    return graph.degree(table(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_totalprice") > 100000)


# ---- references ------------------------------------------------------------


@query("reference_resolution", """WITH s AS (SELECT doc_id, '10.1000/d' || doc_id AS doi FROM documents), r AS (SELECT o_orderkey AS ref_id, '10.1000/d' || (o_orderkey % 2000) AS doi FROM orders) SELECT ref_id, doc_id, 1.0::DOUBLE AS confidence, 'doi' AS rule FROM r JOIN s USING (doi)""")
def _(spark, d):
    title = F.lit(None).cast("string")
    shelf = table(spark, d, "documents").select("doc_id", F.concat(F.lit("10.1000/d"), "doc_id").alias("doi"), title.alias("title"), F.lit(None).cast("int").alias("year"), title.alias("surname"))
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref_id"), F.concat(F.lit("Surname, N. See https://doi.org/10.1000/D"), F.col("o_orderkey") % 2000, F.lit(".")).alias("entry"))
    return bibliography.resolve(bibliography.parse(refs, "entry"), shelf).select("ref_id", "doc_id", "confidence", "rule")


@query("reference_titles")
def _(spark, d):
    """Entries without identifiers against a shelf of titles, years and surnames; every third has a word too many, every third the wrong year."""
    n = F.col("doc_id")
    # Titles and entries are read several times, the texts once.
    words = T.computed(table(spark, d, "documents"), ["doc_id"], _t=T.tokens(F.col("text")))
    docs = graph._saved(words.select("doc_id", F.array_join(F.slice("_t", 1, 9), " ").alias("title"), (1900 + n % 100).cast("int").alias("year"), F.try_element_at("_t", F.lit(-1)).alias("surname")), "titles")
    entry = F.concat(F.initcap("surname"), F.lit(", N. ("), F.col("year") + F.when(n % 3 == 1, 5).otherwise(0), F.lit("). "), "title", F.when(n % 3 == 2, F.lit(" revised")).otherwise(""), F.lit(". Place."))
    refs = graph._saved(bibliography.parse(docs.where("doc_id is not null").select(n.alias("ref_id"), entry.alias("entry")), "entry"), "entries")
    return bibliography.resolve(refs, docs.withColumn("doi", F.lit(None).cast("string"))).select("ref_id", "doc_id", "confidence", "rule")


@query("orphan_refs", "SELECT '10.1000/d' || (o_orderkey % 500) AS work, count(DISTINCT o_custkey)::BIGINT AS n_docs, count(*)::BIGINT AS n_times FROM orders WHERE o_orderkey % 500 % 3 <> 0 GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 2")
def _(spark, d):
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref_id"), "o_custkey", F.concat(F.lit("x 10.1000/d"), F.col("o_orderkey") % 500).alias("entry"))
    parsed = bibliography.parse(refs, "entry")
    return bibliography.orphans(parsed, refs.where("ref_id % 500 % 3 = 0").select("ref_id"), "ref_id", "o_custkey", "entry").select("work", "n_docs", "n_times")


@query("bibtex_keys", f"WITH w AS (SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || p_size || {sql_fold('split_part(p_name, ' + chr(39) + ' ' + chr(39) + ', 1)')} AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY base) AS c FROM w) SELECT p_partkey, CASE WHEN c > 1 THEN base || CASE WHEN k <= 26 THEN chr((96 + k)::INTEGER) ELSE 'z' || k END ELSE base END AS cite_key FROM n")
def _(spark, d):
    return bibliography.citation_keys(table(spark, d, "part"), "p_brand", "p_size", "p_name", "p_partkey").select("p_partkey", "cite_key")


# ---- maps, insights, quality ------------------------------------------------


@query("cluster_summary", """WITH c AS (SELECT label, i, round(avg(x::DOUBLE), 9) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), d AS (SELECT e.label, e.vec_id, round(sqrt(sum((e.x::DOUBLE - c.m) * (e.x::DOUBLE - c.m))), 6) AS d FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e JOIN c USING (label, i) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k FROM d)
SELECT label, count(*)::BIGINT AS size, round(avg(d), 4) AS mean_distance, string_agg(vec_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 8) AS near FROM r GROUP BY label""")
def _(spark, d):
    return clusters.summary(table(spark, d, "embeddings"), "vec_id", "label", "embedding")


@query("pca_kmeans_map")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return clusters.cluster(clusters.reduce(e, 8), clusters.n_clusters(e.count())).select("vec_id", "cluster")


@query("map_placement")
def _(spark, d):
    e = clusters.reduce(table(spark, d, "embeddings"), 2)
    xy = e.select("vec_id", "label", "embedding", F.col("reduced")[0].alias("x"), F.col("reduced")[1].alias("y"))
    w = Window.partitionBy("label").orderBy("vec_id")
    sample = xy.withColumn("n", F.row_number().over(w)).where("n <= 40")
    return clusters.place(xy.join(sample.select("vec_id"), "vec_id", "left_anti").select("vec_id", "label", "embedding"), sample, "label", "vec_id", "embedding")


@query("umap_layout")
def _(spark, d):
    """All vectors on a map: the fuzzy neighbour graph laid out by attraction and repulsion."""
    return clusters.umap(table(spark, d, "embeddings"), "vec_id", "embedding", 15, 5, 30)


@query("fuzzy_neighbours", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT a.vec_id AS key, b.vec_id AS other, round(sqrt(greatest(0, 2 - 2 * list_cosine_similarity(a.v, b.v))), 9) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT key, other, row_number() OVER (PARTITION BY key ORDER BY d, other) AS r FROM n) SELECT key, other, r::INTEGER AS rank FROM r WHERE r <= 5""")
def _(spark, d):
    """The neighbour graph behind the map, five neighbours a point."""
    g = clusters.neighbour_graph(table(spark, d, "embeddings"), "vec_id", "embedding", 5)
    return g.select("key", "other", F.row_number().over(Window.partitionBy("key").orderBy(F.round("distance", 9), "other")).alias("rank"))


@query("document_map", "WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, greatest(1, ceil(count(*) OVER (PARTITION BY label) / 40))::INTEGER AS s FROM embeddings) SELECT label, vec_id, true AS inside FROM r WHERE r % s = 0")
def _(spark, d):
    """Each label's vectors on their own two axes, 40 of them at most."""
    m = clusters.document_map(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 40)
    return m.select("label", "vec_id", ((F.abs("x") <= 1) & (F.abs("y") <= 1) & (F.col("share_x") >= F.col("share_y"))).alias("inside"))


@query("forgotten_documents", "WITH o AS (SELECT user_id AS doc_id, max(ts) AS last_open FROM events WHERE event_type = 'view' GROUP BY 1), h AS (SELECT user_id AS doc_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) SELECT doc_id, last_open, (CASE WHEN last_open IS NULL THEN 1 ELSE 2 END + coalesce(n, 0))::BIGINT AS weight FROM documents LEFT JOIN o USING (doc_id) LEFT JOIN h USING (doc_id) WHERE last_open IS NULL OR last_open < TIMESTAMP '2024-01-25'")
def _(spark, d):
    import datetime

    e = table(spark, d, "events").withColumnRenamed("user_id", "doc_id")
    return insights.forgotten(table(spark, d, "documents"), e.where("event_type = 'view'"), e.where("event_type = 'click'"), "doc_id", "ts", datetime.datetime(2024, 1, 25))


@query("search_gaps", "SELECT user_id, count(*)::BIGINT AS n, round(avg(value), 4) AS mean_results FROM events WHERE event_type = 'error' OR value < 10 GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("conf", F.when(F.col("value") < 10, "low").otherwise("high")).withColumn("state", F.when(F.col("event_type") == "error", "error").otherwise("done"))
    return insights.gaps(e, "user_id", "value", "state", "conf").withColumn("mean_results", F.round("mean_results", 4))


@query("topic_periods", "SELECT date_trunc('week', ts)::TIMESTAMP AS period, event_type, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY date_trunc('week', ts)), 6) AS share FROM events GROUP BY date_trunc('week', ts), event_type")
def _(spark, d):
    return insights.periods(table(spark, d, "events"), "ts", "event_type", "week").withColumn("share", F.round("share", 6)).withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("watcher_changes", "WITH b AS (SELECT user_id, event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15'), n AS (SELECT user_id, event_id, event_type FROM events), x AS (SELECT user_id, count(*) FILTER (event_id NOT IN (SELECT event_id FROM b))::BIGINT AS n_new, max(event_type) AS m FROM n GROUP BY 1), y AS (SELECT user_id, max(event_type) AS m FROM b GROUP BY 1) SELECT user_id, n_new, x.m <> y.m AS answer_changed FROM x JOIN y USING (user_id) WHERE n_new > 0 OR x.m <> y.m")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return insights.changes(e.where("ts < timestamp_ntz'2024-01-15'"), e, "user_id", "event_id", "event_type")


@query("card_verification", "SELECT doc_id, CASE WHEN lang = 'es' THEN 'orphan' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'verified' END AS state FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    cards = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.sha2("text", 256)).alias("print"))
    return insights.verify_cards(cards, docs.where("lang <> 'es'").select("doc_id", "text"), "doc_id", "print", "text").select("doc_id", "state")


@query("batch_estimate", "WITH f AS (SELECT doc_id, md5(text) AS print, CASE WHEN doc_id % 4 = 0 THEN 'media' ELSE 'text' END AS kind, n_chars * 100 AS size FROM documents), m AS (SELECT *, row_number() OVER (PARTITION BY print ORDER BY doc_id) = 1 AND print NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0') AS fresh FROM f) SELECT kind, count(*)::BIGINT AS n, count(*) FILTER (fresh)::BIGINT AS n_new, round(sum(CASE WHEN fresh THEN 12 + CASE WHEN kind <> 'media' THEN 0.8 * greatest(1, size / 50000) ELSE 11 * size / 1000000 END ELSE 0 END), 3)::DOUBLE AS work FROM m GROUP BY kind")
def _(spark, d):
    docs = table(spark, d, "documents")
    f = docs.select("doc_id", F.md5("text").alias("print"), F.when(F.col("doc_id") % 4 == 0, "media").otherwise("text").alias("kind"), (F.col("n_chars") * 100).alias("size"))
    return insights.batch_estimate(f, docs.where("source = 'src0'").select(F.md5("text").alias("print")), "print", "doc_id", "kind", "size").withColumn("work", F.round("work", 3))


@query("citation_metrics", "WITH c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 2), g AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3) SELECT round((SELECT count(*) FROM c JOIN g USING (l_orderkey, l_partkey)) / (SELECT count(*) FROM c), 6) AS precision, round((SELECT count(*) FROM c JOIN g USING (l_orderkey, l_partkey)) / (SELECT count(*) FROM g), 6) AS recall, (SELECT count(*) FROM c WHERE l_partkey NOT IN (SELECT l_partkey FROM g))::BIGINT AS invented")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    cited = li.where("l_linenumber <= 2").select("l_orderkey", "l_partkey").distinct()
    gold = li.where("l_linenumber between 2 and 3").select("l_orderkey", "l_partkey").distinct()
    m = metrics.citation_scores(li.select("l_orderkey").distinct(), cited, gold, "l_orderkey", "l_partkey")
    return m.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "invented")


@query("bag_of_words_f1", f"""WITH b AS (SELECT conv_id, role, unnest({sql_tokens('text')}) AS t FROM conversations), x AS (SELECT conv_id, t, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM b GROUP BY ALL) SELECT conv_id, round(CASE WHEN sum(u) + sum(a) > 0 THEN 2 * sum(least(u, a)) / (sum(u) + sum(a)) ELSE 0 END, 6)::DOUBLE AS f1 FROM x WHERE u + a > 0 GROUP BY conv_id""")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role", T.tokens(F.col("text")).alias("t"))
    return metrics.bag_f1(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", "t").withColumn("f1", F.round("f1", 6))


@query("judgment_pool", "SELECT DISTINCT label AS query, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r1, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r2 FROM embeddings) WHERE r1 <= 5 OR r2 <= 5")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("query"), "vec_id")
    up = e.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("vec_id")))
    down = e.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("vec_id"))))
    return metrics.pool(up.unionByName(down), "vec_id", 5)


PLANTED = [("cua", "qua"), ("f", "ph"), ("([aeiou])s([aeiou])", "\\1ss\\2"), ("^u([^aeiou])", "v\\1"), ("([aeiou])b([aeiou])", "\\1u\\2")]


def _planted_sql(word: str) -> str:
    for a, b in PLANTED:
        word = f"regexp_replace({word}, '{a}', '{b}', 'g')"
    return word


@query("old_spelling_recall", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS word FROM documents WHERE lang = 'es'), p AS (SELECT word, {_planted_sql('word')} AS old FROM w WHERE regexp_full_match(word, '[a-z]{{4,}}') AND NOT regexp_matches(word, 'ph|ss|[hxyv]|f[smpcqt]')) SELECT word, old, true AS found FROM p WHERE old <> word""")
def _(spark, d):
    """Whether modern words find the old spellings of them: quatro, philosophia, cassa, vn, cauallo, by keys of the word and of its variants."""
    docs = table(spark, d, "documents").where("lang = 'es'")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).distinct().where(F.col("word").rlike("^[a-z]{4,}$") & ~F.col("word").rlike("ph|ss|[hxyv]|f[smpcqt]"))
    old = F.col("word")
    for a, b in PLANTED:
        old = F.regexp_replace(old, a, b.replace("\\", "$"))
    pairs = words.withColumn("old", old).where("old <> word").withColumn("lang", F.lit("es"))
    keyed = normalizer.keyed(normalizer.keyed(pairs, word="old").withColumnRenamed("spelling_key", "old_key"), word="word")
    return keyed.select("word", "old", (F.col("old_key") == F.col("spelling_key")).alias("found"))


@query("historical_key")
def _(spark, d):
    return normalizer.keyed(normalizer.vocabulary(table(spark, d, "documents"), "text", "lang"))


def _signals_sql(lang: str) -> str:
    words = f"len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+'), lambda w: regexp_matches(w, '{normalizer.old_word_pattern(lang)}')))"
    return f"len(regexp_extract_all(lower(text), '{normalizer.OLD_SIGNS[lang]}')) + {words}"


@query("old_spelling", f"""WITH c AS (SELECT doc_id, lang, len({sql_tokens('text')}) AS w, CASE lang WHEN 'es' THEN {_signals_sql('es')} WHEN 'fr' THEN {_signals_sql('fr')} WHEN 'it' THEN {_signals_sql('it')} ELSE 0 END AS n FROM documents)
SELECT doc_id, coalesce(lang = 'la' OR (lang IN ('es', 'fr', 'it') AND ((n >= 2 AND n >= w * 0.01) OR (w < 40 AND n >= 1 AND n * 20 >= w))), false) AS old FROM c""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(normalizer.is_old(F.col("text"), F.col("lang"), F.lit(None).cast("int")), F.lit(False)).alias("old"))


@query("gale_church")
def _(spark, d):
    """Paragraph lengths of every document aligned with those of the document whose key follows."""
    docs = table(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), F.length).alias("n"))
    both = docs.select(F.col("doc_id").alias("pair"), F.col("n").alias("a")).join(docs.select((F.col("doc_id") - 1).alias("pair"), F.col("n").alias("b")), "pair", "full")
    return align.align_arrays(both, "pair", "a", "b")


@query("folio_sequence")
def _(spark, d):
    """Pages of the events of each user, numbered in the footer but for some that are missing or misread."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    p = table(spark, d, "events").withColumn("page", F.row_number().over(w))
    footer = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.lit("88")).otherwise((F.col("page") + 3).cast("string"))
    return folios.deduce(p.select("user_id", "page", F.lit(None).cast("string").alias("h"), footer.alias("f"), F.lit(None).cast("string").alias("b")), "user_id", "page", "h", "f", "b")


@query("html_links", r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)))::INTEGER AS n_links, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages""")
def _(spark, d):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, d, "pages").select("page_id", F.size(links).alias("n_links"), F.regexp_extract("url", r"^https?://([^/:]+)", 1).alias("host"))


@query("html_to_text", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def _(spark, d):
    from ..sources.documents import plain_html

    return table(spark, d, "pages").select("page_id", F.md5(plain_html(F.col("html"))).alias("digest"))


@query("table_fingerprint", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders")
    prints = tables.fingerprint(o, ["o_custkey"], o.columns)
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).join(prints, "o_custkey").where(F.length("print") == 64).select("o_custkey", "n")


@query("knn_filtered_labels", "SELECT label, count(*)::BIGINT AS n FROM embeddings WHERE label <> 2 AND label >= 1 AND label < 8 GROUP BY 1")
def _(spark, d):
    return table(spark, d, "embeddings").where(filters.compile_filter({"label": {"$nin": [2], "$gte": 1, "$lt": 8}})).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("cells_mean_similarity", """WITH x AS (SELECT label, i, round(avg(v::DOUBLE), 9) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM x GROUP BY 1), s AS (SELECT e.vec_id, c.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.c), 6) AS s FROM embeddings e, c), b AS (SELECT vec_id, arg_min(label, (-s, label)) AS cell, max(s) AS s FROM s GROUP BY 1)
SELECT cell, count(*)::BIGINT AS n, round(avg(s) + 1e-9, 4) AS mean_score FROM b GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    c = dense.centroids(e, "label").withColumnRenamed("label", "cell")
    return dense.assign(e, c).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score") + 1e-9, 4).alias("mean_score"))
