"""Queries: decisions while documents are read, over tables that stand in for pages, names and spans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..operators import structure
from .registry import query, sql_key, table

B = Window.partitionBy


@query("repetition_loops", r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: length(s) > 3) AS l FROM documents),
c AS (SELECT doc_id, len(l) AS n, (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(l) AS x) GROUP BY x)) AS top FROM l) SELECT doc_id, coalesce(n >= 8 AND top >= 6 AND top > 0.4 * n, false) AS by_line FROM c""")
def _(spark, d):
    # The back-reference part of the detector has no counterpart in the SQL; repetition_loops_whole has both.
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda s: F.length(s) > 3)
    top = F.array_max(F.transform(F.array_distinct(lines), lambda s: F.size(F.filter(lines, lambda t: t == s))))
    return table(spark, d, "documents").select("doc_id", F.coalesce((F.size(lines) >= 8) & (top >= 6) & (top > 0.4 * F.size(lines)), F.lit(False)).alias("by_line"))


@query("repetition_loops_whole")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(I.loops(F.col("text")), F.lit(False)).alias("stuck"))


@query("page_acceptance")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", I.page_accepted(F.col("text"), (F.col("doc_id") % 10) / 10.0, F.lit(0)).alias("accepted"))


@query("folio_labels", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 AND p_partkey BETWEEN 1 AND 3999 THEN p_partkey END::INTEGER AS value FROM part")
def _(spark, d):
    label = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("— "), F.col("p_size"), F.lit(" —"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("["), F.lower(T.to_roman(F.col("p_partkey"))), F.lit("]"))).otherwise("plate")
    return table(spark, d, "part").select("p_partkey", I.folio_value(label).alias("value"))


@query("label_agreement", "SELECT l_suppkey, round(coalesce(avg((l_quantity::INTEGER = l_linenumber OR l_quantity::INTEGER = l_partkey % 50)::INTEGER) FILTER (l_quantity::INTEGER > 0), 0), 6) AS agreement, bool_or(l_quantity::INTEGER <> l_linenumber) AS informative FROM lineitem GROUP BY 1")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("label"), F.array(F.col("l_linenumber"), (F.col("l_partkey") % 50).cast("int")).alias("numbers"))
    return I.label_agreement(li, "l_suppkey", "l_linenumber", "label", "numbers").withColumn("agreement", F.round("agreement", 6))


@query("dominant_body_size", "WITH n AS (SELECT l_suppkey, round(l_quantity * 0.3 * 2) / 2 AS s, sum(length(l_returnflag)) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, arg_min(s, (-n, s)) AS body_size FROM n GROUP BY 1")
def _(spark, d):
    return I.dominant_size(table(spark, d, "lineitem").withColumn("size", F.col("l_quantity") * 0.3), "l_suppkey", "size", "l_returnflag")


@query("visible_folio", "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey AS v, CASE WHEN l_tax > 0.04 OR l_discount > 0.05 THEN 1.0 ELSE 0 END + CASE WHEN l_partkey > 0 AND l_partkey < 3000 THEN 1 ELSE 0 END - CASE WHEN l_partkey BETWEEN 1400 AND 2100 THEN 1.5 ELSE 0 END AS p FROM lineitem) SELECT l_orderkey, l_linenumber, arg_max(v, (p, -v)) AS l_partkey FROM p GROUP BY ALL")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("outer_side", F.col("l_tax") > 0.04).withColumn("in_footer", F.col("l_discount") > 0.05)
    return I.visible_folio(li, "l_orderkey", "l_linenumber", "l_partkey", "outer_side", "in_footer")


@query("ornament_prefixes", f"""WITH u AS (SELECT source, trim(l) AS l FROM (SELECT source, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l)) > 0),
t AS (SELECT source, split_part(l, ' ', 1) AS f FROM u), n AS (SELECT source, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 10),
o AS (SELECT source, f AS ornament, count(*) AS c FROM t WHERE length(f) <= 3 AND NOT regexp_matches(f, '^[\\d—–-]') AND translate(lower(f), '{T.ACCENTED}', '{T.PLAIN}') NOT IN ({', '.join(f"'{w}'" for w in (*T.STOPWORDS, 'a', 'an', 'i', 'o', 'y', 'e'))}) GROUP BY ALL)
SELECT source, ornament FROM o JOIN n USING (source) WHERE c >= 0.01 * n""")
def _(spark, d):
    docs = table(spark, d, "documents")
    paras = structure.units(docs.select("doc_id", "source", "text"), "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")
    return I.ornaments(paras, "source", "unit", share=0.01)


@query("observation_times", """WITH o AS (SELECT l_orderkey AS c, l_linenumber AS i, l_quantity * 2 AS t, (l_orderkey % 3 * 200)::DOUBLE AS s, 120.0::DOUBLE AS dur FROM lineitem), r AS (SELECT *, s > 5 AND bool_and(t <= dur + 3) OVER w AND bool_or(t < s - 3) OVER w AS rel FROM o WINDOW w AS (PARTITION BY c)),
m AS (SELECT *, CASE WHEN rel THEN t + s ELSE t END AS u FROM r) SELECT c, i, round(least(greatest(u, s), s + dur), 1) AS t FROM m WHERE u BETWEEN s - 2 AND s + dur + 2""")
def _(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("i"), (F.col("l_quantity") * 2).alias("t"), (F.col("l_orderkey") % 3 * 200).cast("double").alias("s"), F.lit(120.0).alias("dur"))
    return I.align_times(o, "c", "t", "s", "dur").select("c", "i", "t")


@query("boxes", """WITH b AS (SELECT l_orderkey, l_linenumber, [l_quantity * 10, l_partkey % 900, l_quantity * 10 + l_suppkey % 40, l_partkey % 900 + 100] AS b FROM lineitem), v AS (SELECT l_orderkey, l_linenumber, list_transform(b, lambda x: least(greatest(x / 1000, 0), 1)) AS v FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN v[4] - v[2] >= 0.01 AND v[3] - v[1] >= 0.01 THEN round(v[4] - v[2], 6) END AS w FROM v""")
def _(spark, d):
    q, p = F.col("l_quantity") * 10, (F.col("l_partkey") % 900).cast("double")
    b = F.array(q, p, q + (F.col("l_suppkey") % 40), p + 100)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(I.box(b)["w"], 6).alias("w"))


@query("check_spans", "WITH s AS (SELECT event_id, value AS t0, value + 7 AS t1, value + 3 AS inst FROM events), l AS (SELECT *, greatest(0, least(t0, inst) - 2) AS lo FROM s) SELECT event_id, round(lo, 4) AS lo, round(least(lo + 45, greatest(t1 + 2, lo + 10)), 4) AS hi FROM l")
def _(spark, d):
    v = F.col("value")
    lo, hi = I.check_span(v, v + 7, v + 3)
    return table(spark, d, "events").select("event_id", F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"))


@query("media_windows", """WITH d AS (SELECT o_orderkey, floor(o_totalprice) / 40 AS dur FROM orders), n AS (SELECT *, greatest(1, ceil((dur - 30) / 450))::INTEGER AS n0 FROM d), m AS (SELECT *, CASE WHEN n0 > 1 AND dur - (n0 - 1) * 450 < 120 THEN n0 - 1 ELSE n0 END AS n FROM n)
SELECT o_orderkey, i::INTEGER AS place, round(i * 450, 3)::DOUBLE AS start, round(CASE WHEN i = n - 1 THEN dur ELSE i * 450 + 480 END, 3) AS stop, round(CASE WHEN i = n - 1 THEN dur ELSE (i + 1) * 450 + 15 END, 3) AS own_to FROM m, range(0, 1000) r(i) WHERE i < n""")
def _(spark, d):
    w = table(spark, d, "orders").select("o_orderkey", F.posexplode(I.windows(F.floor("o_totalprice") / 40)).alias("place", "w"))
    return w.select("o_orderkey", "place", F.round("w.start", 3).alias("start"), F.round("w.end", 3).alias("stop"), F.round("w.own_to", 3).alias("own_to"))


@query("read_plan", "WITH p AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_discount * 10 < 0.6 AS bad FROM lineitem), s AS (SELECT *, avg(bad::INTEGER) OVER (PARTITION BY l_suppkey) AS share FROM p) SELECT CASE WHEN share > 0.5 OR bad THEN 'vision' ELSE 'layer' END AS route, count(*)::BIGINT AS n FROM s GROUP BY 1")
def _(spark, d):
    p = I.read_plan(table(spark, d, "lineitem").withColumn("q", F.col("l_discount") * 10), "l_suppkey", "l_linenumber", "q")
    return p.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("metadata_merge", """WITH v AS (SELECT l_partkey AS doc, ['title', 'language', 'summary'][1 + l_linenumber % 3] AS field, l_orderkey::VARCHAR AS value, ['user', 'catalogue', 'model'][1 + (l_suppkey % 3)] AS source, l_quantity / 50 AS c FROM lineitem)
SELECT doc, field, arg_max(source, (source = 'user', c - CASE WHEN source = 'catalogue' AND field <> 'title' THEN 0.3 ELSE 0 END, source)) AS source FROM v GROUP BY ALL""")
def _(spark, d):
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i)
    v = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc"), pick(("title", "language", "summary"), (1 + F.col("l_linenumber") % 3).cast("int")).alias("field"), F.col("l_orderkey").cast("string").alias("value"), pick(("user", "catalogue", "model"), (1 + F.col("l_suppkey") % 3).cast("int")).alias("source"), (F.col("l_quantity") / 50).alias("c"))
    return I.merge_fields(v, "doc", "field", "value", "source", "c").select("doc", "field", "source")


@query("resolve_document", f"""WITH q(q) AS (VALUES ('almond'), ('17'), ('the'), ('nothing like it')), k AS (SELECT q, p_partkey, {sql_key('p_name')} AS t, {sql_key('q')} AS k FROM part, q), r AS (SELECT q, p_partkey, CASE WHEN p_partkey::VARCHAR = q THEN 0 WHEN t = k THEN 1 WHEN starts_with(t, k) THEN 2 WHEN contains(t, k) THEN 3 END AS r FROM k)
SELECT q, arg_min(p_partkey, (r, p_partkey)) AS p_partkey FROM r WHERE r IS NOT NULL GROUP BY q""")
def _(spark, d):
    q = spark.createDataFrame([("almond",), ("17",), ("the",), ("nothing like it",)], "q string")
    return I.resolve_document(q, table(spark, d, "part"), "q", "p_partkey", "p_name")


@query("go_to_page", """WITH p AS (SELECT l_suppkey, l_orderkey::INTEGER % 60 AS physical, l_quantity::INTEGER::VARCHAR AS printed, '12' AS wanted FROM lineitem), r AS (SELECT *, CASE WHEN printed = wanted THEN 0 WHEN physical = 12 THEN 1 WHEN printed::INTEGER <= 12 AND 12 - printed::INTEGER <= 2 THEN 2 END AS r FROM p)
SELECT l_suppkey, wanted, arg_min(physical, (r, 12 - printed::INTEGER, physical)) AS physical FROM r WHERE r IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    p = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 60).cast("int").alias("physical"), F.col("l_quantity").cast("int").cast("string").alias("printed"), F.lit("12").alias("wanted"))
    return I.go_to_page(p, "l_suppkey", "printed", "physical", "wanted")


@query("provisional_segments", "WITH s AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 30 AS segment FROM events) SELECT user_id, segment::INTEGER AS segment, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def _(spark, d):
    return I.provisional_segments(table(spark, d, "events"), "user_id", "event_id").groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("leaf_segments", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey // 3 FROM customer WHERE c_custkey // 3 > 0)")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr("nullif(c_custkey div 3, 0)").alias("up"))
    return I.leaves(c, "c_custkey", "up").select("c_custkey")


@query("absolute_pages", "WITH p AS (SELECT l_orderkey, l_linenumber AS page, l_orderkey % 2 * 6 + 1 AS first FROM lineitem), r AS (SELECT *, max(page) OVER w <= 7 AND min(page) OVER w < first AS rel FROM p WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, CASE WHEN rel THEN page + first - 1 ELSE page END AS page FROM r")
def _(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("page"), (F.col("l_orderkey") % 2 * 6 + 1).alias("first"), F.lit(7).alias("size"))
    return I.absolute_pages(p, "l_orderkey", "page", "first", "size").select("l_orderkey", "page")


@query("usage_totals", "SELECT user_id, round(sum(value), 4) AS value, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS models FROM events GROUP BY 1")
def _(spark, d):
    return I.usage(table(spark, d, "events"), "user_id", "event_type", ["value"]).withColumn("value", F.round("value", 4))


@query("judgment_merge", "WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS a, l_suppkey % 4 AS b, CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey % 4 END AS c FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN abs(a - b) >= 2 OR (least(a, b) = 1 AND greatest(a, b) = 2) THEN coalesce(c::DOUBLE, (a + b) / 2) ELSE (a + b) / 2 END AS grade FROM j")
def _(spark, d):
    li = table(spark, d, "lineitem")
    third = F.when(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 4)
    return li.select("l_orderkey", "l_linenumber", I.judge_merge(F.col("l_partkey") % 4, F.col("l_suppkey") % 4, third).alias("grade"))


@query("anchor_coverage", "SELECT l_orderkey, bool_and((l_quantity - 1) <= l_linenumber * 8 + 20 AND l_quantity >= l_linenumber * 8 - 20) AS covered FROM lineitem GROUP BY 1")
def _(spark, d):
    b = F.col("l_linenumber") * 8
    hit = I.covers(F.col("l_quantity") - 1, F.col("l_quantity"), b, b, F.lit("time"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(hit).alias("covered"))


@query("genre_lens", r"""WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '[=≤≥∑∫]')) AS f, len(regexp_extract_all(text, '(?m)^\s*[—–-]\s*\p{Lu}')) AS dg, len(regexp_extract_all(text, '(?i)\b(?:article|artículo|section|ley|law)\s+\d+')) AS lg, len(regexp_extract_all(text, '\b1[0-9]{3}\b')) AS dt, len(regexp_extract_all(text, '(?i)^\s*(?:dear|querid[oa]|cher|lieber)\b')) AS lt FROM documents)
SELECT doc_id, CASE WHEN lg >= 5 THEN 'law' WHEN f >= 10 THEN 'science' WHEN dg >= 10 THEN 'drama' WHEN lt >= 1 THEN 'letters' WHEN dt >= 10 THEN 'history' ELSE 'essay' END AS lens FROM s""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", I.lens(F.lit("text"), I.genre_signals(F.col("text"))).alias("lens"))


@query("comprehension_scores", "SELECT event_id, round(least(greatest(0.5 * (value / 100) + 0.3 * (user_id % 10 / 10) + 0.2 - 0.1 * (event_id % 3) - 0.15 * (event_id % 2), 0), 1), 6) AS score FROM events")
def _(spark, d):
    s = I.comprehension_score(F.col("value") / 100, F.col("user_id") % 10 / 10, F.lit(1.0), F.col("event_id") % 3, F.col("event_id") % 2, F.lit(0))
    return table(spark, d, "events").select("event_id", F.round(s, 6).alias("score"))


@query("supported_confidence", "WITH v AS (SELECT o_custkey, avg((o_orderstatus = 'F')::INTEGER) AS r, count(*) FILTER (o_orderstatus = 'P') AS bad FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN r >= 0.85 AND bad <= 1 THEN 'high' WHEN r >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM v")
def _(spark, d):
    v = table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "P", "contradicted").otherwise("partial"))
    return I.supported_confidence(v, "o_custkey", "v")


@query("speaker_label_vote", "WITH a AS (SELECT event_type AS w, epoch_us(ts) / 1e6 AS t, user_id AS a FROM events WHERE event_id % 2 = 0), b AS (SELECT event_type AS w, epoch_us(ts) / 1e6 AS t, user_id % 7 AS b FROM events WHERE event_id % 2 = 1), n AS (SELECT a, b, count(*) AS n FROM a JOIN b USING (w) WHERE abs(a.t - b.t) < 30 GROUP BY ALL) SELECT a, arg_max(b, (n, b)) AS b FROM n GROUP BY a")
def _(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumnRenamed("event_type", "w")
    a, b = e.where("event_id % 2 = 0").withColumn("a", F.col("user_id")), e.where("event_id % 2 = 1").withColumn("b", F.col("user_id") % 7)
    return I.majority_labels(a, b, "w", "t", "a", "b", 30.0)


@query("federated_max", "SELECT doc_id, max(score) AS score FROM (SELECT doc_id, n_chars AS score FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, n_chars * 2 FROM documents WHERE source = 'src5') GROUP BY 1")
def _(spark, d):
    docs = table(spark, d, "documents")
    return I.interleaved_union([docs.where("lang = 'en'").select("doc_id", F.col("n_chars").alias("score")), docs.where("source = 'src5'").select("doc_id", (F.col("n_chars") * 2).alias("score"))], "doc_id", "score")


@query("sheet_row_ranges", "WITH r AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) SELECT c_nationkey, ((n - 1) // 40)::INTEGER AS part, min(n)::INTEGER AS from_row, max(n)::INTEGER AS to_row, md5(string_agg(c_name, chr(10) ORDER BY n)) AS digest FROM r GROUP BY c_nationkey, (n - 1) // 40")
def _(spark, d):
    s = I.sheet_rows(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_name")
    return s.select("c_nationkey", "part", "from_row", "to_row", F.md5("text").alias("digest"))


@query("relation_evidence", "WITH s AS (SELECT l_partkey, l_suppkey, l_returnflag, least(l_discount, 0.999) AS w FROM lineitem) SELECT l_partkey, l_suppkey, l_returnflag, round(1 - exp(sum(ln(1 - w))) + 1e-7, 4) AS l_discount, count(*)::BIGINT AS n_signals FROM s GROUP BY 1, 2, 3")
def _(spark, d):
    return I.combine_signals(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag", "l_discount").withColumn("l_discount", F.round(F.col("l_discount") + 1e-7, 4))


LEXICON = {"of the": 0.9, "that": 0.4, "thing": 0.7}


@query("concept_report", rf"""WITH s AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}'), '[\p{{L}}\p{{N}}]+'), '  ') || ' ' AS s FROM documents), t(term, needle, w) AS (VALUES ('of the', ' of  the ', 0.9), ('that', ' that ', 0.4), ('thing', ' thing ', 0.7)),
h AS (SELECT doc_id, term, w, (length(s) - length(replace(s, needle, ''))) // length(needle) AS n FROM s, t) SELECT doc_id, term, n::BIGINT AS n, round(1 - pow(1 - w, least(n, 5)), 6)::DOUBLE AS confidence FROM h WHERE n > 0""")
def _(spark, d):
    return I.concept_spans(table(spark, d, "documents"), LEXICON, "doc_id", "text").withColumn("confidence", F.round("confidence", 6))


@query("name_matches", "SELECT s_suppkey, true AS same, (s_suppkey % 2 = 0) AS organisation FROM supplier")
def _(spark, d):
    full = F.concat(F.lit("Maria Lopez"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(" Garcia")).otherwise(F.lit("")))
    org = F.when(F.col("s_suppkey") % 2 == 0, "Editorial Norte").otherwise("Ana Norte")
    return table(spark, d, "supplier").select("s_suppkey", I.same_person(full, F.lit("M. Lopez")).alias("same"), I.is_organisation(org).alias("organisation"))


@query("cost_forecast", "SELECT doc_id, round(least(greatest(300, n_chars * 0.25 * 0.5), 3600), 3)::DOUBLE AS seconds FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(I.cost_forecast(F.col("n_chars") * 0.25, each=0.5), 3).alias("seconds"))
