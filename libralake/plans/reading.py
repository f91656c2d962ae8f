"""Queries: passages, insertions, regions, speech, entity views, and the library's search end to end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..library import Library, hash_embedding
from ..operators import graph, media, passages
from .registry import query, sql_key, sql_tokens, table


@query("best_windows")
def _(spark, d):
    return passages.windows(table(spark, d, "documents"), ["thing", "threat", "other"], "doc_id", "text")


@query("claim_split")
def _(spark, d):
    return passages.claim_rows(table(spark, d, "documents"), "doc_id", "text")


@query("highlighted_terms", f"SELECT doc_id, n::INTEGER AS n_marks FROM (SELECT doc_id, len(list_filter({sql_tokens('text')}, lambda t: regexp_full_match(t, '(thing|threat)\\p{{L}}{{0,3}}'))) AS n FROM documents) WHERE n > 0")
def _(spark, d):
    m = passages.marked(F.col("text"), ["thing", "threat"])
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all(m, F.lit("<mark>"), F.lit(0))).alias("n_marks")).where("n_marks > 0")


@query("insertion_points", "SELECT conv_id, turn, length(regexp_replace(text, '\\s+$', '')) - length(regexp_extract(regexp_replace(text, '\\s+$', ''), '[.!?…]+[\"''»”)\\]]*$')) AS point FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", passages.insertion_point(F.col("text"), False).cast("long").alias("point"))


@query("grouped_insertions", "WITH o AS (SELECT l_orderkey, l_suppkey, l_partkey, min(l_linenumber) AS r FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(l_suppkey || ' ' || l_partkey, '; ' ORDER BY r, l_suppkey, l_partkey) AS citations FROM o GROUP BY 1")
def _(spark, d):
    return passages.group_insertions(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")


@query("region_boxes", """WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_tax AS x, l_quantity / 50 AS y, 0.1 AS w, 0.004 AS h FROM lineitem), m AS (SELECT *, CASE WHEN y - max(y + h) OVER (PARTITION BY l_suppkey ORDER BY y, l_orderkey, l_linenumber, l_partkey, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0.015 THEN 1 ELSE 0 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY y, l_orderkey, l_linenumber, l_partkey, x ROWS UNBOUNDED PRECEDING) AS g FROM m), b AS (SELECT l_suppkey, g, count(*) AS n, min(y) AS y0, max(y + h) AS y1 FROM g GROUP BY ALL) SELECT l_suppkey, round(arg_max(y0, (n, -g)), 6) AS y, round(arg_max(y1 - y0, (n, -g)), 6) AS h FROM b GROUP BY 1""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_tax").alias("x"), (F.col("l_quantity") / 50).alias("y"), F.lit(0.1).alias("w"), F.lit(0.004).alias("h"))
    return passages.union_boxes(li, ["l_suppkey"], "x", "y", "w", "h", gap=0.015).select("l_suppkey", F.round("y", 6).alias("y"), F.round("h", 6).alias("h"))


@query("speech_without_words", """WITH e AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS t0 FROM events), s AS (SELECT user_id, t0, t0 + 3600 AS t1 FROM e WHERE event_type = 'view'), w AS (SELECT user_id, greatest(0, t0 - 1.2) AS t0, t0 + 3600 + 1.2 AS t1 FROM e WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, unnest([t0, t1]) AS b FROM (SELECT * FROM s UNION ALL SELECT * FROM w)), g AS (SELECT user_id, b AS a, lead(b) OVER (PARTITION BY user_id ORDER BY b) AS z FROM b),
k AS (SELECT * FROM g WHERE z IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE s.user_id = g.user_id AND s.t0 <= a AND s.t1 >= z) AND NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = g.user_id AND w.t0 <= a AND w.t1 >= z)), i AS (SELECT *, CASE WHEN a = lag(z) OVER (PARTITION BY user_id ORDER BY a) THEN 0 ELSE 1 END AS new FROM k), j AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a) AS n FROM i)
SELECT user_id, min(a) AS t0, max(z) AS t1 FROM j GROUP BY user_id, n HAVING max(z) - min(a) >= 3""")
def _(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, d, "events").select("user_id", "event_type", t.alias("t0"), (t + 3600).alias("t1"))
    return media.uncovered(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "t0", "t1")


@query("proportional_alignment", """WITH a AS (SELECT conv_id, turn AS a, (row_number() OVER w - 0.5) / count(*) OVER (PARTITION BY conv_id) AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT conv_id, turn AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS slot, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations WHERE role = 'user')
SELECT conv_id, a, b FROM a JOIN b USING (conv_id) WHERE slot = greatest(1, least(m, ceil(p * m)))""")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return media.proportional(c, c.where("role = 'user'"), "conv_id", "turn")


@query("region_matches")
def _(spark, d):
    o = table(spark, d, "orders")
    place = lambda shift: F.struct((F.col("o_totalprice") % 100 / 100 + shift).alias("x"), (F.col("o_orderkey") % 10 / 10.0).alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))
    frame = lambda shift: o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("id"), place(shift).alias("box"), F.col("o_orderpriority").alias("cap"))
    return media.match_regions(frame(0.0), frame(0.03), "page", "box", "id", "cap")


@query("entity_merge", f"SELECT p_brand, {sql_key('p_name')} AS entity_key, max(p_retailprice) AS importance FROM part GROUP BY ALL")
def _(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_name", F.array("p_type").alias("forms"), F.col("p_retailprice").alias("importance"), F.lit(None).cast("string").alias("analysis"))
    return graph.merge_entities(p, "p_brand", "p_name", "forms", "importance", "analysis").select("p_brand", "entity_key", "importance")


@query("entity_timeline", "WITH o AS (SELECT l_orderkey AS part, l_suppkey AS doc FROM lineitem GROUP BY ALL), d AS (SELECT o_orderkey AS part, year(o_orderdate)::INTEGER AS y FROM orders WHERE o_orderstatus = 'F') SELECT o.part, o.doc, coalesce(d.y, 1900 + s_nationkey)::INTEGER AS year FROM o LEFT JOIN d USING (part) LEFT JOIN supplier ON s_suppkey = o.doc")
def _(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("part"), F.col("l_suppkey").alias("doc"))
    dates = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("part"), F.year("o_orderdate").alias("year"))
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), (1900 + F.col("s_nationkey")).alias("year"))
    return graph.timeline(m, dates, docs, "part", "doc", "year")


@query("entity_neighbourhood", """WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT a.l_partkey AS a, b.l_partkey AS b FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey), t AS (SELECT node, other, count(*)::DOUBLE AS weight FROM (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e) GROUP BY ALL), n AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) <= 40),
f AS (SELECT * FROM n WHERE node = 1 ORDER BY weight DESC, other LIMIT 48) SELECT * FROM f UNION ALL SELECT * FROM n WHERE weight >= 0.8 AND node IN (SELECT other FROM f) AND other IN (SELECT other FROM f) AND node < other""")
def _(spark, d):
    from .library import edges

    return graph.neighbourhood(graph.neighbours(edges(spark, d), 40), 1)


@query("library_search")
def _(spark, d):
    """The hybrid search over fragments of all documents, from the tables of documents and vectors."""
    docs = table(spark, d, "documents")
    frags = docs.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("doc"), F.lit(0).alias("place"), "text")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    shelf = Library(frags, vectors, docs.withColumnRenamed("doc_id", "doc"))
    return shelf.search("thing that threat of other notion", 20).select("key", "score", "routes", "marked")


@query("embedded_fragments", "SELECT doc_id, 64::INTEGER AS dims FROM documents")
def _(spark, d):
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hash_embedding(t or ""))

    return table(spark, d, "documents").select("doc_id", F.size(run("text")).alias("dims"))


@query("keyframe_units", "WITH f AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), u AS (SELECT user_id, ts, max(event_id) AS unit FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT f.event_id, u.unit, epoch_us(f.ts) < epoch_us(u.ts) + 600000000 AS inside FROM f ASOF LEFT JOIN u ON f.user_id = u.user_id AND f.ts >= u.ts")
def _(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").withColumn("t", us)
    units = e.where("event_type = 'view'").groupBy("user_id", F.col("t").alias("t0")).agg(F.max("event_id").alias("unit")).withColumn("t1", F.col("t0") + 600000000)
    return media.frames_to_units(e.where("event_type = 'error'").select("event_id", "user_id", "t"), units, "user_id", "t", "t0", "t1", "unit").select("event_id", "unit", "inside")


@query("page_figures", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INTEGER AS place FROM lineitem WHERE l_quantity / 50 >= 0.01 AND NOT (l_quantity / 50 >= 0.85 AND l_returnflag = 'N')")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("area"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("cap"), F.struct("l_linenumber", "l_partkey").alias("o"))
    return media.page_figures(li, "l_orderkey", "area", "cap", "o").select("l_orderkey", "l_linenumber", "place")


@query("window_ownership", "SELECT event_id FROM events WHERE value + 5 >= 20 AND value + 5 < 60")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").alias("a"), (F.col("value") + 10).alias("b"), F.lit(20.0).alias("own_from"), F.lit(60.0).alias("own_to"))
    return media.owned(e, "a", "b", "own_from", "own_to").select("event_id")


@query("distinct_pieces_once", "SELECT count(*)::BIGINT AS n_pieces, sum(c)::BIGINT AS n_rows FROM (SELECT p_type, count(*) AS c FROM part GROUP BY 1)")
def _(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_type").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("c").alias("n_rows"))


@query("running_speaker_order", "SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM conversations")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("so_far"))
