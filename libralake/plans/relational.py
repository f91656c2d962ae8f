"""Queries: filters, joins, aggregates, windows, sets over the star schema and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, intervals, metrics
from .registry import query, sql_key, table


@query("filter_docs_semi", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return filters.allowed(table(spark, d, "documents"), languages=["en", "fr-FR"]).join(good, "doc_id", "left_semi").select("doc_id", "lang")


@query("orphans_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("two_hop_left_join", "SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query("latest_order_per_customer", "SELECT o_custkey, max(o_orderdate) AS last_date, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_date"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_key"))


@query("range_self_join", "SELECT l_orderkey, l_linenumber, count(*) OVER w AS n_near, round(sum(l_quantity) OVER w, 2) AS near_quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)")
def _(spark, d):
    # Following lines of the same order: a range window sees what the self-join would pair.
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(0, 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(w).alias("n_near"), F.round(F.sum("l_quantity").over(w), 2).alias("near_quantity"))


SQL_SESS = "s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t0, epoch_us(ts) / 1e6 + 600 + value AS t1 FROM events)"


@query("unit_overlap_join", f"WITH {SQL_SESS} SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.t0 < b.t1 AND a.t1 > b.t0")
def _(spark, d):
    s = _spans(spark, d)
    a = s.select("user_id", F.col("event_id").alias("a_id"), F.col("t0").alias("a0"), F.col("t1").alias("a1"))
    b = s.select("user_id", F.col("event_id").alias("b_id"), F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    return intervals.overlap_join(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 3600.0).where("a_id < b_id").select("user_id", "a_id", "b_id")


def _spans(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select("user_id", "event_id", t.alias("t0"), (t + 600 + F.col("value")).alias("t1"))


@query("asof_unit", "WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT p.event_id, p.user_id, f.view_id FROM p ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.ts >= f.ts")
def _(spark, d):
    e = table(spark, d, "events")
    facts = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return intervals.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), facts, ["user_id"], "ts", "ts", ["view_id"]).select("event_id", "user_id", "view_id")


@query("nearest_value_join", """WITH p AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'), f AS (SELECT DISTINCT user_id, epoch_us(ts) / 1e6 AS v FROM events WHERE event_type = 'error'),
n AS (SELECT event_id, v, row_number() OVER (PARTITION BY event_id ORDER BY abs(v - t), v) AS r FROM p JOIN f USING (user_id) WHERE abs(v - t) <= 7200) SELECT event_id, v AS nearest FROM p LEFT JOIN (SELECT event_id, v FROM n WHERE r = 1) USING (event_id)""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    facts = e.where("event_type = 'error'").select("user_id", F.col("t").alias("v")).distinct()
    return intervals.nearest(e.where("event_type = 'click'").select("event_id", "user_id", "t"), facts, ["user_id"], "t", "v", 7200.0, "event_id").select("event_id", "nearest")


@query("unambiguous_key_join", f"WITH k AS (SELECT {sql_key("p_name || ' ' || p_brand || ' ' || p_size")} AS k, min(p_partkey) AS p FROM part GROUP BY 1 HAVING count(*) = 1) SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN k ON l_partkey = p")
def _(spark, d):
    name = T.key(F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")))
    only = table(spark, d, "part").groupBy(name.alias("k")).agg(F.min("p_partkey").alias("l_partkey"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return table(spark, d, "lineitem").join(only, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("new_items_diff", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < '1993-01-01')")
def _(spark, d):
    li = table(spark, d, "lineitem")
    old = li.where("l_shipdate < timestamp_ntz'1993-01-01'").select("l_partkey")
    return li.where("l_shipdate >= timestamp_ntz'1997-01-01'").select("l_partkey").distinct().join(old, "l_partkey", "left_anti")


@query("corpus_snapshot", """SELECT lang, source, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS chars, count(quality)::BIGINT AS n_labelled, round(avg(quality), 6) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"), F.count("quality").alias("n_labelled"), F.round(F.avg("quality"), 6).alias("quality"))


@query("corpus_grouping_sets", "SELECT lang, source, grouping(lang)::INTEGER AS no_lang, grouping(source)::INTEGER AS no_source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def _(spark, d):
    docs = table(spark, d, "documents")
    lang, source = F.col("lang"), F.col("source")
    return docs.groupingSets([[lang], [source], [lang, source], []], lang, source).agg(F.grouping("lang").cast("int").alias("no_lang"), F.grouping("source").cast("int").alias("no_source"), F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("decade_counts", "SELECT (floor(year(o_orderdate) / 10) * 10)::INTEGER::VARCHAR || 's' AS decade, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.concat((F.floor(F.year("o_orderdate") / 10) * 10).cast("string"), F.lit("s")).alias("decade")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("history_stats_daily", "SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"))


@query("history_range", "WITH e AS (SELECT max(ts) AS now FROM events) SELECT r AS range, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS n_errors FROM events, e, (VALUES ('24h', 1), ('7d', 7), ('30d', 30)) t(r, days) WHERE ts >= now - to_days(days) GROUP BY r")
def _(spark, d):
    e = table(spark, d, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    hit = e.crossJoin(now).select("event_type", F.explode(F.array(*[F.when(F.col("ts") >= F.col("now") - F.expr(f"interval {n} days"), F.lit(r)) for r, n in (("24h", 1), ("7d", 7), ("30d", 30))])).alias("range"))
    return hit.where("range is not null").groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


@query("history_props_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("conditional_aggregates", "SELECT l_returnflag, count(*) FILTER (l_discount > 0.05)::BIGINT AS n_deep, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS open_quantity, min(l_tax) AS least_tax FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("n_deep"), F.round(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), 6).alias("open_quantity"), F.min("l_tax").alias("least_tax"))


@query("having_conditional_sum", "SELECT o_custkey, count(*)::BIGINT AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_final FROM orders GROUP BY 1 HAVING sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) >= 3")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("n_final")).where("n_final >= 3")


@query("mode_per_group", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, event_type AS most, n::BIGINT AS n FROM r WHERE k = 1")
def _(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("most"), (-F.col("b.m")).alias("n"))


@query("nearest_rank_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, " + ", ".join(f"max(value) FILTER (k = greatest(ceil({p} * n / 100), 1)) AS p{p}" for p in (5, 50, 95)) + " FROM r GROUP BY 1")
def _(spark, d):
    return metrics.nearest_rank(table(spark, d, "events"), ["event_type"], "value", [5, 50, 95])


@query("topk_per_group", "SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INTEGER AS rank FROM documents QUALIFY rank <= 10")
def _(spark, d):
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("lang", "doc_id", "n_chars").withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("systematic_sample", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k % 10 = 0")
def _(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").select("vec_id", F.row_number().over(w).alias("k")).where("k % 10 = 0").select("vec_id")


@query("stratified_sample", "WITH g AS (SELECT *, count(*) OVER (PARTITION BY lang) AS c, count(*) OVER () AS n, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents) SELECT doc_id, lang FROM g WHERE k <= greatest(2, round(100 * c / n))")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
    quota = F.greatest(F.lit(2), F.round(100 * F.col("c") / F.col("n")))
    share = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("c").alias("n")))).select("lang", quota.alias("quota"))
    w = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return docs.withColumn("k", F.row_number().over(w)).join(F.broadcast(share), "lang").where("k <= quota").select("doc_id", "lang")


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (150000, 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 21")
def _(spark, d):
    return table(spark, d, "orders").where("o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey < 0)").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(21).select("o_orderkey", "o_totalprice")


@query("islands_pages", "WITH n AS (SELECT DISTINCT l_suppkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS g FROM n) SELECT l_suppkey, min(n)::INTEGER AS first, max(n)::INTEGER AS last, count(*)::BIGINT AS size FROM g GROUP BY l_suppkey, g")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).alias("n"))
    return intervals.islands(li, ["l_suppkey"], "n")


@query("merge_ranges", """WITH s AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS d, o_totalprice FROM orders), m AS (SELECT *, CASE WHEN d - lag(d) OVER w <= 30 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey)),
g AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT o_custkey, min(d)::INTEGER AS first, max(d)::INTEGER AS last, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM g GROUP BY o_custkey, g""")
def _(spark, d):
    from ..operators.citations import merge_near

    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("d"))
    return merge_near(o, "o_custkey", "d", 30, "o_orderkey", "o_totalprice")


@query("interval_union", f"WITH {SQL_SESS}, m AS (SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY user_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60 THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, round(min(t0), 3) AS t0, round(max(t1), 3) AS t1, count(*)::BIGINT AS n FROM g GROUP BY user_id, g")
def _(spark, d):
    return intervals.union(_spans(spark, d), ["user_id"], "t0", "t1", 60).select("user_id", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"), "n")


@query("interval_holes", f"WITH {SQL_SESS}, m AS (SELECT user_id, t0 AS hole_to, max(t1) OVER (PARTITION BY user_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hole_from FROM s) SELECT user_id, round(hole_from, 3) AS hole_from, round(hole_to, 3) AS hole_to FROM m WHERE hole_to - hole_from >= 86400")
def _(spark, d):
    return intervals.holes(_spans(spark, d), ["user_id"], "t0", "t1", 86400).select("user_id", F.round("hole_from", 3).alias("hole_from"), F.round("hole_to", 3).alias("hole_to"))


@query("session_windows", "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*)::BIGINT AS n FROM g GROUP BY user_id, g")
def _(spark, d):
    from ..streaming import windows

    return windows.sessions(table(spark, d, "events"), "user_id", "30 minutes")


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    from ..streaming import windows

    return windows.counts(table(spark, d, "events"), "1 hour", None, ["event_type"])


@query("sliding_counts", "SELECT time_bucket(INTERVAL 30 MINUTES, ts) - to_minutes(30 * k) AS started, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL")
def _(spark, d):
    from ..streaming import windows

    return windows.counts(table(spark, d, "events"), "1 hour", "30 minutes", ["event_type"])


@query("title_similarity_pairs", f"""WITH b AS (SELECT p_partkey, p_brand, p_size, list_distinct(list_filter(regexp_extract_all(translate(lower(p_name), '', ''), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 2)) AS w FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)), 6) AS sim FROM b a JOIN b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) >= 0.25""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    group = ["p_brand", "p_size"]
    # Names of a group are compared once each, and only where they share a word, as alike ones must; then their parts meet.
    words = F.array_sort(F.array_distinct(F.filter(T.tokens(F.col("p_name")), lambda t: F.length(t) > 2)))
    p = p.select("p_partkey", *group, words.alias("w"))
    names = p.select(*group, "w").distinct()
    each = names.withColumn("t", F.explode("w"))
    met = each.join(each.withColumnRenamed("w", "v"), [*group, "t"]).groupBy(*group, "w", "v").agg(F.count(F.lit(1)).alias("n"))
    alike = met.withColumn("sim", F.round(F.col("n") / F.greatest(F.size("w"), F.size("v")), 6)).where(F.col("n") / F.greatest(F.size("w"), F.size("v")) >= 0.25).select(*group, "w", "v", "sim")
    # Files say little about the size of what is read: no side is gathered in one place.
    left = p.withColumnRenamed("p_partkey", "a").hint("merge").join(alike, [*group, "w"]).select(*group, "v", "a", "sim")
    return left.hint("merge").join(p.select(*group, F.col("w").alias("v"), F.col("p_partkey").alias("b")), [*group, "v"]).where("a < b").select("a", "b", "sim")


@query("dice_bigrams", """WITH p AS (SELECT p_partkey, lower(p_type) AS t FROM part), g AS (SELECT p_partkey, t, substr(t, i, 2) AS g FROM p, range(1, 200) r(i) WHERE i < length(t)), c AS (SELECT p_partkey, g, count(*) AS n FROM g GROUP BY ALL), z AS (SELECT p_partkey, sum(n) AS z FROM c GROUP BY 1)
SELECT a.p_partkey, round(CASE WHEN p.t = q.t THEN 1 ELSE 2.0 * coalesce((SELECT sum(least(x.n, y.n)) FROM c x JOIN c y USING (g) WHERE x.p_partkey = a.p_partkey AND y.p_partkey = a.p_partkey + 1), 0) / (a.z + b.z) END::DOUBLE, 6) AS dice
FROM z a JOIN z b ON b.p_partkey = a.p_partkey + 1 JOIN p ON p.p_partkey = a.p_partkey JOIN p q ON q.p_partkey = b.p_partkey""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("t"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(T.dice(F.col("t"), F.col("u")), 6).alias("dice"))


@query("levenshtein_pairs", "SELECT a.p_partkey, levenshtein(a.p_name, b.p_name)::INTEGER AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("q_name"))
    return p.join(q, "p_partkey").select("p_partkey", F.levenshtein("p_name", "q_name").alias("distance"))


@query("noisy_or", "SELECT l_orderkey, round(1 - exp(sum(ln(1 - l_discount))) + 1e-7, 4) AS strength FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(T.noisy_or(F.collect_list("l_discount")) + 1e-7, 4).alias("strength"))


@query("upsert_last_wins", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def _(spark, d):
    from ..operators.tables import last_wins

    return last_wins(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("union_distinct_edges", "SELECT o_custkey AS a, o_orderkey AS b FROM orders UNION SELECT o_orderkey, o_custkey FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).union(o.select("o_orderkey", "o_custkey")).distinct()
