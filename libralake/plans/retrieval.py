"""Queries: terms, lexical and dense search, fusion, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import dense, fusion, lexical, metrics
from ..session import shared_folder
from .registry import SQL_STOP, query, sql_fold, sql_key, sql_tokens, table

QUERY = "thing that threat of other notion"
TERMS = lexical.query_terms(QUERY)
SQL_TERMS = ", ".join(f"('{t}')" for t in TERMS)
R = Window.partitionBy


def vector_of(spark, sf_dir, vec_id: int) -> list[float]:
    r = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in r[0]] if r else []


def sql_bm25(cols: dict[str, float], every: bool = False, terms: str = SQL_TERMS) -> str:
    """CTEs ending in ``scored(doc_id, score)``."""
    toks = ", ".join(f"{sql_tokens(c)} AS t_{i}" for i, c in enumerate(cols))
    length = " + ".join(f"{w} * len(t_{i})" for i, w in enumerate(cols.values()))
    tf = " + ".join(f"{w} * len(list_filter(t_{i}, lambda x: x = term))" for i, w in enumerate(cols.values()))
    need = "count(*) = (SELECT count(*) FROM q)" if every else "count(*) > 0"
    return f"""
q(term) AS (VALUES {terms}),
d AS (SELECT doc_id, {toks} FROM documents),
dl AS (SELECT *, {length} AS dl FROM d),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tfs AS (SELECT doc_id, dl, term, {tf} AS tf FROM dl, q),
dfs AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tfs GROUP BY term),
scored AS (SELECT doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tfs JOIN dfs USING (term), st WHERE tf > 0 GROUP BY doc_id HAVING {need})"""


SQL_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query("tokens_per_doc", f"SELECT doc_id, len({sql_tokens('text')})::BIGINT AS n_tokens, len(list_distinct({sql_tokens('text')}))::BIGINT AS n_distinct FROM documents")
def _(spark, d) -> DataFrame:
    t = F.col("t")
    return table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("term_df_top", f"SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term ORDER BY df DESC, term LIMIT 100")
def _(spark, d):
    tf = lexical.term_frequencies(table(spark, d, "documents"), "doc_id", {"text": F.col("text")})
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("df"), "term").limit(100)


@query("query_terms_per_doc", f"SELECT doc_id, len(list_filter({sql_tokens('text')}, lambda x: length(x) >= 2 AND x NOT IN {SQL_STOP}))::BIGINT AS n_terms FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.terms(F.col("text"))).cast("long").alias("n_terms"))


@query("fold_key", f"SELECT p_partkey, {sql_key('p_name')} AS name_key, {sql_fold('p_brand')} AS brand_fold FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.key(F.col("p_name")).alias("name_key"), T.fold(F.col("p_brand")).alias("brand_fold"))


_indexes: dict[tuple[str, str], lexical.Index] = {}
COLUMNS = {"text": 1.0, "context": 0.35, "section": 0.6, "normalised": 0.9}


def index_of(spark, d) -> lexical.Index:
    """The stored lists of all documents over four columns, built once in a session."""
    import uuid

    held = (spark.sparkContext.applicationId, d)
    if held not in _indexes:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        head = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
        cols = {"text": F.col("text"), "context": F.concat_ws(" ", "source", "lang"), "section": head, "normalised": F.upper(head)}
        _indexes[held] = lexical.build(table(spark, d, "documents"), path, columns=cols)
    return _indexes[held]


def text_scores(spark, d, terms: list[str], every: bool = False) -> DataFrame:
    """BM25 over the texts alone, from the stored lists."""
    return index_of(spark, d).search(terms, {"text": 1.0, "context": 0.0, "section": 0.0, "normalised": 0.0}, every)


@query("bm25_topk", f"WITH {sql_bm25({'text': 1.0})} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def _(spark, d):
    s = text_scores(spark, d, TERMS)
    return s.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("bm25_two_columns", f"WITH {sql_bm25({'text': 1.0, 'source': 0.35})} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def _(spark, d):
    s = lexical.bm25(table(spark, d, "documents"), TERMS, columns={"text": F.col("text"), "source": F.col("source")}, weights={"text": 1.0, "source": 0.35})
    return s.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


SQL_COLUMNS = {"text": 1.0, "(source || ' ' || lang)": 0.35, "split_part(text, chr(10), 1)": 0.6, "upper(split_part(text, chr(10), 1))": 0.9}


@query("bm25_four_columns", f"WITH {sql_bm25(SQL_COLUMNS)} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def _(spark, d):
    s = index_of(spark, d).search(TERMS, COLUMNS)
    return s.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


SQL_PREFIX = sql_bm25({"text": 1.0}, True, "('the'), ('thr')").replace("list_filter(t_0, lambda x: x = term)", "list_filter(t_0, lambda x: CASE WHEN term = 'thr' THEN starts_with(x, 'thr') ELSE x = term END)")


@query("bm25_with_prefix", f"WITH {SQL_PREFIX} SELECT doc_id, round(score, 6) AS score FROM scored")
def _(spark, d):
    """All terms, the last one as the beginning of a word."""
    s = index_of(spark, d).search(["the"], {"text": 1.0, "context": 0.0, "section": 0.0, "normalised": 0.0}, every=True, prefix="thr")
    return s.select("doc_id", F.round("score", 6).alias("score"))


@query("mandatory_phrases", f"""WITH t AS (SELECT doc_id, ' ' || array_to_string({sql_tokens('text')}, '  ') || ' ' AS s FROM documents), n AS (SELECT doc_id, (length(s) - length(replace(s, ' of  the ', ''))) // length(' of  the ') AS a, (length(s) - length(replace(s, ' in  the ', ''))) // length(' in  the ') AS b FROM t) SELECT doc_id, (a + b)::BIGINT AS n_hits FROM n WHERE a > 0 AND b > 0""")
def _(spark, d):
    return lexical.all_phrases(table(spark, d, "documents"), ["of the", "in the"])


AND_TERMS = ["the", "of", "are"]


@query("bm25_all_terms", f"WITH {sql_bm25({'text': 1.0}, True, '(' + chr(39) + 'the' + chr(39) + '), (' + chr(39) + 'of' + chr(39) + '), (' + chr(39) + 'are' + chr(39) + ')')} SELECT doc_id, round(score, 6) AS score FROM scored")
def _(spark, d):
    return text_scores(spark, d, AND_TERMS, every=True).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_prefix_terms", f"""WITH t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents)
SELECT term, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM t WHERE starts_with(term, 'tho') GROUP BY term""")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.filter(T.tokens(F.col("text")), lambda w: F.startswith(w, F.lit("tho")))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("phrase_hits", f"""WITH t AS (SELECT doc_id, ' ' || array_to_string({sql_tokens('text')}, '  ') || ' ' AS s FROM documents)
SELECT doc_id, ((length(s) - length(replace(s, ' of  the ', ''))) // length(' of  the '))::BIGINT AS n_hits FROM t WHERE contains(s, ' of  the ')""")
def _(spark, d):
    return lexical.phrase(table(spark, d, "documents"), "of the")


@query("quotes_in_queries", r"""SELECT conv_id, turn, len(regexp_extract_all(text, '«[^»]{2,}»|"[^"]{2,}"|“[^”]{2,}”|„[^“”]{2,}[“”]'))::BIGINT AS n_quotes FROM conversations""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.quoted(F.col("text"))).cast("long").alias("n_quotes"))


@query("knn_exact", f"SELECT a.vec_id, round({SQL_DOT}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b ORDER BY round({SQL_DOT}, 6) DESC, a.vec_id LIMIT 20")
def _(spark, d):
    return dense.knn(table(spark, d, "embeddings"), vector_of(spark, d, 7), 20).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_filtered", f"SELECT a.vec_id, a.label, round({SQL_DOT}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b WHERE a.label IN (1, 3, 5) AND a.vec_id <> 7 ORDER BY round({SQL_DOT}, 6) DESC, a.vec_id LIMIT 20")
def _(spark, d):
    e = table(spark, d, "embeddings")
    from ..operators.filters import compile_filter

    near = dense.knn(e, vector_of(spark, d, 7), 20, where=compile_filter({"label": {"$in": [1, 3, 5]}, "vec_id": {"$ne": 7}}))
    return near.join(e.select("vec_id", "label"), "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query("knn_batch_topk", f"""WITH s AS (SELECT b.vec_id AS query, a.vec_id, round({SQL_DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT query, vec_id, score, rank FROM r WHERE rank <= 5""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return dense.knn_batch(e, e.where("vec_id % 50 = 0"), 5)


SQL_CENT = "cent AS (SELECT label AS cell, list(x ORDER BY i) AS centroid FROM (SELECT label, i, round(avg(x::DOUBLE), 9) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
SQL_COS = "(list_sum(list_transform(list_zip(e.embedding, c.centroid), lambda p: p[1]::DOUBLE * p[2])) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(c.centroid, lambda x: x * x)))))"


def cells(e: DataFrame) -> DataFrame:
    return dense.centroids(e, "label").withColumnRenamed("label", "cell")


@query("ivf_assign", f"WITH {SQL_CENT}, s AS (SELECT vec_id, cell, round({SQL_COS}, 6) AS score FROM embeddings e, cent c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cell)::INTEGER AS rank FROM s) SELECT vec_id, cell, score, rank FROM r WHERE rank <= 2")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return dense.assign(e, cells(e), n=2)


@query("ivf_probe", f"""WITH {SQL_CENT}, s AS (SELECT vec_id, cell, round({SQL_COS}, 6) AS score FROM embeddings e, cent c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cell) AS rank FROM s),
probe AS (SELECT cell FROM r WHERE vec_id = 7 AND rank <= 3), inside AS (SELECT vec_id FROM r WHERE rank = 1 AND cell IN (SELECT cell FROM probe))
SELECT a.vec_id, round({SQL_DOT}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b WHERE a.vec_id IN (SELECT vec_id FROM inside) ORDER BY round({SQL_DOT}, 6) DESC, a.vec_id LIMIT 20""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    c = cells(e)
    return dense.ivf_search(e, dense.assign(e, c), vector_of(spark, d, 7), c, 3, 20).select("vec_id", F.round("score", 6).alias("score"))


@query("vector_shorten", "SELECT vec_id, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE)), 6) AS kept_energy FROM embeddings")
def _(spark, d):
    cut = F.slice("embedding", 1, 16)
    short = V.shorten(F.col("embedding"), 16)
    # The shortened vector has length 1: what it kept is the squared length before scaling.
    return table(spark, d, "embeddings").select("vec_id", F.round(V.dot(short, short) * V.dot(cut, cut), 6).alias("kept_energy"))


SQL_LISTS = f"""{sql_bm25({'text': 1.0})},
lex AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 50),
den AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.vec_id AS doc_id, round({SQL_DOT}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b) QUALIFY rank <= 50)"""


def lists(spark, d):
    lex = fusion.ranked(text_scores(spark, d, TERMS), "doc_id", "lexical", 50)
    near = dense.knn(table(spark, d, "embeddings"), vector_of(spark, d, 7), 50).withColumnRenamed("vec_id", "doc_id")
    return [lex, fusion.ranked(near, "doc_id", "dense", 50)]


@query("rrf_hybrid", f"WITH {SQL_LISTS}, u AS (SELECT *, 'lexical' AS route FROM lex UNION ALL SELECT *, 'dense' FROM den) SELECT doc_id, round(sum(1.0 / (10 + rank)), 6) AS score, string_agg(route, '+' ORDER BY route) AS routes FROM u GROUP BY doc_id ORDER BY round(sum(1.0 / (10 + rank)), 6) DESC, doc_id LIMIT 30")
def _(spark, d):
    return fusion.rrf(lists(spark, d), "doc_id").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(30)


@query("rrf_weighted_intent", f"WITH {SQL_LISTS}, u AS (SELECT *, 'lexical' AS route, 1.0 AS w FROM lex UNION ALL SELECT *, 'dense', 0.45 FROM den) SELECT doc_id, round(sum(w / (60 + rank)), 6) AS score, string_agg(route, '+' ORDER BY route) AS routes FROM u GROUP BY doc_id")
def _(spark, d):
    return fusion.rrf(lists(spark, d), "doc_id", fusion.INTENT_WEIGHTS["quote"], k=60).withColumn("score", F.round("score", 6))


@query("minmax_scores", f"WITH {sql_bm25({'text': 1.0})} SELECT doc_id, round(CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END, 5) AS scaled FROM scored")
def _(spark, d):
    s = fusion.min_max(text_scores(spark, d, TERMS), "score")
    return s.select("doc_id", F.round("scaled", 5).alias("scaled"))


@query("rerank_blend", f"""WITH {sql_bm25({'text': 1.0})}, m AS (SELECT doc_id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS fused FROM scored),
o AS (SELECT doc_id, count(*) / {len(TERMS)}.0 AS rr FROM tfs WHERE tf > 0 GROUP BY doc_id)
SELECT doc_id, round(0.2 * fused + 0.8 * rr, 5) AS score FROM m JOIN o USING (doc_id)""")
def _(spark, d):
    docs = table(spark, d, "documents")
    s = fusion.min_max(text_scores(spark, d, TERMS), "score").withColumnRenamed("scaled", "fused")
    share = docs.select("doc_id", T.overlap(F.array(*map(F.lit, TERMS)), T.tokens(F.col("text"))).alias("rr"))
    return fusion.blend(s.join(share, "doc_id"), "fused", "rr").select("doc_id", F.round("score", 5).alias("score"))


@query("dedupe_candidates", f"""WITH k AS (SELECT doc_id, CASE WHEN length({sql_key('text')}) >= 40 THEN 't:' || substr({sql_key('text')}, 1, 200) ELSE 'i:' || doc_id END AS id FROM documents)
SELECT min(doc_id) AS doc_id FROM k GROUP BY id""")
def _(spark, d):
    t = T.key(F.col("text"))
    identity = F.when(F.length(t) >= 40, F.concat(F.lit("t:"), F.substring(t, 1, 200))).otherwise(F.concat(F.lit("i:"), F.col("doc_id")))
    # Only the key travels, not the text.
    return table(spark, d, "documents").select("doc_id", identity.alias("id")).groupBy("id").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("unit_penalty", f"WITH {sql_bm25({'text': 1.0})}, s AS (SELECT doc_id, source, score FROM scored JOIN documents USING (doc_id)) SELECT doc_id, round(score * pow(0.85, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, doc_id) - 1), 5) AS score FROM s")
def _(spark, d):
    docs = table(spark, d, "documents")
    s = text_scores(spark, d, TERMS).withColumn("r", F.round("score", 9)).join(docs.select("doc_id", "source"), "doc_id")
    return fusion.unit_penalty(s, "source", "r", "doc_id", 0.85).select("doc_id", F.round("score_penalised", 5).alias("score"))


@query("interleave_lists", f"""WITH {SQL_LISTS}, u AS (SELECT doc_id, rank, 'lexical' AS route FROM lex UNION ALL SELECT doc_id, rank, 'dense' FROM den),
f AS (SELECT doc_id, min((rank, route)) AS p FROM u GROUP BY doc_id) SELECT doc_id, row_number() OVER (ORDER BY p)::INTEGER AS place FROM f""")
def _(spark, d):
    a, b = lists(spark, d)
    return fusion.interleave(a.unionByName(b), "doc_id").select("doc_id", "place")


@query("literal_first", f"WITH {SQL_LISTS} SELECT doc_id, round((2 - (rank - 1) * 0.001)::DOUBLE, 6) AS score, 'exact' AS tier FROM lex UNION ALL SELECT doc_id, round((1 - (rank - 1) * 0.001)::DOUBLE, 6), 'similar' FROM den WHERE doc_id NOT IN (SELECT doc_id FROM lex)")
def _(spark, d):
    a, b = lists(spark, d)
    return fusion.literal_first(a, b, "doc_id").withColumn("score", F.round("score", 6))


@query("more_like_this", f"""WITH t AS (SELECT unnest(list_distinct({sql_tokens('text')})) AS term FROM documents WHERE doc_id = 7), pick AS (SELECT term FROM t WHERE length(term) >= 2 AND term NOT IN {SQL_STOP} ORDER BY length(term) DESC, term LIMIT 12),
{sql_bm25({'text': 1.0}).replace('q(term) AS (VALUES ' + SQL_TERMS + ')', 'q AS (SELECT term FROM pick)')},
lex AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 50),
den AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.vec_id AS doc_id, round({SQL_DOT}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b) QUALIFY rank <= 50),
u AS (SELECT *, 0.7 AS w FROM lex UNION ALL SELECT *, 1.0 FROM den) SELECT doc_id, round(sum(w / (10 + rank)), 6) AS score FROM u WHERE doc_id NOT IN (6, 7, 8) GROUP BY doc_id""")
def _(spark, d):
    docs = table(spark, d, "documents")
    own = docs.where("doc_id = 7").select(F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term")).orderBy(F.desc(F.length("term")), "term").limit(12)
    terms = [r.term for r in own.collect()]
    lex = fusion.ranked(text_scores(spark, d, terms), "doc_id", "lexical", 50)
    near = fusion.ranked(dense.knn(table(spark, d, "embeddings"), vector_of(spark, d, 7), 50).withColumnRenamed("vec_id", "doc_id"), "doc_id", "dense", 50)
    out = fusion.rrf([lex, near], "doc_id", {"lexical": 0.7, "dense": 1.0}).where(~F.col("doc_id").isin(6, 7, 8))
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query("doc_search_title", f"""WITH q(term) AS (VALUES ('the'), ('of'), ('anea'), ('erin')), d AS (SELECT doc_id, {sql_tokens("split_part(text, chr(10), 1)")} AS w, {sql_key("split_part(text, chr(10), 1)")} AS t FROM documents),
s AS (SELECT doc_id, sum(CASE WHEN list_contains(w, term) THEN 1.0 WHEN length(term) >= 4 AND len(list_filter(w, lambda x: starts_with(x, term))) > 0 THEN 0.5 ELSE 0 END) + max(CASE WHEN contains(t, 'of the') THEN 3.0 ELSE 0 END) AS p FROM d, q GROUP BY doc_id)
SELECT doc_id, round(p / (1.5 * 4 + 3), 6) AS score FROM s WHERE p > 0""")
def _(spark, d):
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    w = T.tokens(title)
    points = F.when(T.key(title).contains("of the"), 3.0).otherwise(0.0)
    begins = lambda t: F.exists(w, lambda x: F.startswith(x, F.lit(t)))
    for t in ("the", "of", "anea", "erin"):
        near = F.when(begins(t), 0.5).otherwise(0.0) if len(t) >= 4 else F.lit(0.0)
        points = points + F.when(F.array_contains(w, t), 1.0).otherwise(near)
    return table(spark, d, "documents").select("doc_id", F.round(points / 9.0, 6).alias("score")).where("score > 0")


SQL_INTENT = f"CASE WHEN regexp_matches(q, '{T.QUOTED}') THEN 'quote' " + " ".join(f"WHEN regexp_matches({sql_fold('q')}, '{T.intent_pattern(k)}') THEN '{k}'" for k in ("visual", "quote", "temporal")) + " ELSE 'conceptual' END"


@query("intent_classify", f"SELECT conv_id, turn, {SQL_INTENT} AS intent FROM (SELECT conv_id, turn, text AS q FROM conversations WHERE role = 'user')")
def _(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


@query("intent_of_questions", f"WITH w AS (SELECT o_orderkey, ['Lámina del diagrama', '¿Cuándo se escribió?', 'who said it', 'plain ideas', 'a «molinos» b', 'mapas', 'WER SAGTE das', 'siglo XVI'][1 + o_orderkey % 8] || ' ' || o_custkey AS q FROM orders) SELECT o_orderkey, {SQL_INTENT} AS intent FROM w")
def _(spark, d):
    said = ["Lámina del diagrama", "¿Cuándo se escribió?", "who said it", "plain ideas", "a «molinos» b", "mapas", "WER SAGTE das", "siglo XVI"]
    q = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, said)), (1 + F.col("o_orderkey") % 8).cast("int")), "o_custkey")
    return table(spark, d, "orders").select("o_orderkey", T.intent(q).alias("intent"))


@query("lang_detect", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents), m(lang, mark) AS (VALUES " + ", ".join(f"('{g}', '{m}')" for g, ms in sorted(T.MARKS.items()) for m in ms) + """),
c AS (SELECT doc_id, lang, sum(len(list_filter(w, lambda x: x = mark))) AS n FROM w, m GROUP BY doc_id, lang)
SELECT doc_id, max_by(lang, n * 10 - list_position(list_sort([""" + ", ".join(f"'{g}'" for g in T.MARKS) + """]), lang)) FILTER (n >= 2) AS lang_found FROM c GROUP BY doc_id""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language(F.col("text")).alias("lang_found"))


@query("garbage_ratio", r"""WITH c AS (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS seen, length(regexp_replace(text, '[\p{L}\p{N}\s.,;:!?''"()\-]', '', 'g')) AS odd FROM documents) SELECT doc_id, round(CASE WHEN seen > 0 THEN odd / seen ELSE 0 END, 6) AS ratio FROM c""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.garbage_ratio(F.col("text")), 6).alias("ratio"))


@query("token_estimate", r"SELECT doc_id, greatest(ceil(length(text) / 4), ceil(len(regexp_extract_all(text, '\S+')) * 1.3))::BIGINT AS n_estimate FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("n_estimate"))


@query("ndcg_recall_mrr", f"""WITH {sql_bm25({'text': 1.0})}, r AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored),
g AS (SELECT doc_id, quality + (1 - toxic) AS grade FROM labels), j AS (SELECT rank, grade FROM r LEFT JOIN g USING (doc_id)), i AS (SELECT grade, row_number() OVER (ORDER BY grade DESC) AS rank FROM g),
dcg AS (SELECT sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS v FROM j WHERE rank <= 10), ideal AS (SELECT sum((pow(2, grade) - 1) / log2(rank + 1)) AS v FROM i WHERE rank <= 10)
SELECT round((SELECT v FROM dcg) / (SELECT v FROM ideal), 6) AS ndcg, round((SELECT count(*) FROM j WHERE rank <= 20 AND grade >= 2) / (SELECT count(*) FROM g WHERE grade >= 2), 6) AS recall,
 round(coalesce((SELECT 1.0 / min(rank) FROM j WHERE rank <= 10 AND grade >= 2), 0), 6) AS mrr""")
def _(spark, d):
    run = fusion.ranked(text_scores(spark, d, TERMS), "doc_id", "q", 50).select(F.lit(1).alias("query"), "doc_id", "rank")
    grades = table(spark, d, "labels").select(F.lit(1).alias("query"), "doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return metrics.retrieval(run, grades, "doc_id").select(*[F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr")])
