"""The engine's front: a shelf of tables that can be searched, cited and asked."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import citations, dense, filters, fusion, lexical, normalizer, passages, structure


def hash_embedding(text: str, dims: int = 64) -> list[float]:
    """Deterministic embedding without a model: each folded word adds to two buckets; scaled to length 1."""
    v = np.zeros(dims)
    for w in lexical.query_terms_all(text):
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        v[h[0] % dims] += 1.0
        v[int.from_bytes(h[1:3], "big") % dims] += 1.0
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def overlap_rerank(query: str, texts: pd.Series) -> pd.Series:
    """Deterministic reranker without a model: the share of the query's terms that a text has."""
    terms = set(lexical.query_terms(query))
    return texts.map(lambda t: len(terms & set(lexical.query_terms_all(t or ""))) / max(1, len(terms)))


@dataclass
class Ports:
    """Models as functions; the defaults are deterministic and need none."""

    embed: Callable[[str], list[float]] = hash_embedding
    rerank: Callable[[str, pd.Series], pd.Series] = overlap_rerank
    judge: Callable[[str, pd.Series], pd.Series] | None = None


@dataclass
class Library:
    """``fragments``: key, doc, place, text and, where texts may be in old spelling, shadow; ``vectors``: key, vector; ``documents``: doc and metadata.

    With an ``index`` (see ``indexed``) searches read the lists of their terms; without one they read the texts.
    """

    fragments: DataFrame
    vectors: DataFrame | None = None
    documents: DataFrame | None = None
    key: str = "key"
    ports: Ports = field(default_factory=Ports)
    index: lexical.Index | None = None

    @staticmethod
    def of_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", ports: Ports | None = None, lang: str | None = None, year: str | None = None) -> Library:
        """A library of the fragments of a table of documents, embedded by the port.

        With the column ``lang`` (and ``year``) fragments in old spelling get a shadow that modern words find.
        """
        ports = ports or Ports()
        frags = structure.chunk(docs, key, text).select(F.concat_ws(":", key, "place").alias("key"), F.col(key).alias("doc"), "place", F.col("fragment").alias("text"))
        embed = ports.embed

        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: embed(t or ""))

        # Equal pieces are embedded once.
        pieces = frags.select("text").distinct().select("text", run("text").alias("vector"))
        if lang:
            own = docs.select(F.col(key).alias("doc"), F.col(lang).alias("lang"), (F.col(year) if year else F.lit(None)).cast("int").alias("year"))
            frags = frags.join(normalizer.shadowed(frags.join(own, "doc"), "key", "text", "lang", "year"), "key")
        return Library(frags, frags.join(pieces, "text").select("key", "vector"), docs.withColumnRenamed(key, "doc"), "key", ports)

    def indexed(self, path: str) -> Library:
        """The same library with the lists of its fragments, texts and shadows, stored under ``path``."""
        columns = {"text": F.col("text")} | ({"normalised": F.col("shadow")} if "shadow" in self.fragments.columns else {})
        return replace(self, index=lexical.build(self.fragments, path, self.key, columns))

    def _lexical(self, terms: list[str], frags: DataFrame, limited: bool) -> DataFrame:
        """key, score by words: their old spellings too, where there is a stored shadow."""
        if self.index is None:
            return lexical.bm25(frags, terms, self.key)
        also = {t: [v for v in normalizer.variants(t) if " " not in v] for t in terms} if "normalised" in self.index.columns else None
        found = self.index.search(terms, {"text": 1.0, "normalised": 0.9}, also=also)
        return found.join(frags.select(self.key), self.key, "left_semi") if limited else found

    def _quoted(self, quotes: list[str], frags: DataFrame) -> DataFrame:
        """Fragments that have every quotation, as it is or as its words stand in a shadow."""
        old = "shadow" in frags.columns
        groups = [[("text", q), *[("shadow", v) for v in (q, *normalizer.variants(q)) if old]] for q in quotes]
        return lexical.any_phrases(frags, groups, self.key)

    def analyse(self, query: str) -> dict:
        """Intent, terms, quotations and filters said in the query."""
        spark = self.fragments.sparkSession
        q = F.col("q")
        low, high = filters.said_years(q)
        r = spark.createDataFrame([(query,)], "q string").select(T.intent(q).alias("intent"), T.quoted(q).alias("quotes"), low.alias("low"), high.alias("high"), filters.said_page(q).alias("page")).first()
        return r.asDict() | {"terms": lexical.query_terms(query)}

    def search(self, query: str, limit: int = 10, pool: int = 60, **allowed) -> DataFrame:
        """key, doc, place, score, routes, marked: hybrid search with fusion, duplicates out, reranked, with a marked window.

        Only the two routes read the corpus; what follows works on ``2 * pool`` fragments at most.
        """
        asked = self.analyse(query)
        frags = self.fragments
        if allowed:
            docs = filters.allowed(self.documents, key="doc", **allowed).select("doc")
            frags = frags.join(docs, "doc", "left_semi")
        lists = [fusion.ranked(self._lexical(asked["terms"], frags, bool(allowed)), self.key, "lexical", pool)]
        if self.vectors is not None:
            vectors = self.vectors if not allowed else self.vectors.join(frags.select(self.key), self.key, "left_semi")
            lists.append(fusion.ranked(dense.knn(vectors, self.ports.embed(query), pool, self.key, "vector"), self.key, "dense", pool))
        if asked["quotes"]:
            exact = fusion.ranked(self._quoted(asked["quotes"], frags).withColumnRenamed("n_hits", "score"), self.key, "quote", pool)
            lists = [exact.withColumn("route", F.lit("lexical")), *lists[1:]]
        fused = fusion.rrf(lists, self.key, fusion.INTENT_WEIGHTS[asked["intent"]]).orderBy(F.desc("score"), self.key).limit(2 * pool)
        hits = F.broadcast(fused).join(frags, self.key)
        identity = F.when(F.length(T.key(F.col("text"))) >= 40, F.substring(T.key(F.col("text")), 1, 200)).otherwise(F.col(self.key).cast("string"))
        hits = fusion.collapse(hits, identity, [F.desc("score"), F.col(self.key)])
        rerank, schema = self.ports.rerank, "double"

        @F.pandas_udf(schema)
        def score(s: pd.Series) -> pd.Series:
            return rerank(query, s)

        ranked = fusion.blend(fusion.min_max(hits, "score").withColumn("rr", score(F.substring("text", 1, 2000))), "scaled", "rr")
        if self.ports.judge:
            judge = self.ports.judge

            @F.pandas_udf("double")
            def probability(s: pd.Series) -> pd.Series:
                return judge(query, s)

            ranked = ranked.withColumn("p", probability("text")).where("p >= 0.15").withColumn("score", 0.5 * F.col("score") + 0.5 * F.col("p"))
        wanted = asked["terms"] or ["\u0000"]

        @F.pandas_udf("string")
        def window(s: pd.Series) -> pd.Series:
            return s.fillna("").map(lambda t: t[slice(*passages.best_window(t, set(wanted)))])

        out = ranked.select(self.key, "doc", "place", F.round("score", 6).alias("score"), "routes", passages.marked(window("text"), wanted).alias("marked"))
        return out.orderBy(F.desc("score"), self.key).limit(limit)

    def cite(self, claim: str, limit: int = 5) -> DataFrame:
        """Candidates for a claim with score and decision; support comes from the reranker."""
        found = self.search(claim, limit).withColumnRenamed("score", "support")
        rows = found.withColumns({"kind": F.lit("direct"), "contra": F.lit(False), "plausible": F.lit("plausible"), "negative": citations.is_negative(F.lit(claim))})
        return citations.decide(rows, "support", "kind", "contra", "plausible", "negative").select(self.key, "doc", "place", "score", "decision")

    def more_like(self, key: str, limit: int = 10) -> DataFrame:
        """Fragments like one of the library, itself and its neighbours left out."""
        own = self.fragments.where(F.col(self.key) == key).first()
        terms = sorted(set(lexical.query_terms(own.text, 10_000)), key=lambda t: (-len(t), t))[:12]
        lists = [fusion.ranked(self._lexical(terms, self.fragments, False), self.key, "lexical", 60)]
        if self.vectors is not None:
            v = self.vectors.where(F.col(self.key) == key).first()
            lists.append(fusion.ranked(dense.knn(self.vectors, list(v.vector), 60, self.key, "vector"), self.key, "dense", 60))
        near = fusion.rrf(lists, self.key, {"lexical": 0.7, "dense": 1.0})
        hits = F.broadcast(near).join(self.fragments, self.key).where(~((F.col("doc") == F.lit(own.doc)) & (F.abs(F.col("place") - own.place) <= 1)))
        return hits.select(self.key, "doc", "place", F.round("score", 6).alias("score")).orderBy(F.desc("score"), self.key).limit(limit)

    def layered(self, query: str, cards: DataFrame, limit: int = 10) -> DataFrame:
        """Fragments and analysis cards (key, text) in one list: each layer's scores over its best, cards count 0.8."""
        mine = self.search(query, limit).select(F.col(self.key).alias("id"), "score", F.lit("text").alias("layer"))
        other = lexical.bm25(cards, query, "key").select(F.col("key").alias("id"), "score", F.lit("card").alias("layer"))
        both = mine.unionByName(other)
        # One row for each layer.
        top = F.broadcast(both.groupBy("layer").agg(F.max("score").alias("_top")))
        weight = F.when(F.col("layer") == "card", 0.8).otherwise(1.0)
        scaled = both.join(top, "layer").withColumn("score", F.round(weight * F.col("score") / F.greatest("_top", F.lit(1e-9)), 6))
        return scaled.select("id", "score", "layer").orderBy(F.desc("score"), "id").limit(limit)
