"""Ranked lexical search with hierarchical max trees, best first.

The index is one row for each block of documents and term (see ``_postings``), made once for any number of searches.
For a search the lists of its terms are read; their documents' frequencies give the weights.
Within a block every term has a tree of maxima over ranges of documents: leaves of ``LEAF``
documents, ``FAN`` children to a node.  For each query the bounds of a node's terms are summed; a
heap hands out the node with the highest sum, whose children follow it, and leaves score their documents.
Descent ends when no bound reaches the k-th best score; nodes whose bound equals it are opened, since a tie
can go to a smaller key.  The best k of all blocks, cut to k in every task first, are ranked.

Scores are integers: a term's weight w is floor(1000 ln((2N+2)/(2df+1))); a document of n terms has
m = 100 - 25 + (25 n N) div L, and a term that stands in it tf times adds w * ((10^9 tf) div (1000 tf + 12 m)).

Terms are maximal runs of letters, digits and characters beyond ASCII, with A-Z lower-cased.
Null and empty texts hold no term and are in no result; queries without known terms have no results; repeated rows, of documents and of queries, are rows
of their own; null keys come last among equal scores; empty tables give no rows; other columns are not looked at and may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._postings import heads, postings, terms
from ._store import materialize

LEAF, FAN = 32, 8
#: Bytes of queries searched together, in a block of their own.
QUERY_BYTES = 128 << 10
FOUND = "query_block long, query int, key long, score long, block long, doc int"
_FOUND = pa.schema([("query_block", pa.int64()), ("query", pa.int32()), ("key", pa.int64()), ("score", pa.int64()), ("block", pa.int64()), ("doc", pa.int32())])


class MaxTrees:
    """The trees of all terms of a search over one block of documents."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        """``term``, ``doc``, ``impact``: the entries of the lists, sorted by term and then document."""
        leaf, n = doc // LEAF, max(1, -(-n_docs // LEAF))
        base = np.zeros((n_terms, n), np.int64)
        np.maximum.at(base, (term, leaf), impact)
        self.levels = [base]
        while self.levels[-1].shape[1] > FAN:
            low = self.levels[-1]
            wide = -(-low.shape[1] // FAN) * FAN
            self.levels.append(np.pad(low, ((0, 0), (0, wide - low.shape[1]))).reshape(n_terms, -1, FAN).max(axis=2))
        by = np.argsort(leaf, kind="stable")
        self.term, self.doc, self.impact = term[by], doc[by], impact[by]
        self.first = np.searchsorted(leaf[by], np.arange(n + 1))
        self.times = np.zeros(n_terms, np.int64)

    def best(self, own: np.ndarray, times: np.ndarray, k: int, order: np.ndarray) -> list[tuple[int, int]]:
        """(score, document) of the k best documents for the terms ``own``, each ``times`` over; ties by ``order``."""
        self.times[own] = times
        top, heap = [], []  # the k best so far: (score, -order, document), the worst first
        last = len(self.levels) - 1
        heap += [(-b, last, i) for i, b in enumerate((times @ self.levels[last][own]).tolist()) if b > 0]
        heapq.heapify(heap)
        while heap and (len(top) < k or -heap[0][0] >= top[0][0]):
            _, level, node = heapq.heappop(heap)
            if level:
                a = node * FAN
                for i, b in enumerate((times @ self.levels[level - 1][own, a : a + FAN]).tolist(), a):
                    if b > 0 and (len(top) < k or b >= top[0][0]):
                        heapq.heappush(heap, (-b, level - 1, i))
                continue
            a, b = self.first[node], self.first[node + 1]
            scores = np.zeros(LEAF, np.int64)
            np.add.at(scores, self.doc[a:b] - node * LEAF, self.impact[a:b] * self.times[self.term[a:b]])
            for i in np.flatnonzero(scores >= (top[0][0] if len(top) == k else 1)).tolist():
                d = node * LEAF + i
                found = (int(scores[i]), -int(order[d]), d)
                if len(top) < k:
                    heapq.heappush(top, found)
                elif found > top[0]:
                    heapq.heapreplace(top, found)
        self.times[own] = 0
        return [(s, d) for s, _, d in top]


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The lists of all documents, written to the shared folder."""
    return materialize(postings(docs, key, text), "lists")


def _entries(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and number of every entry of a column of lists."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), flat >> 32, flat & 0xFFFFFFFF


def _searched(k: int, n_docs: int, n_words: int):
    """Searches one block of documents for all blocks of queries that share a term with it."""

    def run(lists: pa.Table, docs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if not lists.num_rows:
            return _FOUND.empty_table()
        docs = docs.sort_by("doc")
        keys, size = docs.column("key").to_pylist(), docs.column("size").to_numpy()
        m = 75 + (25 * size * n_docs) // n_words
        order = np.empty(len(keys), np.int64)
        order[sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0, i))] = np.arange(len(keys))
        block = lists.column("block")[0].as_py()
        asked = lists.column("query_block").to_numpy()
        for q in np.unique(asked):
            t = lists.filter(pa.array(asked == q)).combine_chunks()
            term, doc, tf = _entries(t.column("held"))
            trees = MaxTrees(term, doc, t.column("w").to_numpy()[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])), t.num_rows, len(keys))
            own, query, times = _entries(t.column("queries"))
            by = np.argsort(query, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(query[by])) + 1):
                out += [(int(q), int(query[part[0]]), keys[d], s, block, d) for s, d in trees.best(own[part], times[part], k, order)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND) if out else _FOUND.empty_table()

    return run


def search(lists: DataFrame, queries: DataFrame, k: int = 20, key: str = "item_id", text: str = "text", doc_key: str = "doc_id") -> DataFrame:
    """key, rank, doc_key, score: the k best documents of each query, all with a score above 0 where there are fewer."""
    asked = materialize(postings(queries, key, text, most=QUERY_BYTES), "queries")
    n_docs, n_words = heads(lists).agg(F.count_if(F.col("size") > 0), F.coalesce(F.sum("size"), F.lit(0))).first()
    uses = terms(asked).select(F.col("block").alias("query_block"), "term", F.col("held").alias("queries"))
    df = terms(lists).select("term", F.size("held").cast("long").alias("n")).join(uses.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    w = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    known = materialize(uses.join(df.select("term", w.alias("w")), "term").where("w > 0"), "weights")
    hits = terms(lists).select("block", "term", "held").join(known, "term").select("block", "query_block", "w", "held", "queries")
    found = hits.groupBy("block").cogroup(heads(lists).select(F.col("block").alias("at"), "doc", "key", "size").groupBy("at")).applyInArrow(_searched(k, n_docs, max(1, n_words)), FOUND)
    best = Window.partitionBy("query_block", "query").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "block", "doc")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = heads(asked).select(F.col("block").alias("query_block"), F.col("doc").alias("query"), F.col("key").alias("item"))
    return ranked.join(names, ["query_block", "query"]).select(F.col("item").alias(key), "rank", F.col("key").alias(doc_key), "score")
