"""The log of searches: redaction and replay, groups of queries, recommendations, quotas, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import dense, graph


def redacted(log: DataFrame, hidden: Column, columns: list[str]) -> DataFrame:
    """The log with what hidden entries say left out; their rows, times and counts stay."""
    return log.withColumns({c: F.when(~F.coalesce(hidden, F.lit(False)), F.col(c)) for c in columns} | {"redacted": F.coalesce(hidden, F.lit(False))})


def replay(log: DataFrame, user: str, at: str, query: str) -> DataFrame:
    """user, query, last, n: what can be searched again: every wording of a user once (by comparison key), its latest form first."""
    k = T.key(F.col(query))
    rows = log.where(F.col(query).isNotNull() & (k != "")).groupBy(user, k.alias("_k"))
    return rows.agg(F.max_by(query, F.struct(at, query)).alias(query), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).drop("_k")


def query_groups(log: DataFrame, key: str, query: str) -> DataFrame:
    """key, grp (the smallest key in it): queries that share a word of more than three letters, also over others in between."""
    words = log.select(key, F.explode(F.array_distinct(F.filter(T.tokens(F.col(query)), lambda t: F.length(t) > 3))).alias("_w"))
    star = words.join(words.groupBy("_w").agg(F.min(key).alias("_head")), "_w").select(F.col(key).alias("a"), F.col("_head").alias("b")).distinct()
    found = graph.components(star).withColumnRenamed("node", key)
    return log.select(key).distinct().join(found, key, "left").select(key, F.coalesce("component", key).alias("grp"))


def recommendations(queries: DataFrame, centroids: DataFrame, members: DataFrame, opened: DataFrame, key: str, vector: str, cell: str, doc: str, size: str, least: float = 0.3) -> DataFrame:
    """doc, weight, n: documents nobody opened in the groups that queries fall near: 10 for each query, and the group's size / 1000.

    A query counts for its nearest centroid (a bounded table: key, centroid) with a cosine above ``least``.
    """
    near = dense.assign(queries, centroids, key, vector).where(F.col("score") > least).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    rows = members.withColumnRenamed(cell, "cell").join(near, "cell").join(opened.select(doc).distinct(), doc, "left_anti")
    return rows.select(doc, (F.col("n") * 10 + F.col(size) / 1000).alias("weight"), "n")


def lot_states(jobs: DataFrame, lot: str, state: str, quota: int) -> DataFrame:
    """lot, n, n_done, n_failed, n_open, over: the state of each lot's jobs, and whether it is over its quota."""
    count = lambda *s: F.count_if(F.col(state).isin(*s))
    return jobs.groupBy(lot).agg(F.count(F.lit(1)).alias("n"), count("done").alias("n_done"), count("failed").alias("n_failed"), F.count_if(~F.col(state).isin("done", "failed")).alias("n_open"), (F.count(F.lit(1)) > quota).alias("over"))


def progress(steps: DataFrame, job: str, weight: str, done: str) -> DataFrame:
    """job, progress: the weighted mean of how far its steps are, 0 to 1."""
    part = F.least(F.greatest(F.col(done), F.lit(0.0)), F.lit(1.0))
    return steps.groupBy(job).agg((F.sum(F.col(weight) * part) / F.sum(weight)).alias("progress"))


def spelling_scores(words: DataFrame, by: str, wanted: Column, found: Column) -> DataFrame:
    """by, recall, precision of found variants against wanted ones, and the same over all rows (by null): macro rows and the micro row."""
    sums = lambda df, *g: df.groupBy(*g).agg(F.count_if(wanted & found).alias("_both"), F.count_if(wanted).alias("_w"), F.count_if(found).alias("_f"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    each = sums(words, by).unionByName(sums(words).withColumn(by, F.lit(None).cast(words.schema[by].dataType)))
    return each.select(by, share("_both", "_w").alias("recall"), share("_both", "_f").alias("precision"))
