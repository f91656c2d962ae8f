"""Fusion of ranked lists and clean-up of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import numbered

# Weight of each route by intent.
INTENT_WEIGHTS = {
    "conceptual": {"lexical": 0.35, "dense": 1.0, "visual": 0.0},
    "visual": {"lexical": 0.35, "dense": 0.6, "visual": 1.0},
    "quote": {"lexical": 1.0, "dense": 0.45, "visual": 0.0},
    "temporal": {"lexical": 0.35, "dense": 1.0, "visual": 0.0},
}


def ranked(scores: DataFrame, key: str, route: str, k: int, score: str = "score", digits: int = 6) -> DataFrame:
    """route, key, rank (from 1) of the k best by score; ties by key."""
    top = scores.select(F.col(key), F.round(score, digits).alias("_s")).orderBy(F.desc("_s"), key).limit(k)
    return top.select(F.lit(route).alias("route"), F.col(key), F.row_number().over(Window.orderBy(F.desc("_s"), key)).alias("rank"))


def rrf(lists: list[DataFrame], key: str, weights: dict[str, float] | None = None, k: int = 10) -> DataFrame:
    """key, score, routes: the sum over lists of weight / (k + rank), ranks from 1; routes of weight 0 give nothing."""
    all_ = reduce(DataFrame.unionByName, lists)
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("route")], F.lit(0.0))
    return all_.withColumn("_w", w).where("_w > 0").groupBy(key).agg(F.sum(F.col("_w") / (k + F.col("rank"))).alias("score"), F.array_join(F.sort_array(F.collect_set("route")), "+").alias("routes"))


def min_max(rows: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``scaled``: 0 for the least, 1 for the largest; a constant list is 1."""
    w = Window.partitionBy(*by) if by else None
    if w is None:
        # The extremes of the whole table are one row: it is joined, not windowed over one task.
        ends = F.broadcast(rows.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi")))
        rows = rows.crossJoin(ends)
    else:
        rows = rows.withColumn("_lo", F.min(score).over(w)).withColumn("_hi", F.max(score).over(w))
    return rows.withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)).drop("_lo", "_hi")


def blend(rows: DataFrame, fused: str, reranked: str, weight: float = 0.8) -> DataFrame:
    return rows.withColumn("score", (1 - weight) * F.col(fused) + weight * F.col(reranked))


def unit_penalty(rows: DataFrame, unit: str, score: str, key: str, factor: float) -> DataFrame:
    """The nth hit in one unit counts ``factor`` to the power of n - 1."""
    n = F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(score), key))
    return rows.withColumn("score_penalised", F.col(score) * F.pow(F.lit(factor), n - 1))


def collapse(rows: DataFrame, identity: Column, order: list[Column], routes: str | None = None) -> DataFrame:
    """The first row of each identity in the given order; with ``routes`` it takes over all routes of its copies."""
    rows = rows.withColumn("_id", identity)
    w = Window.partitionBy("_id").orderBy(*order)
    out = rows.withColumn("_n", F.row_number().over(w))
    if routes:
        out = out.withColumn(routes, F.array_join(F.sort_array(F.collect_set(routes).over(Window.partitionBy("_id"))), "+"))
    return out.where("_n = 1").drop("_n", "_id")


def interleave(lists: DataFrame, key: str, list_col: str = "route", rank: str = "rank") -> DataFrame:
    """Round-robin merge of ranked lists: by rank, then list; the first place of a key counts."""
    first = lists.groupBy(key).agg(F.min(F.struct(rank, list_col)).alias("_p"))
    return numbered(first.select(key, F.col(f"_p.{rank}").alias("round"), F.col(f"_p.{list_col}").alias("from_list")), "place", "round", "from_list")


def literal_first(exact: DataFrame, similar: DataFrame, key: str) -> DataFrame:
    """Exact hits before similar ones: scores 2 - i/1000 and 1 - i/1000 by place in their list."""
    a = exact.select(key, (2 - (F.col("rank") - 1) * 1e-3).alias("score"), F.lit("exact").alias("tier"))
    b = similar.join(exact.select(key), key, "left_anti").select(key, (1 - (F.col("rank") - 1) * 1e-3).alias("score"), F.lit("similar").alias("tier"))
    return a.unionByName(b)


def adjacent_merge(rows: DataFrame, doc: str, order: str, score: str) -> DataFrame:
    """Of neighbouring fragments in a document the best stays (greedy by score): grouped by document."""
    kept_schema = rows.schema

    def one(pdf):
        taken: set[int] = set()
        keep = []
        for i, r in pdf.sort_values([score, order], ascending=[False, True]).iterrows():
            if not ({r[order] - 1, r[order] + 1} & taken):
                keep.append(i)
                taken.add(r[order])
        return pdf.loc[keep]

    return rows.groupBy(doc).applyInPandas(one, kept_schema)
