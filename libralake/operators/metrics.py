"""Retrieval and citation metrics over ranked runs and graded judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval(run: DataFrame, grades: DataFrame, key: str, query: str = "query", at: int = 10, recall_at: int = 20, good: int = 2) -> DataFrame:
    """Per query: ndcg at ``at`` (gain 2^g - 1, unjudged 0), recall at ``recall_at``, reciprocal rank of the first good hit, judged share."""
    gain = lambda g: F.pow(F.lit(2.0), F.coalesce(g, F.lit(0))) - 1
    hits = run.join(grades, [query, key], "left")
    seen = hits.groupBy(query).agg(
        F.sum(F.when(F.col("rank") <= at, gain(F.col("grade")) / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.count_if((F.col("rank") <= recall_at) & (F.col("grade") >= good)).alias("found"),
        F.coalesce(1.0 / F.min(F.when((F.col("rank") <= at) & (F.col("grade") >= good), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.avg(F.when(F.col("rank") <= at, F.col("grade").isNotNull().cast("double"))).alias("judged"),
    )
    w = Window.partitionBy(query).orderBy(F.desc("grade"), key)
    best = grades.withColumn("_r", F.row_number().over(w)).groupBy(query).agg(F.sum(F.when(F.col("_r") <= at, gain(F.col("grade")) / F.log2(F.col("_r") + 1))).alias("ideal"), F.count_if(F.col("grade") >= good).alias("all_good"))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return seen.join(best, query).select(query, zero(F.col("dcg"), F.col("ideal")).alias("ndcg"), zero(F.col("found"), F.col("all_good")).alias("recall"), "mrr", "judged")


def citation_scores(claims: DataFrame, cited: DataFrame, gold: DataFrame, claim: str, source: str) -> DataFrame:
    """One row: precision, recall, invented (citations of sources that no claim has as gold)."""
    good = cited.join(gold, [claim, source], "left_semi")
    counts = [(cited.select(claim, source).distinct(), "n_cited"), (good.select(claim, source).distinct(), "n_good"), (gold.join(claims, claim, "left_semi").select(claim, source).distinct(), "n_gold"), (cited.join(gold.select(source).distinct(), source, "left_anti"), "invented")]
    out = None
    for df, name in counts:
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.select(F.when(F.col("n_cited") > 0, F.col("n_good") / F.col("n_cited")).alias("precision"), F.when(F.col("n_gold") > 0, F.col("n_good") / F.col("n_gold")).alias("recall"), "invented")


def pool(runs: DataFrame, key: str, n: int, query: str = "query") -> DataFrame:
    """Distinct documents among the first ``n`` of any run of a query."""
    return runs.where(F.col("rank") <= n).select(query, key).distinct()


def bag_f1(a: DataFrame, b: DataFrame, id_: str, terms: str) -> DataFrame:
    """F1 of two texts as bags of words, per id."""
    bag = lambda df, n: df.select(id_, F.explode(terms).alias("_t")).groupBy(id_, "_t").agg(F.count(F.lit(1)).alias(n))
    both = bag(a, "na").join(bag(b, "nb"), [id_, "_t"], "full").groupBy(id_).agg(F.sum(F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))).alias("c"), F.sum(F.coalesce("na", F.lit(0))).alias("na"), F.sum(F.coalesce("nb", F.lit(0))).alias("nb"))
    return both.select(id_, F.when(F.col("na") + F.col("nb") > 0, 2 * F.col("c") / (F.col("na") + F.col("nb"))).otherwise(0.0).alias("f1"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """Percentiles by nearest rank: the element at ceil(p/100 n); per group, from a sort within the group."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    placed = rows.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w)).withColumn("_n", n)
    return placed.groupBy(*by).agg(*[F.max(F.when(F.col("_r") == F.greatest(F.ceil(F.lit(p) * F.col("_n") / 100), F.lit(1)), F.col(value))).alias(f"p{p}") for p in percents])
