"""What use of a library shows: forgotten documents, gaps, recommendations, alerts, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forgotten(docs: DataFrame, opens: DataFrame, hits: DataFrame, key: str, at: str, cutoff) -> DataFrame:
    """key, last_open, weight: documents not opened since the cutoff (2 + hits) or never (1 + hits)."""
    last = opens.groupBy(key).agg(F.max(at).alias("last_open"))
    n = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_hits"))
    out = docs.select(key).join(last, key, "left").join(n, key, "left").where(F.col("last_open").isNull() | (F.col("last_open") < F.lit(cutoff)))
    return out.select(key, "last_open", (F.when(F.col("last_open").isNull(), 1).otherwise(2) + F.coalesce("n_hits", F.lit(0))).alias("weight"))


def gaps(log: DataFrame, query_key: str, results: str, state: str, confidence: str) -> DataFrame:
    """query_key, n, mean_results: queries that ended empty, in error or with low confidence."""
    bad = (F.col(results) == 0) | (F.col(state) == "error") | (F.col(confidence) == "low")
    return log.where(bad).groupBy(query_key).agg(F.count(F.lit(1)).alias("n"), F.avg(results).alias("mean_results"))


def periods(log: DataFrame, at: str, topic: str, unit: str = "month") -> DataFrame:
    """period, topic, n, share: use of topics over time."""
    n = log.groupBy(F.date_trunc(unit, F.col(at).cast("timestamp")).alias("period"), topic).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("period")))


def changes(before: DataFrame, now: DataFrame, watch: str, key: str, answer: str) -> DataFrame:
    """watch, n_new, answer_changed: what standing queries find that they had not found; a first run (no rows before) is silent."""
    known = before.select(watch).distinct()
    new = now.join(before.select(watch, key), [watch, key], "left_anti").join(known, watch, "left_semi").groupBy(watch).agg(F.count(F.lit(1)).alias("n_new"))
    a = before.groupBy(watch).agg(F.max(answer).alias("_a"))
    b = now.groupBy(watch).agg(F.max(answer).alias("_b"))
    changed = a.join(b, watch).select(watch, (~F.col("_a").eqNullSafe(F.col("_b"))).alias("answer_changed"))
    return changed.join(new, watch, "left").select(watch, F.coalesce("n_new", F.lit(0)).alias("n_new"), "answer_changed").where("n_new > 0 or answer_changed")


def verify_cards(cards: DataFrame, sources: DataFrame, key: str, print_: str, text: str) -> DataFrame:
    """Adds state: verified, changed or orphan, by the digest of the source's present text."""
    now = sources.select(key, F.sha2(F.col(text), 256).alias("_now"))
    return cards.join(now, key, "left").withColumn("state", F.when(F.col("_now").isNull(), "orphan").when(F.col("_now") == F.col(print_), "verified").otherwise("changed")).drop("_now")


def batch_estimate(files: DataFrame, known: DataFrame, print_: str, key: str, kind: str, size: str) -> DataFrame:
    """kind, n, n_new, work: files of a batch, those whose digest is new in the library and first in the batch, and the work they make."""
    first = F.row_number().over(Window.partitionBy(print_).orderBy(key)) == 1
    marked = files.withColumn("_first", first).join(known.select(print_).distinct().withColumn("_known", F.lit(True)), print_, "left")
    fresh = F.col("_first") & F.col("_known").isNull()
    pages = F.when(F.col(kind) != "media", F.greatest(F.lit(1.0), F.col(size) / 50_000)).otherwise(0.0)
    minutes = F.when(F.col(kind) == "media", F.col(size) / 1_000_000).otherwise(0.0)
    return marked.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(fresh).alias("n_new"), F.sum(F.when(fresh, 12 + 0.8 * pages + 11 * minutes).otherwise(0.0)).alias("work"))
