"""Importance resampling towards a target corpus, with a dictionary of distinct features.

1. *Features.*  The runs of 1 to ``longest`` words of every text, as lists by block: a block has one row for
   each of its distinct features, with the documents that hold it and how often.
2. *Dictionary.*  Feature strings are counted over both corpora (partial sums before the shuffle); each distinct
   string is hashed once, and the counts of its bucket are summed over the dictionary.
3. *Gains.*  A bucket's gain is the floor of 1000 times the logarithm of how much likelier it is in the target.
4. *Back.*  Gains join the lists by feature string; products of gain and count are summed by document,
   first within each task.  Features with at least one in ``HOT`` of all occurrences, so at most ``HOT`` of them,
   are broadcast; the lists that are shuffled for the others have no key with more than that share.
5. *Draw.*  Gumbel noise from a hash of the key is added; the documents with the highest scores are drawn.  Ranks come from a
   range-partitioned order: places within a partition plus the sizes of the partitions before it.

Words are maximal runs of letters, digits and characters beyond ASCII, with A-Z lower-cased.
Null and empty texts, and texts without words, have no features and weight 0; a null key is
hashed as the empty string and comes last among equal scores; repeated rows are documents of their own, in any order; an empty
corpus or target counts as one without features; other columns are not looked at and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._postings import heads, postings, terms
from ._store import settled, shuffle_partitions

#: Features broadcast with their gains: those with at least one in so many of all occurrences.
HOT = 10_000


def dictionary(index: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """term, s, t, bucket: every distinct feature of both corpora, counted in each and hashed once."""
    here = terms(index).select("term", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    there = terms(target).select("term", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    return here.unionAll(there).groupBy("term").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("bucket", F.crc32("term") % buckets)


def gains(features: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: one row for each bucket that has a feature."""
    per = features.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_s, all_t = features.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = (F.col("t") + 1.0) * F.lit(float(all_s + buckets)) / ((F.col("s") + 1.0) * F.lit(float(all_t + buckets)))
    return per.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def weights(index: DataFrame, features: DataFrame, buckets: int) -> DataFrame:
    """block, doc, key, size, words, weight of every document."""
    # At most ``buckets`` rows, and at most HOT.
    known = features.where("s > 0").join(F.broadcast(gains(features, buckets)), "bucket").select("term", "s", "gain")
    least = (features.agg(F.sum("s")).first()[0] or 0) / HOT
    hot = F.broadcast(known.where(F.col("s") >= least).drop("s"))
    seen = terms(index).select("block", "term", "held")
    met = seen.join(hot, "term").unionByName(seen.join(hot, "term", "left_anti").join(known.where(F.col("s") < least).drop("s"), "term"))
    none = F.lit(None).cast("long")
    parts = met.select("block", F.explode("held").alias("h"), "gain").select("block", F.shiftright("h", 32).cast("int").alias("doc"), (F.col("h").bitwiseAND(0xFFFFFFFF) * F.col("gain")).alias("weight"), none.alias("key"), none.alias("size"), none.alias("words"))
    whole = heads(index).withColumn("weight", F.lit(0).cast("long"))
    return parts.unionByName(whole).groupBy("block", "doc").agg(*[F.max(c).alias(c) for c in ("key", "size", "words")], F.sum("weight").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: str = "2024", percent: int = 10, least_words: int = 20, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """key, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    Of the N documents with at least ``least_words`` words the floor(percent * N / 100) with the highest scores are drawn.
    """
    index = settled(postings(docs, key, text, longest), "features")
    aim = settled(postings(target.select(F.lit(0).alias("key"), F.col(target_text).alias("text")), "key", "text", longest), "target")
    features = settled(dictionary(index, aim, buckets), "dictionary")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = weights(index, features, buckets).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("out", F.col("words") < least_words)
    # Documents that may be drawn come first; ids that grow by one within a partition number them.
    order = [F.col("out"), F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("block"), F.col("doc")]
    placed = scored.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = settled(placed.select("key", "size", "weight", "score", "out", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("place")), "ordered")
    # One row for each partition.
    sizes = placed.groupBy("part").agg(F.count_if(~F.col("out")).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    drawn = percent * (placed.agg(F.count_if(~F.col("out"))).first()[0] or 0) // 100
    rank = F.col("before") + F.col("place") + 1
    return placed.join(F.broadcast(before), "part").select(F.col("key").alias(key), F.col("size").alias("n_features"), "weight", "score", F.when(~F.col("out") & (rank <= drawn), rank).cast("long").alias("rank"))
