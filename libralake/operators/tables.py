"""Table maintenance as plain DataFrame rewrites: upserts, diffs, cascades, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one that comes last; partial maxima before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def cascade_delete(tables: dict[str, DataFrame], document: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the given documents."""
    return {name: df.join(document.select(key), key, "left_anti") for name, df in tables.items()}


def reconcile(old: DataFrame, new: DataFrame, evaluated: DataFrame, keys: list[str], made_by_user: str, created: str) -> DataFrame:
    """New relations replace detected ones within the evaluated keys; those made by users and creation dates stay."""
    kept = old.join(evaluated.select(*keys).distinct(), keys, "left_anti").unionByName(old.where(made_by_user).join(evaluated.select(*keys).distinct(), keys, "left_semi")).distinct()
    dates = old.select(*keys, F.col(created).alias("_c"))
    fresh = new.join(old.where(made_by_user).select(*keys), keys, "left_anti").join(dates, keys, "left").withColumn(created, F.coalesce("_c", created)).drop("_c")
    return kept.unionByName(fresh)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: the manifest of an export."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def fingerprint(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, print: changes when any of the columns of any row of a key does, whatever the order."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return rows.groupBy(*keys).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.sum(h)), 256).alias("print"))


def next_free_suffix(rows: DataFrame, base: str, order: list[str], out: str) -> DataFrame:
    """Unique keys: the second and later rows of one base get b, c, … after it."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    many = F.count(F.lit(1)).over(Window.partitionBy(base))
    letter = F.when(n <= 26, F.char(F.lit(96) + n)).otherwise(F.concat(F.lit("z"), n.cast("string")))
    return rows.withColumn(out, F.when(many > 1, F.concat(base, letter)).otherwise(F.col(base)))


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds the place of every row, from 1, in an order over the whole table, without a task that sees all rows.

    Rows are dealt by ranges of the order and numbered within a range; the sizes of the ranges before it, one row a partition, are added.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    path = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path).withColumn("_p", F.shiftright("_i", 33))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(before, F.lit(0)).alias("_b"))
    return dealt.join(F.broadcast(sizes), "_p").withColumn(name, (F.col("_b") + F.col("_i").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("_p", "_i", "_b")
