"""Interval joins, as-of joins, gaps and islands, unions and differences of intervals.

Interval joins put each interval into the cells of fixed width that it touches and join on
the cell: rows meet only near each other, and a pair counts in the first cell both share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs whose half-open spans [start, end) meet, within equal ``by``; column names must differ between the sides."""
    x = a.withColumn("_cell", F.explode(_cells(F.col(a_span[0]), F.col(a_span[1]), width)))
    y = b.withColumn("_cell", F.explode(_cells(F.col(b_span[0]), F.col(b_span[1]), width)))
    meet = (F.col(a_span[0]) < F.col(b_span[1])) & (F.col(a_span[1]) > F.col(b_span[0]))
    first = F.floor(F.greatest(a_span[0], b_span[0]) / width) == F.col("_cell")
    return x.join(y, [*by, "_cell"]).where(meet & first).drop("_cell")


def as_of(points: DataFrame, facts: DataFrame, by: list[str], at: str, since: str, value: list[str]) -> DataFrame:
    """For every point the fact with the largest ``since`` at or before it, else nulls: one sort per key, no pairs."""
    pts = points.select(*points.columns, F.col(at).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(facts.schema[v].dataType).alias(f"_{v}") for v in value])
    fcs = facts.select(*[F.col(c) if c in by else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns], F.col(since).alias("_t"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in value])
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = pts.unionByName(fcs)
    seen = F.last(F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{v}").alias(v) for v in value])), ignorenulls=True).over(w)
    return both.withColumn("_f", seen).where("_side = 1").select(*points.columns, *[F.col(f"_f.{v}").alias(v) for v in value])


def nearest(points: DataFrame, facts: DataFrame, by: list[str], at: str, where: str, tolerance: float, key: str) -> DataFrame:
    """For every point the closest fact value within the tolerance (the smaller one at equal distance), else null."""
    pts = points.select(*points.columns, F.col(at).alias("_t"), F.lit(1).alias("_side"))
    fcs = facts.select(*[F.col(c) if c in by else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns], F.col(where).alias("_t"), F.lit(0).alias("_side"))
    both = pts.unionByName(fcs)
    fact = F.when(F.col("_side") == 0, F.col("_t"))
    w = Window.partitionBy(*by).orderBy("_t", "_side")
    down = F.last(fact, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.first(fact, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("_d", down).withColumn("_u", up).where("_side = 1")
    best = F.when(F.col("_u").isNull() | (F.col(at) - F.col("_d") <= F.col("_u") - F.col(at)), F.col("_d")).otherwise(F.col("_u"))
    return out.withColumn("nearest", best).withColumn("nearest", F.when(F.abs(F.col("nearest") - F.col(at)) <= tolerance, F.col("nearest"))).drop("_d", "_u", "_t", "_side")


def islands(rows: DataFrame, by: list[str], n: str) -> DataFrame:
    """Runs of consecutive numbers: by, first, last, size."""
    w = Window.partitionBy(*by).orderBy(n)
    d = rows.select(*by, F.col(n).alias("_n")).distinct().withColumn("_g", F.col("_n") - F.row_number().over(Window.partitionBy(*by).orderBy("_n")))
    del w
    return d.groupBy(*by, "_g").agg(F.min("_n").alias("first"), F.max("_n").alias("last"), F.count(F.lit(1)).alias("size")).drop("_g")


def union(rows: DataFrame, by: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Intervals joined where they overlap or lie at most ``gap`` apart: by, start, end, n."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    return marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_g")


def holes(rows: DataFrame, by: list[str], start: str, end: str, least: float) -> DataFrame:
    """Stretches of at least ``least`` that no interval covers, between the first start and the last end."""
    u = union(rows, by, start, end)
    w = Window.partitionBy(*by).orderBy(start)
    return u.withColumn("hole_from", F.lag(end).over(w)).withColumn("hole_to", F.col(start)).where(F.col("hole_to") - F.col("hole_from") >= least).select(*by, "hole_from", "hole_to")


def difference(a: DataFrame, b: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The parts of ``a``'s union that ``b`` does not cover, by sweeping over all borders."""
    marks = [F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d"))]
    sweep = lambda df, side: df.select(*by, F.explode(F.array(*marks)).alias("m"), F.lit(side).alias("side"))
    each = sweep(a, 0).unionByName(sweep(b, 1)).groupBy(*by, F.col("m.t").alias("t")).agg(F.sum(F.when(F.col("side") == 0, F.col("m.d")).otherwise(0)).alias("da"), F.sum(F.when(F.col("side") == 1, F.col("m.d")).otherwise(0)).alias("db"))
    w = Window.partitionBy(*by).orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    parts = each.withColumn("na", F.sum("da").over(run)).withColumn("nb", F.sum("db").over(run)).withColumn("next", F.lead("t").over(w))
    left = parts.where((F.col("na") > 0) & (F.col("nb") <= 0) & (F.col("next") > F.col("t"))).select(*by, F.col("t").alias(start), F.col("next").alias(end))
    return union(left, by, start, end).drop("n")
