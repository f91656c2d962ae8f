"""Event-time windows, the same code over tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Events with a time stamp that watermarks take; with ``late`` a stream's rows older than that are dropped."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late else out


def counts(events: DataFrame, length: str, slide: str | None, by: list[str], ts: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    """started, by, n, total of every window."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return timed(events, ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("started"), *by, "n", "total")


def sessions(events: DataFrame, by: str, gap: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """by, started, ended (time of the last event), n of every run of events less than ``gap`` apart."""
    s = timed(events, ts, late).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))
    return s.select(by, "started", "ended", "n")
