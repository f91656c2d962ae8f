"""Speakers, turns, sentences and units of timed or turn-based transcripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turns(rows: DataFrame, by: str, at: str, speaker: str, text: str) -> DataFrame:
    """by, turn_no, speaker, first, last, n, text: neighbouring rows of one speaker joined."""
    w = Window.partitionBy(by).orderBy(at)
    new = F.when(F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    g = rows.withColumn("_new", new).withColumn("turn_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, text))), lambda x: x[text]), " ")
    return g.groupBy(by, "turn_no", speaker).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"), joined.alias("text"))


def shares(rows: DataFrame, by: str, speaker: str, text: str) -> DataFrame:
    """by, speaker, n_words, share: words of each speaker over all words of the whole."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda x: x != ""))
    s = rows.groupBy(by, speaker).agg(F.sum(words).cast("long").alias("n_words"))
    total = F.sum("n_words").over(Window.partitionBy(by))
    return s.withColumn("share", F.when(total > 0, F.col("n_words") / total).otherwise(0.0))


def sentence_numbers(words: DataFrame, by: str, t0: str, t1: str, word: str, speaker: str, soft: float = 0.7, hard: float = 2.5) -> DataFrame:
    """Adds sentence: a new one after closing punctuation, at another speaker, at a pause (``hard`` always, ``soft`` after an unpunctuated word at its end)."""
    w = Window.partitionBy(by).orderBy(t0, t1)
    pause = F.col(t0) - F.lag(t1).over(w)
    ended = F.lag(word).over(w).rlike(r"[.!?…][\"'»”)]*$")
    new = F.lag(word).over(w).isNull() | ended | (F.col(speaker) != F.lag(speaker).over(w)) | (pause > hard) | ((pause > soft) & F.col(word).rlike(r"^\p{Lu}"))
    return words.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("sentence", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def time_units(sents: DataFrame, by: str, t0: str, t1: str, speaker: str, least: float = 30.0, most: float = 60.0) -> DataFrame:
    """Adds unit: sentences packed greedily into units of ``least`` to ``most`` seconds, closed early at a change of speaker; a short tail joins the unit before."""
    schema = sents.schema.simpleString()[7:-1].replace(":", " ") + ", unit int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([t0, t1])
        unit, start, out, who = 0, None, [], None
        for a, b, s in zip(pdf[t0], pdf[t1], pdf[speaker]):
            if start is not None and (b - start > most or (a - start >= least and s != who)):
                unit, start = unit + 1, None
            start = a if start is None else start
            who = s
            out.append(unit)
        last = pdf[t1].iloc[-1] - pdf[t0].iloc[out.index(out[-1])]
        if out[-1] > 0 and last < least / 2:
            out = [u - (u == out[-1]) for u in out]
        return pdf.assign(unit=out)

    return sents.groupBy(by).applyInPandas(one, schema)
