"""SQL names for the engine's functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="place int, start int, end int, fragment string")
class Fragments:
    """Table function: the fragments of a text."""

    def eval(self, text: str):
        from ..operators.structure import fragments

        for i, (a, b) in enumerate(fragments(text or "")):
            yield i, a, b, text[a:b]


@udtf(returnType="kind string, level int, text string")
class HtmlBlocks:
    """Table function: the blocks of a page."""

    def eval(self, html: str):
        from ..sources.documents import from_html

        yield from from_html(html or "")


def register(spark: SparkSession) -> None:
    """Makes ``spelling_key``, ``fragments`` and ``html_blocks`` callable from SQL."""
    from ..operators.normalizer import key_of

    @F.pandas_udf("string")
    def spelling_key(word: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([key_of(w, g) if isinstance(w, str) else None for w, g in zip(word, lang)])

    spark.udf.register("spelling_key", spelling_key)
    spark.udtf.register("fragments", Fragments)
    spark.udtf.register("html_blocks", HtmlBlocks)
