"""Registration of queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import ACCENTED, PLAIN, STOPWORDS
from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Work on texts is heavy for its rows: small files are dealt to all cores.
    return spread(df) if name in ("documents", "pages", "conversations") else df


def sql_fold(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({sql_fold(x)}, '[\\p{{L}}\\p{{N}}]+')"


def sql_key(x: str) -> str:
    return f"trim(regexp_replace({sql_fold(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


SQL_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
