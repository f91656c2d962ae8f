"""The training-corpus pipeline: five stages over ``documents``, each on what the one before it kept.

All stages but the last return the columns they are given, whatever their names.  Null texts count as empty, a null
key is a key of its own; repeated rows are judged alike, and the Jaccard stage keeps one of those that have
words; empty tables give no rows.  Each stage says below what that means for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libralake.llm import decontaminate, ngram_join, quality, secrets, word_bpe
from libralake.llm._store import materialize
from libralake.llm.queries import in_fold, table, tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more stay.

    Null and empty texts have a score like others.  Without labels, or with labels of one kind, the score is that
    kind's share for all: 0.5 without any, so that nothing stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, in_fold(F.col("doc_id")))
    return quality.good(docs, model, least=0.7)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the smallest doc_id, null last.

    Null texts and texts without words link with nothing and all stay.
    """
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null texts contain none, and items without words are in none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text: owner-specific ones as ``[secret]``, widely copied ones as ``[example]``; all documents stay.

    A null text stays null; a null source is an owner of its own.
    """
    return secrets.masked(docs, repo=F.col("doc_id"), owner=F.col("source"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document that is left; null texts have no ids and the empty text."""
    return word_bpe.encode(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encoding),
]

#: Learned scores and token ids have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written once in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
