"""Inverted lists, BM25 over weighted columns, phrases and query terms.

Without an index, lists are built from the query's terms only: other words are dropped before anything is
counted or shuffled, so that frequent words cost nothing unless a query has them.  ``build`` stores all
lists once, dealt and sorted by term; ``Index.search`` then reads the row groups of its terms and no text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """key, column, term, position: every word of every column."""
    parts = [docs.select(F.col(key), F.lit(name).alias("column"), F.posexplode(T.tokens(c)).alias("position", "term")) for name, c in columns.items()]
    return reduce(DataFrame.unionByName, parts)


def term_frequencies(docs: DataFrame, key: str, columns: dict[str, Column], terms: list[str] | None = None) -> DataFrame:
    """key, column, term, tf; only the given terms where there are any.

    The words of a row are counted inside the row, so nothing is shuffled.
    """
    out = []
    for name, c in columns.items():
        toks = T.tokens(c)
        if terms is None:
            counted = docs.select(F.col(key), F.lit(name).alias("column"), F.explode(toks).alias("term")).groupBy(key, "column", "term").agg(F.count(F.lit(1)).alias("tf"))
        else:
            pairs = F.array(*[F.struct(F.lit(t).alias("term"), T.count_of(F.col("_t"), F.lit(t)).cast("long").alias("tf")) for t in terms])
            counted = docs.select(F.col(key), toks.alias("_t")).select(key, F.lit(name).alias("column"), F.explode(F.filter(pairs, lambda p: p["tf"] > 0)).alias("p")).select(key, "column", "p.term", "p.tf")
        out.append(counted)
    return reduce(DataFrame.unionByName, out)


def bm25(docs: DataFrame, query: str | list[str], key: str = "doc_id", columns: dict[str, Column] | None = None, weights: dict[str, float] | None = None, every: bool = False) -> DataFrame:
    """key, score of the documents that have a term (with ``every``: all terms) of the query.

    One BM25 over weighted columns: frequencies and lengths are sums over the columns with their
    weights, a term's document frequency counts documents that have it in any column.
    """
    columns = columns or {"text": F.col("text")}
    weights = weights or dict.fromkeys(columns, 1.0)
    terms = query if isinstance(query, list) else query_terms(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    # Words are made once for each row, in a step of their own.
    words = T.computed(docs, [key], **{f"_t{i}": T.tokens(c) for i, c in enumerate(columns.values())})
    shares = [(weights[name], F.col(f"_t{i}")) for i, name in enumerate(columns)]
    tf = F.array(*[reduce(lambda a, b: a + b, [w * T.count_of(toks, F.lit(t)) for w, toks in shares]) for t in terms])
    length = reduce(lambda a, b: a + b, [w * F.size(toks) for w, toks in shares])
    rows = T.computed(words, [key], _tf=tf, _len=length)
    # One row: number of documents, mean length, document frequency of each term.
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col("_tf")[i] > 0).alias(f"_df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col("_tf")[i], F.col(f"_df{i}")
        idf = F.greatest(F.ln((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    has = (lambda a, f: F.forall(a, f)) if every else (lambda a, f: F.exists(a, f))
    return rows.where(has("_tf", lambda x: x > 0)).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))


def query_terms(query: str, most: int = 32) -> list[str]:
    """Distinct terms of a query without function words; with them where there are no others."""
    import re
    import unicodedata

    plain = query.lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))
    words = [w for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFC", plain)) if len(w) >= 2]
    out = list(dict.fromkeys(w for w in words if w not in T.STOPWORDS)) or list(dict.fromkeys(words))
    return out[:most]


def phrase(docs: DataFrame, words: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Documents in which the words stand next to each other, with the number of places."""
    toks = F.concat(F.lit(" "), F.array_join(T.tokens(F.col(column)), "  "), F.lit(" "))
    needle = " " + "  ".join(query_terms_all(words)) + " "
    hits = (F.length("_s") - F.length(F.replace(F.col("_s"), F.lit(needle), F.lit("")))) / len(needle)
    return T.computed(docs, [key], _s=toks).select(key, hits.cast("long").alias("n_hits")).where("n_hits > 0")


def query_terms_all(words: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", words.lower().translate(str.maketrans(T.ACCENTED, T.PLAIN)))


def all_phrases(docs: DataFrame, phrases: list[str], key: str = "doc_id", column: str = "text") -> DataFrame:
    """Documents that have every one of the phrases, with the number of all places; each text is read once."""
    toks = F.concat(F.lit(" "), F.array_join(T.tokens(F.col(column)), "  "), F.lit(" "))
    needles = [" " + "  ".join(w) + " " for p in phrases if (w := query_terms_all(p))]
    if not needles:
        return docs.select(key, F.lit(0).cast("long").alias("n_hits")).limit(0)
    count = lambda n: ((F.length("_s") - F.length(F.replace(F.col("_s"), F.lit(n), F.lit("")))) / len(n)).cast("long")
    found = T.computed(T.computed(docs, [key], _s=toks), [key], _n=F.array(*map(count, needles)))
    return found.where(F.forall("_n", lambda n: n > 0)).select(key, F.aggregate("_n", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_hits"))


def any_phrases(docs: DataFrame, groups: list[list[tuple[str, str]]], key: str = "doc_id") -> DataFrame:
    """Documents that have, for every group of (column, phrase), one of its phrases in its column, with the number of all places; each column is read once."""
    groups = [[(c, w) for c, p in g if (w := query_terms_all(p))] for g in groups]
    groups = [g for g in groups if g]
    if not groups:
        return docs.select(key, F.lit(0).cast("long").alias("n_hits")).limit(0)
    names = sorted({c for g in groups for c, _ in g})
    words = T.computed(docs, [key], **{f"_{c}": F.concat(F.lit(" "), F.array_join(F.coalesce(T.tokens(F.col(c)), F.array().cast("array<string>")), "  "), F.lit(" ")) for c in names})

    def count(column: str, phrase: list[str]) -> Column:
        needle = " " + "  ".join(phrase) + " "
        return ((F.length(f"_{column}") - F.length(F.replace(F.col(f"_{column}"), F.lit(needle), F.lit("")))) / len(needle)).cast("long")

    found = T.computed(words, [key], _n=F.array(*[reduce(lambda a, b: a + b, [count(c, w) for c, w in g]) for g in groups]))
    return found.where(F.forall("_n", lambda n: n > 0)).select(key, F.aggregate("_n", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_hits"))


@dataclass(frozen=True)
class Index:
    """Stored lists of a table of documents: postings (term, key, tf and length of each column) and one row of totals."""

    spark: SparkSession
    path: str
    key: str
    columns: tuple[str, ...]

    def search(self, terms: list[str], weights: dict[str, float] | None = None, every: bool = False, prefix: str | None = None, also: dict[str, list[str]] | None = None, also_in: str = "normalised") -> DataFrame:
        """key, score as ``bm25`` gives it; ``prefix`` is one more term that stands for all words it begins.

        ``also`` has other words for a term, each a term of its own in the score but looked for in the column ``also_in`` only;
        with ``every`` a document needs, for each term, the term or one of its other words.
        """
        w = [(weights or {}).get(c, 1.0) for c in self.columns]
        terms = [t for t in terms if t != prefix]
        # What a word of the lists stands for: a label, the term it counts for, whether in one column only.
        asked = [(t, t, t, False) for t in terms] + [(v, f"{v} for {t}", t, True) for t in terms if also for v in also.get(t, ())]
        label = lambda q, g, only: F.struct(F.lit(q).alias("q"), F.lit(g).alias("g"), F.lit(only).alias("only"))
        words = sorted({a[0] for a in asked})
        want = F.col("term").isin(words) if words else F.lit(False)
        hits = [F.when(F.col("term") == word, label(q, g, only)) for word, q, g, only in asked]
        if prefix:
            # A range of terms, which the sorted files are skipped by.
            inside = (F.col("term") >= prefix) & (F.col("term") < prefix + "\U0010ffff")
            want = want | inside
            hits.append(F.when(inside & ~F.col("term").isin(terms) if terms else inside, label(prefix + "*", prefix + "*", False)))
        if not hits:
            return self.spark.read.parquet(f"{self.path}/postings").select(self.key, F.lit(0.0).alias("score")).limit(0)
        total = lambda arr: reduce(lambda a, b: a + b, [F.lit(x) * F.col(arr)[i] for i, x in enumerate(w)])
        one = F.lit(w[self.columns.index(also_in)]) * F.col("tf")[self.columns.index(also_in)] if also_in in self.columns else F.lit(0.0)
        rows = self.spark.read.parquet(f"{self.path}/postings").where(want).withColumn("_a", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
        rows = rows.select(self.key, F.col("_a.q").alias("_q"), F.col("_a.g").alias("_g"), F.when(F.col("_a.only"), one).otherwise(total("tf")).alias("_tf"), total("len").alias("_len"))
        rows = rows.groupBy(self.key, "_q", "_g").agg(F.sum("_tf").alias("_tf"), F.first("_len").alias("_len")).where("_tf > 0")
        # At most one row for each word asked for, and one row of totals.
        df = rows.groupBy("_q").agg(F.count(F.lit(1)).alias("_df"))
        stats = self.spark.read.parquet(f"{self.path}/totals").select(F.col("n").alias("_n"), (total("len") / F.col("n")).alias("_avg"))
        idf = F.greatest(F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(1e-6))
        score = idf * F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
        found = rows.join(F.broadcast(df), "_q").crossJoin(F.broadcast(stats)).groupBy(self.key).agg(F.sum(score).alias("score"), F.countDistinct("_g").alias("_c"))
        return found.where(F.col("_c") == len(terms) + bool(prefix)).drop("_c") if every else found.drop("_c")


def build(docs: DataFrame, path: str, key: str = "doc_id", columns: dict[str, Column] | None = None, partitions: int | None = None) -> Index:
    """Stores the lists of all words of the columns under ``path``.

    The words of a document are counted where it is read; lists are dealt by ranges of the term, which splits no
    file by hand and leaves every file with a narrow range of terms.
    """
    columns = columns or {"text": F.col("text")}
    spark, names = docs.sparkSession, tuple(columns)
    words = T.computed(docs, [key], **{f"_t{i}": F.coalesce(T.tokens(c), F.array().cast("array<string>")) for i, c in enumerate(columns.values())})
    lens = F.array(*[F.size(f"_t{i}") for i in range(len(names))])
    named = lambda i: F.transform(f"_t{i}", lambda t: F.struct(t.alias("term"), F.lit(i).alias("c")))
    each = F.explode(F.flatten(F.array(*map(named, range(len(names))))))
    rows = words.select(key, lens.alias("len"), each.alias("_e")).groupBy("_e.term", key, "len").agg(F.array(*[F.count_if(F.col("_e.c") == i).cast("int") for i in range(len(names))]).alias("tf"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows.repartitionByRange(n, "term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/postings")
    sums = words.select(lens.alias("len")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("len")[i]) for i in range(len(names))]).alias("len"))
    sums.write.mode("overwrite").parquet(f"{path}/totals")
    return Index(spark, path, key, names)
