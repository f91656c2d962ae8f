"""The ``opN_*`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import decontaminate, fingerprints, html_text, licenses, ngram_join, quality, ranked_search, resample, secrets, substring_dedup, suffix_dedup, token_counts, word_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    return importlib.import_module("public_tokenizers").path(name)


def in_fold(key) -> F.Column:
    """Whether a label row may be learned from: crc32 of the key as text, modulo 4, is not 2."""
    return F.crc32(key.cast("string")) % 4 != 2


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.successions(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, repo=F.col("doc_id"), owner=F.col("source"))
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "verdicts", "n_live", "n_shared", "n_copied", "n_repos")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), in_fold(F.col("doc_id")))
    return quality.score(docs, model).select("doc_id", (~in_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {
    "op1_substring_dedup": op1,
    "op2_document_fingerprints": op2,
    "op3_bpe_encoding": op3,
    "op4_secret_scan": op4,
    "op5_html_extraction": op5,
    "op6_quality_classifier": op6,
    "op7_benchmark_decontamination": op7,
    "op8_ngram_jaccard_join": op8,
    "op9_token_counts": op9,
    "op10_license_scan": op10,
    "op11_resample": op11,
    "op12_ranked_search": op12,
    "op13_suffix_dedup": op13,
}


def _license_sql() -> str:
    """The licence scan in DuckDB's SQL, from the same fixed tables."""
    known = ", ".join(f"('{s}', '{k}')" for k, s in licenses.SENTENCES.items())
    hinted = " OR ".join(f"contains(lower(coalesce(text, '')), '{h}')" for h in licenses.HINTS)
    steps = ["seqs AS (SELECT doc_id, n_sentences, sentence_ids, ',' || replace(sentence_ids, ',', ',,') || ',' AS l0 FROM found)"]
    # Each rule takes its runs out of the sequence; bars count them.
    cols, at = [], "l0"
    for i, (_, ids) in enumerate(licenses.RULES, 1):
        steps.append(f"r{i} AS (SELECT *, replace({at}, ',{',,'.join(ids)},', '|') AS l{i} FROM {'seqs' if i == 1 else f'r{i - 1}'})")
        cols.append(f"(length(l{i}) - length(replace(l{i}, '|', ''))) - (length({at}) - length(replace({at}, '|', '')))")
        at = f"l{i}"
    hits = "[" + ", ".join(f"CASE WHEN ({c}) > 0 THEN '{name}' END" for (name, _), c in zip(licenses.RULES, cols)) + "]"
    # Names in the order of the rules, each at its first rule only.
    names = f"list_filter({hits}, lambda x, i: x IS NOT NULL AND list_position({hits}, x) = i)"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
hinted AS (SELECT doc_id, row_number() OVER () AS row_no, text, {hinted} AS h FROM documents),
parts AS (SELECT row_no, unnest(string_split_regex(text, '[.!?]+\\s+|[\\n\\r]+')) AS s, generate_subscripts(string_split_regex(text, '[.!?]+\\s+|[\\n\\r]+'), 1) AS pos FROM hinted WHERE h),
matched AS (SELECT row_no, pos, id FROM parts JOIN known ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = sentence),
ids AS (SELECT row_no, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS sentence_ids FROM matched GROUP BY row_no),
found AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids FROM hinted LEFT JOIN ids USING (row_no)),
{', '.join(steps)}
SELECT doc_id, n_sentences, sentence_ids, (length({at}) - length(replace({at}, '|', '')))::BIGINT AS n_rules, coalesce(array_to_string({names}, ','), '') AS licenses FROM r{len(licenses.RULES)}
"""


_TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 by the usual table of 256 entries, over the bytes of each distinct word.
_RESAMPLE = f"""
WITH words AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS.format(text="coalesce(text, '')")} AS w FROM documents),
here AS (SELECT row_no, unnest(w) AS term FROM words),
there AS (SELECT unnest({_TERMS.format(text="coalesce(text, '')")}) AS term FROM benchmark),
counted AS (SELECT term, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT term, 1 AS s, 0 AS t FROM here UNION ALL SELECT term, 0, 1 FROM there) GROUP BY term),
steps AS (SELECT list(c ORDER BY i) AS c FROM (SELECT i, list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)::BIGINT AS c FROM (SELECT unnest(range(256)) AS i))),
hashed AS (SELECT term, s, t, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(hex(encode(term))), 2), lambda p: ('0x' || hex(encode(term))[p + 1 : p + 2])::BIGINT)), lambda a, b: xor(c[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket FROM counted, steps),
per AS (SELECT bucket, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM hashed GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM per),
gains AS (SELECT bucket, floor(1000 * ln((per.t + 1.0::DOUBLE) * (total.s + 10000) / ((per.s + 1.0::DOUBLE) * (total.t + 10000))))::BIGINT AS gain FROM per, total),
weighed AS (SELECT row_no, sum(gain)::BIGINT AS weight FROM here JOIN hashed USING (term) JOIN gains USING (bucket) GROUP BY row_no),
scored AS (SELECT row_no, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM words LEFT JOIN weighed USING (row_no)),
ranked AS (SELECT row_no, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row_no) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, (CASE WHEN r <= 10 * n // 100 THEN r END)::BIGINT AS rank FROM scored LEFT JOIN ranked USING (row_no)
"""

_RANKED = f"""
WITH words AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS.format(text="coalesce(text, '')")} AS w FROM documents),
totals AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM words WHERE len(w) > 0),
tfs AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(w) AS term FROM words) GROUP BY row_no, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
items AS (SELECT row_number() OVER () AS q, item_id, {_TERMS.format(text="coalesce(text, '')")} AS w FROM benchmark),
uses AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM items) GROUP BY q, term),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM dfs, totals),
lengths AS (SELECT row_no, doc_id, 75 + (25 * len(words.w) * n) // l AS m FROM words, totals),
scores AS (SELECT q, row_no, sum(times * weights.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM uses JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (row_no) GROUP BY q, row_no),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores JOIN lengths USING (row_no) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses; the others are tested against brute force in tests/llm."""
    return {"op10_license_scan": _license_sql(), "op11_resample": _RESAMPLE, "op12_ranked_search": _RANKED}
