"""Repeated passages across documents, by content-defined chunks deduplicated by digest.

Texts are cut by a gear rolling hash, so a passage that stands in two documents has
the same inner chunks in both, wherever it stands.  A chunk is repeated when its digest
occurs in two or more documents.  Runs of neighbouring repeated chunks of at least
``least_words`` words are repeated text; a run is parted into spans wherever the first
document of its chunks changes, so each span has one source.  A passage loses a part of one chunk at
either end (about 20 bytes on average, 96 at most), so the default of 30 words finds
passages of over 50 words, while single shared lines (licences, headings) stay below it.

Null keys and null or empty texts have no spans; rows of equal key and text count as one
document, those of equal key and different texts as documents of their own with one key;
an empty table gives no rows; other columns are not looked at and may have any name.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gear
from ._arrow import slices, utf8, whole

_CHUNK = [("id", pa.int64()), ("copy", pa.int64()), ("seq", pa.int32()), ("digest", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]


def _document(docs: DataFrame, key: str, text: str) -> list[Column]:
    """What tells documents apart: the key and a hash of the text."""
    return [docs[key].cast("long").alias("id"), F.xxhash64(docs[text].cast("string")).alias("copy")]


def begun(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether a word begins at each byte; every text's first byte is held against nothing before it."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    out = ~space
    out[1:] &= space[:-1]
    heads = offs[:-1][offs[:-1] < len(raw)]
    out[heads] = ~space[heads]
    return out


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, copy (hash of the text), seq, digest, start, end (code points), words begun in the chunk: one row for each chunk."""
    schema = pa.schema(_CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offs = utf8(batch.column("text"))
            if not len(raw):
                continue
            ends, first = gear.boundaries(raw, offs, gear.COARSE)
            digest, starts = gear.digests(raw, ends)
            n = np.diff(first)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            words = np.add.reduceat(begun(raw, offs).astype(np.int32), starts)
            base = np.repeat(chars[offs[:-1]], n)
            own = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in ("id", "copy")]
            seq = np.arange(len(ends)) - np.repeat(first[:-1], n)
            cols = [*own, seq.astype(np.int32), digest.view(np.int64), (chars[starts] - base).astype(np.int32), (chars[ends] - base).astype(np.int32), words.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    src = docs.select(*_document(docs, key, text), docs[text].cast("string").alias("text")).where("id is not null and text is not null")
    return src.mapInArrow(run, "id long, copy long, seq int, digest long, start int, end int, words int")


def repeated_spans(docs: DataFrame, least_words: int = 30, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash, span_start, span_end, n_words, first_id (smallest key with its chunks), n_seen (how often its most frequent chunk stands in the corpus), kept.

    ``kept`` is true where the span stands in no smaller key: the occurrence that stays.  The words of a
    whole run are held against ``least_words``; its spans can be shorter.
    Counts per digest are partial sums before the shuffle; the chunks themselves meet the
    repeated digests in a join whose hot keys Spark can split, and only repeated chunks travel on.
    Both sides cut the texts anew: that reads the corpus twice and stores no table of its chunks.
    """
    cut = chunks(docs, key, text)
    seen = (
        cut.groupBy("digest")
        .agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n_seen"))
        .where(F.col("first_id") < F.col("last_id"))
        .drop("last_id")
    )
    document = Window.partitionBy("id", "copy").orderBy("seq")
    before = F.lag("seq").over(document)
    # Rows that are repeated have the same chunks: one of each place stays.
    rep = cut.join(seen, "digest").withColumn("before", before).where("before is null or before < seq")
    other = (F.col("first_id") != F.coalesce(F.lag("first_id").over(document), F.col("first_id"))).cast("int")
    return (
        rep.withColumns({"run": F.col("seq") - F.row_number().over(document), "other": other})
        .withColumn("piece", F.sum("other").over(document.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "copy", "run", "piece")
        .agg(
            F.min("start").alias("span_start"),
            F.max("end").alias("span_end"),
            F.sum("words").alias("n_words"),
            F.min("first_id").alias("first_id"),
            F.max("n_seen").alias("n_seen"),
        )
        .withColumn("run_words", F.sum("n_words").over(Window.partitionBy("id", "copy", "run")))
        .where(F.col("run_words") >= least_words)
        .select(F.col("id").alias(key), F.col("copy").alias("text_hash"), "span_start", "span_end", "n_words", "first_id", "n_seen", (F.col("first_id") == F.col("id")).alias("kept"))
    )


def without_repeats(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span that is not kept cut out of its text; all other columns as they were."""
    drop = spans.where("not kept").groupBy(F.col(key).alias("id"), F.col("text_hash").alias("copy")).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end"))).alias("cut"))
    body = docs[text].cast("string").alias("body")
    joined = docs.select(*_document(docs, key, text), body, whole()).join(drop, ["id", "copy"], "left")
    begins = F.concat(F.array(F.lit(0)), F.transform("cut", lambda x: x["span_end"]))
    stops = F.concat(F.transform("cut", lambda x: x["span_start"]), F.array(F.length("body")))
    kept = F.array_join(F.zip_with(begins, stops, lambda a, b: F.substring("body", a + 1, b - a)), "")
    return joined.select(*[F.when(F.col("cut").isNull(), F.col("row")[c]).otherwise(kept).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
