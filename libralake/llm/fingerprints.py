"""Document fingerprints from content-defined chunks.

A fingerprint is the set of a text's chunk digests, each with the chunk's length
in bytes.  Written as a string it has 14 hex digits for each distinct chunk (12 of
the digest, 2 of the length), in ascending order; the empty text has the empty
fingerprint.  Equal texts have equal fingerprints.  The likeness of a fingerprint to
another is the share of its length whose chunks the other also has: 0 to 1, 1 for
two empty texts, 0 where only the first is empty.

``successions`` compares every document with an edited version of itself and with
the next document in descending order of the key.  Null keys come last, equal keys
are ordered by text (null text: empty); every row, repeated ones too, gives a row.
Columns other than key and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gear
from ._arrow import filled, slices, utf8
from ._store import shuffle_partitions

LOWEST = -(2**63)


class Prints:
    """Fingerprints of a list of texts: sorted (digest, length) codes of each."""

    def __init__(self, column: pa.Array, sizes: gear.Sizes = gear.FINE):
        raw, offs = utf8(column)
        ends, first = gear.boundaries(raw, offs, sizes)
        digest, starts = gear.digests(raw, ends)
        codes = (digest & ~np.uint64(0xFFFF)) | (ends - starts).astype(np.uint64)
        self.codes = [np.unique(codes[a:b]) for a, b in zip(first[:-1], first[1:])]

    @staticmethod
    def text(codes: np.ndarray) -> str:
        return ((codes >> np.uint64(16) << np.uint64(8)) | (codes & np.uint64(0xFF))).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the length of the first whose chunks the second has."""
    if not len(a):
        return 1.0 if not len(b) else 0.0
    own = a & np.uint64(0xFFFF)
    if not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float(own[b[at] == a].sum() / own.sum())


def parse(fingerprint: str) -> np.ndarray:
    """The codes of a written fingerprint."""
    if not fingerprint:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 7)
    wide = np.zeros((len(x), 8), np.uint8)
    wide[:, 1:] = x
    v = wide.view(">u8").reshape(-1).astype(np.uint64)
    return (v >> np.uint64(8) << np.uint64(16)) | (v & np.uint64(0xFF))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, fingerprint of every row (null text: empty)."""
    schema = pa.schema([(key, pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            column = filled(b.column(text))
            prints = Prints(column).codes
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([len(t) for t in column.to_pylist()], pa.int64()), pa.array(map(Prints.text, prints), pa.string())], schema=schema)

    src = docs.select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text))
    return src.mapInArrow(run, f"{key} long, n_chars long, fingerprint string")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(rows: list[tuple[int | None, str, str]], schema: pa.Schema) -> pa.RecordBatch:
    edited = [_edited(t, n) for _, t, n in rows]
    own = Prints(pa.array([t for _, t, _ in rows], pa.string())).codes
    changed = Prints(pa.array(edited, pa.string())).codes
    # The text that follows a row is the next row's own text, but for the last.
    after = own[1:] + Prints(pa.array([rows[-1][2]], pa.string())).codes
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _, _ in rows], pa.int64()),
            pa.array([len(t) for _, t, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array(map(Prints.text, own), pa.string()),
            pa.array(map(Prints.text, changed), pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64()),
        ],
        schema=schema,
    )


_COLUMNS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def successions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document against its edited text (second half replaced from the next document) and against the next one.

    Rows are dealt once, by ranges of the key whose borders come from quantiles of the
    key alone.  The first row of each range is also sent to the range before it, so
    every task sees the row that follows its last one, and no task sees all rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.coalesce(docs[key].cast("long"), F.lit(LOWEST)).alias("_k"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_t"))
    n = 4 * shuffle_partitions(spark)
    keys = src.select(F.col("_k").cast("double").alias("_d"))
    cuts = sorted(set(keys.approxQuantile("_d", [i / n for i in range(1, n)], 0.2 / n)))
    if cuts:
        src = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_d", outputCol="_b").transform(src.withColumn("_d", F.col("_k").cast("double")))
        src = src.withColumn("_b", (F.lit(len(cuts)) - F.col("_b")).cast("int")).drop("_d")
    else:
        src = src.withColumn("_b", F.lit(0))
    # One entry for each range, in the order of the ranges.
    heads = sorted((r["_b"], r["k"]) for r in src.groupBy("_b").agg(F.max("_k").alias("k")).collect())
    rows = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]
    to = spark.createDataFrame(rows, "_k long, _to int")
    ends = src.join(F.broadcast(to), "_k").select("_k", "_t", F.col("_to").alias("_b"), F.lit(1).alias("_f"))
    dealt = src.select("_k", "_t", "_b", F.lit(0).alias("_f")).unionByName(ends).repartition(shuffle_partitions(spark), "_b").sortWithinPartitions("_b", "_f", F.desc("_k"), "_t")
    schema = pa.schema([(key, pa.int64()), *_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        rows: list = []
        size = 0
        for batch in slices(batches, "_t", 2 << 20):
            for k, t, b, f in zip(*(batch.column(c).to_pylist() for c in ("_k", "_t", "_b", "_f"))):
                if held is not None and held[3] == 0:
                    if held[2] == b:
                        rows.append((None if held[0] == LOWEST else held[0], held[1], t))
                        size += len(held[1])
                    if size > 2 << 20 or held[2] != b or f:
                        if rows:
                            yield _compare(rows, schema)
                        rows, size = [], 0
                held = (k, t, b, f)
        if rows:
            yield _compare(rows, schema)

    return dealt.select("_k", "_t", "_b", "_f").mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
