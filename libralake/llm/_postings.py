"""Inverted lists by block of documents: one row for each block and term, as Arrow arrays.

A block is a slice of neighbouring rows of bounded bytes, so a term that every document holds
is one row for each block, and no list outgrows its block.  An entry of a list is a document's place in the
block, times 2**32, plus how often it holds the term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import row_ids, slices, utf8

#: Bytes that words are made of, after A-Z are lower-cased: 0-9, a-z and all of other characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SCHEMA = "block long, term string, n long, held array<long>, keys array<long>, sizes array<long>, words array<long>"


def words_of(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, lower-cased, and how many each text has."""
    low = _LOWER[raw]
    tok = WORD[low]
    first = tok.copy()
    first[1:] &= ~tok[:-1]
    heads = offs[:-1][offs[:-1] < len(raw)]
    first[heads] = tok[heads]
    starts = np.flatnonzero(first)
    own = low[tok]
    at = np.concatenate([np.cumsum(tok)[starts] - 1, [len(own)]]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(own)]), np.diff(np.searchsorted(starts, offs))


def runs_of(words: pa.Array, n_words: np.ndarray, longest: int) -> tuple[pa.Array, np.ndarray]:
    """All runs of 1 to ``longest`` words, joined by one space, and the text of each."""
    doc = np.repeat(np.arange(len(n_words), dtype=np.int64), n_words)
    parts, docs = [words], [doc]
    for n in range(2, longest + 1):
        i = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
        parts.append(pc.binary_join_element_wise(*(words.take(pa.array(i + j)) for j in range(n)), pa.scalar(" ", pa.large_string())))
        docs.append(doc[i])
    return pa.concat_arrays(parts), np.concatenate(docs)


def lists(rows: pa.Array, column: pa.Array, longest: int, block: int) -> pa.RecordBatch:
    """The lists of one block: a row for each term, and one without a term that has the keys, numbers of runs and numbers of words of its documents."""
    raw, offs = utf8(column)
    words, n_words = words_of(raw, offs)
    runs, doc = runs_of(words, n_words, longest)
    coded = runs.dictionary_encode()
    pairs, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * len(column) + doc, return_counts=True)
    term, doc = np.divmod(pairs, max(1, len(column)))
    n = len(coded.dictionary)
    first = np.searchsorted(term, np.arange(n + 1)).astype(np.int32)
    total = np.add.reduceat(counts, first[:-1]) if n else np.zeros(0, np.int64)
    sizes = np.sum([np.maximum(n_words - j, 0) for j in range(longest)], axis=0)
    head = lambda values: pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), values)])
    cols = [
        pa.array(np.full(n + 1, block), pa.int64()),
        pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]),
        pa.array(np.append(total, 0), pa.int64()),
        pa.ListArray.from_arrays(pa.array(np.append(first, first[-1])), pa.array(doc << 32 | counts)),
        *map(head, (rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows, pa.array(sizes, pa.int64()), pa.array(n_words, pa.int64()))),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["block", "term", "n", "held", "keys", "sizes", "words"])


def postings(docs: DataFrame, key: str, text: str, longest: int = 1, most: int = 4 << 20) -> DataFrame:
    """The lists of all blocks of at most ``most`` bytes (one longer text is a block of its own); null texts have no words.

    Numbers of blocks hold for one evaluation: write the table before it is read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = row_ids()
        for b in slices(batches, "text", most):
            yield lists(b.column("key"), b.column("text"), longest, next(ids))

    return docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def heads(index: DataFrame) -> DataFrame:
    """block, doc, key, size, words: one row for each document."""
    return index.where("term is null").select("block", F.posexplode(F.arrays_zip("keys", "sizes", "words")).alias("doc", "d")).select("block", "doc", F.col("d.keys").alias("key"), F.col("d.sizes").alias("size"), F.col("d.words").alias("words"))


def terms(index: DataFrame) -> DataFrame:
    """block, term, n, held: the lists alone."""
    return index.where("term is not null").select("block", "term", "n", "held")
