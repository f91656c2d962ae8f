"""Benchmark decontamination: size-partitioned MinHash containment search, exact check.

A test item is in a document when at least ``least`` of its distinct word shingles are
(five words each; an item of fewer words is one shingle of all its words).

1. *Partitions.*  Items are partitioned by set size (powers of two) and shingle width.
2. *Sketches of items.*  An item of n shingles is sketched by its n - ceil(least * n) + 1 smallest
   hashes (a bottom-k MinHash).  A document that contains the item has one of them, whatever its own length.
3. *Sketches of documents.*  All sketches of a partition lie under the largest hash in them, the
   partition's threshold; a document's sketch for the partition is what it has under that.  A document with
   fewer shingles than the partition's smallest item needs skips the partition.
4. *Search and check.*  Document sketches probe the partition's item sketches; each hit is verified by
   counting the item's shingles in the whole document.  No item is lost.

Items whose sets have at most ``HELD_SHINGLES`` shingles together are broadcast: one pass over the documents,
which are not shuffled.  Beyond that the same steps are joins, see ``_searched``: two scans, and only sketches
and the shingles of hit documents are shuffled.

Null texts are empty; items without words are in no document; repeated rows, of documents and of
items, give repeated pairs; an empty table gives no pairs; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import row_ids, slices, utf8, whole
from ._store import materialize
from ._words import PLACE, mix, shingles, word_hashes

WIDTH = 5
#: Shingles of all items that are broadcast: 32 MB.
HELD_SHINGLES = 4 << 20
_SIGN = np.uint64(1)


def _needed(n: int, least: float) -> int:
    return math.ceil(least * n - 1e-9)


def _of_width(raw: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``width`` words in every text (positive longs), and for each text the index of its first."""
    if width == WIDTH:
        h, first = shingles(raw, offs, WIDTH)
        return (h >> _SIGN).astype(np.int64), first
    words, at = word_hashes(raw, offs)
    n = np.maximum(np.diff(at) - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    if not first[-1]:
        return np.zeros(0, np.int64), first
    s = sum(words[j : len(words) - width + 1 + j] * PLACE[j] for j in range(width))
    src = np.repeat(at[:-1] - first[:-1], n) + np.arange(first[-1])
    return (mix(s[src] + np.uint64(width)) >> _SIGN).astype(np.int64), first


def item_sets(items: DataFrame, least: float, item_key: str, text: str) -> DataFrame:
    """no, item, width, part, hashes (sorted), n, k: the sets of all items with words and the size k of their sketches."""
    schema = pa.schema([("no", pa.int64()), ("item", pa.int64()), ("width", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("k", pa.int32()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = row_ids()
        for b in slices(batches, "text"):
            raw, offs = utf8(b.column("text"))
            n_words = np.diff(word_hashes(raw, offs)[1])
            h, first = _of_width(raw, offs, WIDTH)
            out = []
            for i, (key, words) in enumerate(zip(b.column("item").to_pylist(), n_words.tolist())):
                own = np.unique(h[first[i] : first[i + 1]])
                if n := len(own):
                    out.append((next(ids), key, min(WIDTH, words), (n - 1).bit_length(), n, n - _needed(n, least) + 1, own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    src = items.select(items[item_key].cast("long").alias("item"), items[text].cast("string").alias("text"))
    return src.mapInArrow(run, "no long, item long, width int, part int, n long, k int, hashes array<long>")


class Partition:
    """Items of one width and size class: their sketches under the threshold, and the fewest shingles that one of them needs."""

    def __init__(self, pairs: list[tuple[int, int]], fewest: int):
        pairs.sort()
        self.probe, self.item = (np.array(c, np.int64) for c in zip(*pairs))
        self.threshold, self.fewest = int(self.probe[-1]), fewest


class Items:
    """Sketches by partition and full sets of items that fit in one broadcast."""

    def __init__(self, rows: list, least: float):
        self.keys = [r["item"] for r in rows]
        self.sets = [np.array(r["hashes"], np.int64) for r in rows]
        self.need = [_needed(len(s), least) for s in self.sets]
        found: dict[tuple[int, int], list] = defaultdict(list)
        for i, r in enumerate(rows):
            found[r["width"], r["part"]].append(i)
        self.widths: dict[int, list[Partition]] = defaultdict(list)
        for (width, _), own in sorted(found.items()):
            pairs = [(int(h), i) for i in own for h in self.sets[i][: rows[i]["k"]]]
            self.widths[width].append(Partition(pairs, min(self.need[i] for i in own)))

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, number of the item, shared shingles) for every text of the column and item that it contains."""
        raw, offs = utf8(column)
        for width, parts in self.widths.items():
            h, first = _of_width(raw, offs, width)
            size = np.diff(first)
            low = np.flatnonzero(h <= max(p.threshold for p in parts))
            row = np.searchsorted(first, low, "right") - 1
            pairs = set()
            for p in parts:
                sketch = (h[low] <= p.threshold) & (size[row] >= p.fewest)
                own, text = h[low[sketch]], row[sketch]
                at = np.minimum(np.searchsorted(p.probe, own), len(p.probe) - 1)
                hit = p.probe[at] == own
                for d, j in set(zip(text[hit].tolist(), at[hit].tolist())):
                    same = p.probe[j]
                    while j < len(p.probe) and p.probe[j] == same:
                        pairs.add((d, int(p.item[j])))
                        j += 1
            last, have = -1, None
            for d, i in sorted(pairs):
                if d != last:
                    last, have = d, np.unique(h[first[d] : first[d + 1]])
                shared = int(np.isin(self.sets[i], have, assume_unique=True).sum())
                if shared >= self.need[i]:
                    yield d, i, shared


def _held(items: DataFrame, least: float) -> Items | None:
    """The items for one broadcast, where they are few enough."""
    if (items.agg(F.sum("n")).first()[0] or 0) > HELD_SHINGLES:
        return None
    return Items(items.orderBy("no").collect(), least)


def _identity(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _searched(docs: DataFrame, items: DataFrame, least: float, text: str) -> DataFrame:
    """t1, t2, no, n_shared of every text and item that it contains, by joins over sketches and then over whole sets."""
    parts = [(r["width"], r["part"], r["t"], _needed(r["n"], least)) for r in items.select("width", "part", "n", F.element_at("hashes", F.col("k")).alias("t")).groupBy("width", "part").agg(F.max("t").alias("t"), F.min("n").alias("n")).collect()]
    widths = sorted({p[0] for p in parts})
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    src = docs.select(*_identity(body), body.alias("text"))
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("width", pa.int32()), ("hashes", pa.list_(pa.int64()))])
    kinds = "t1 long, t2 long, width int, hashes array<long>"

    def shingled(sketches: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                raw, offs = utf8(b.column("text"))
                names = list(zip(b.column("t1").to_pylist(), b.column("t2").to_pylist()))
                for width in widths:
                    h, first = _of_width(raw, offs, width)
                    out = []
                    for i, name in enumerate(names):
                        own = np.unique(h[first[i] : first[i + 1]])
                        if sketches:
                            own = own[own <= max((t for w, _, t, need in parts if w == width and need <= len(own)), default=-1)]
                        if len(own):
                            out.append((*name, width, own))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return run

    each = lambda df: df.withColumn("h", F.explode("hashes")).drop("hashes")
    sketch = each(items.select("no", "width", F.slice("hashes", F.lit(1), F.col("k")).alias("hashes")))
    met = materialize(each(src.mapInArrow(shingled(True), kinds)).join(sketch, ["width", "h"]).select("t1", "t2", "width", "no").distinct(), "met")
    some = src.join(met.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    wanted = each(met.join(items.select("no", "hashes"), "no"))
    count = each(some.mapInArrow(shingled(False), kinds)).join(wanted, ["t1", "t2", "width", "h"]).groupBy("t1", "t2", "no").agg(F.count(F.lit(1)).alias("n_shared"))
    return count.join(items.select("no", "n"), "no").where(F.col("n_shared") >= F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9))).drop("n")


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.75, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it contains: key, item key, n_shared, n_item, containment."""
    sets = materialize(item_sets(items, least, item_key, item_text), "items")
    own = _held(sets, least)
    out = ["key", "item", "n_shared", "n", (F.col("n_shared") / F.col("n")).alias("containment")]
    if own is None:
        found = materialize(_searched(docs, sets, least, text), "hits")
        rows = docs.select(docs[key].cast("long").alias("key"), *_identity(F.coalesce(docs[text].cast("string"), F.lit(""))))
        pairs = rows.join(found, ["t1", "t2"]).join(sets.select("no", "item", "n"), "no").select(*out)
    else:
        held = docs.sparkSession.sparkContext.broadcast(own)
        schema = pa.schema([("key", pa.int64()), ("item", pa.int64()), ("n_shared", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = held.value
            for b in slices(batches, "text"):
                keys = b.column("key").to_pylist()
                rows = [(keys[d], own.keys[i], n, len(own.sets[i])) for d, i, n in own.hits(b.column("text"))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        src = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
        pairs = src.mapInArrow(run, "key long, item long, n_shared long, n long").select(*out)
    return pairs.withColumnsRenamed({"key": key, "item": item_key, "n": "n_item"})


def clean(docs: DataFrame, items: DataFrame, least: float = 0.75, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns."""
    sets = materialize(item_sets(items, least, item_key, item_text), "items")
    own = _held(sets, least)
    if own is None:
        found = materialize(_searched(docs, sets, least, text).select("t1", "t2").distinct(), "hits")
        rows = docs.select(*_identity(F.coalesce(docs[text].cast("string"), F.lit(""))), whole())
        return rows.join(found, ["t1", "t2"], "left_anti").select("row.*")
    held = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            keep = np.ones(batch.num_rows, bool)
            keep[[d for d, _, _ in held.value.hits(batch.column(text))]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
