"""Exact removal of repeated byte strings, by suffix arrays of content-defined shards.

A byte goes when a string of ``width`` bytes over it also starts earlier: in a smaller key, or in
the same document at a smaller place.  Strings are held against the whole corpus, as it came in.

1. *Anchors.*  A string's anchor is the leftmost of its smallest hashes of ``GRAM`` bytes: equal strings have equal anchors.
   Neighbouring strings that share an anchor are one piece of text (under 2 * width bytes), about one for 35 bytes.
2. *Live anchors.*  Anchors are counted over the corpus; one that stands at one place only has no repeated string, so
   its piece goes no further.
3. *Pieces.*  Equal pieces of live anchors become one row with its first place; at all other places they are
   covered wholly.  A piece that has its anchor to itself meets no other.
4. *Shards.*  The others are cut from the documents of their first places and dealt by anchor, so that all places of a string are in one shard.  A shard's suffixes are sorted by external induced
   sorting (``induced_sort``); suffixes whose common prefix has ``width`` bytes are one string.  Its first place
   is the least of its pieces'; at each other one it is repeated.
5. *Removal.*  Covered spans are merged by document and cut out.

The scratch files of a shard lie in the folder named by ``spark.checkpoint.dir`` and go with its task.  Counts and first places
are partial before a shuffle; pieces held by at least one in ``HOT`` of all places (so at most ``HOT`` of them) are
broadcast without their text; joins on anchors are by keys that Spark's skew join can split.

Null texts are empty.  Rows of equal key and text are one document and get the same result; of
rows of equal key and different texts the one with the smaller hash is earlier; a null key is the
largest.  Empty tables give no rows; texts shorter than ``width`` lose nothing; other columns are not looked at and may have any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induced_sort
from ._arrow import filled, slices, utf8
from ._store import scratch_uri, settled, shuffle_partitions
from ._words import BYTE, mix

GRAM = 32
#: Bytes of pieces for a shard, and symbols that its sorting holds at once.
SHARD_BYTES, HELD = 8 << 20, 16 << 20
#: Pieces that are broadcast by their digest: those at at least one in so many of all places.
HOT = 10_000
#: Windows handled at once.
WINDOWS = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE32 = (BYTE >> np.uint64(32)).astype(np.uint32)
_LAST = 2**63 - 1


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of 32 bits for every run of GRAM bytes."""
    h, step, k = _BYTE32[raw], int(_STEP), 1
    while k < GRAM:
        h = h[:-k] * np.uint32(step & 0xFFFFFFFF) + h[k:]
        step, k = step * step, 2 * k
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def _digest(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of every stretch of 8 or more bytes; ``words`` has the 8 bytes from each place on."""
    d = size.astype(np.uint64) * _STEP
    for j in range(0, int(size.max(initial=0)), 8):
        more = slice(None) if j < int(size.min()) else np.flatnonzero(size > j)
        d[more] = mix(d[more] ^ words[start[more] + np.minimum(j, size[more] - 8)])
    return d.view(np.int64)


def pieces(raw: np.ndarray, offs: np.ndarray, width: int, digests: bool = True) -> tuple[np.ndarray, ...]:
    """(text, start, bytes, anchor, digest, where asked for) of the pieces of many texts: runs of windows that share an anchor."""
    out = []
    reach = width - GRAM + 1
    words = np.ndarray(max(0, len(raw) - 7), "<u8", np.ascontiguousarray(raw), 0, (1,)) if len(raw) > 7 else np.zeros(0, np.uint64)
    for a in range(0, len(raw) - width + 1, WINDOWS):
        n = min(WINDOWS, len(raw) - width + 1 - a)
        h = _gram_hashes(raw[a : a + n + width - 1])
        low = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= reach:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        low = np.minimum(low[:n], low[reach - k : reach - k + n])
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # The last windows before a text's end reach into the next one.
        x, y = np.searchsorted(offs, [a, a + n + width], "right")
        for end in offs[max(1, x) : y].tolist():
            at[max(0, end - width + 1 - a) : max(0, end - a)] = -1
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        size = np.diff(np.append(first, n)) + width - 1
        real = at[first] >= 0
        first, size = first[real], size[real]
        at = at[first] + a
        first += a
        if len(first):
            text = np.searchsorted(offs, first, "right") - 1
            out.append((text, first - offs[text], size, _digest(words, at, np.full(len(at), GRAM)), _digest(words, first, size) if digests else size))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, copy, text; the first two tell documents apart and order them."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[key].cast("long"), F.lit(_LAST)).alias("id"), F.shiftrightunsigned(F.xxhash64(body), 33).alias("copy"), body.alias("text"), docs[key].cast("long").alias("key"))


def anchored(docs: DataFrame, width: int, places: bool) -> DataFrame:
    """anchor of every piece; with ``places`` also digest, id, place (copy times 2**32 plus the start) and size."""
    schema = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("size", pa.int64())][: 5 if places else 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            text, start, size, anchor, digest = pieces(*utf8(b.column("text")), width, places)
            own = lambda c: b.column(c).to_numpy()[text]
            cols = [anchor, digest, own("id"), own("copy") << 32 | start, size] if places else [anchor]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return docs.select("id", "copy", "text").mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def live_places(docs: DataFrame, width: int) -> DataFrame:
    """anchor, digest, id, place, size: the pieces of all anchors that stand at more places than one."""
    live = anchored(docs, width, False).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    return settled(anchored(docs, width, True).join(live, "anchor"), "anchors")


def cut(docs: DataFrame, places: DataFrame) -> DataFrame:
    """anchor, piece (binary), id, place: the texts of pieces, out of their documents."""
    by_document = places.groupBy("id", F.shiftright("place", 32).alias("copy")).agg(F.collect_list(F.struct(F.col("place").bitwiseAND(0xFFFFFFFF).alias("start"), "size", "anchor")).alias("at"))
    schema = pa.schema([("anchor", pa.int64()), ("piece", pa.binary()), ("id", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            at = b.column("at")
            start, size, anchor = (at.flatten().field(k).to_numpy() for k in range(3))
            row = np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy()))
            raw, offs = utf8(b.column("text"))
            data = raw.tobytes()
            cols = [anchor, [data[s : s + n] for s, n in zip((offs[row] + start).tolist(), size.tolist())], b.column("id").to_numpy()[row], b.column("copy").to_numpy()[row] << 32 | start]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.select("id", "copy", "text").join(by_document, ["id", "copy"]).mapInArrow(run, "anchor long, piece binary, id long, place long")


def _sorted_shard(rows: Iterator[pa.RecordBatch], width: int, held: int, uri: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, place, from, to) of what is repeated in first places of pieces, for the pieces of one shard."""
    scratch = induced_sort.Scratch(uri)
    try:
        log = induced_sort.Log(scratch, (np.uint8,), induced_sort.BLOCK)
        ids, places, sizes = [], [], []
        for b in rows:
            raw, offs = _bytes(b.column("piece"))
            # Symbols 1 after each piece and 0 at the end.
            text = np.ones(len(raw) + b.num_rows, np.uint8)
            text[np.arange(len(raw)) + np.repeat(np.arange(b.num_rows), np.diff(offs))] = raw + 2
            log.add(text)
            ids.append(b.column("id").to_numpy())
            places.append(b.column("place").to_numpy())
            sizes.append(np.diff(offs))
        log.add(np.zeros(1, np.uint8))
        log.close()
        if ids:
            yield from _repeated(log, scratch, *map(np.concatenate, (ids, places, sizes)), width, held)
    finally:
        scratch.close()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def _repeated(log: induced_sort.Log, scratch: induced_sort.Scratch, ids: np.ndarray, places: np.ndarray, sizes: np.ndarray, width: int, held: int) -> Iterator[tuple[np.ndarray, ...]]:
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    # Numbers in the order of (id, place): the order of starts, since windows of one document differ in their place.
    document = np.unique(np.stack([ids, places >> 32]), axis=1, return_inverse=True)[1].reshape(-1)
    base = document.astype(np.int64) << 32 | (places & 0xFFFFFFFF)
    low, high = np.full(len(ids), 1 << 30), np.full(len(ids), -1)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def judge(place: np.ndarray, lcp: np.ndarray) -> None:
        """Whole classes of equal strings: at all places but the first they are repeated."""
        new = lcp < width
        new[0] = True
        group = np.cumsum(new) - 1
        some = np.bincount(group)[group] > 1
        place, group = place[some], group[some]
        piece = np.searchsorted(begins, place, "right") - 1
        off = place - begins[piece]
        whole = off + width <= sizes[piece]
        piece, off, group = piece[whole], off[whole], group[whole]
        if len(piece):
            start = base[piece] + off
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            first = np.minimum.reduceat(start, head)
            late = start > np.repeat(first, np.diff(np.append(head, len(group))))
            np.minimum.at(low, piece[late], off[late])
            np.maximum.at(high, piece[late], off[late])

    def emit(place: np.ndarray, lcp: np.ndarray) -> None:
        heads = np.flatnonzero(lcp < width)
        if len(heads) and (heads[-1] or waiting):
            cut = heads[-1]
            waiting.append((place[:cut], lcp[:cut]))
            judge(*map(np.concatenate, zip(*waiting)))
            waiting.clear()
            place, lcp = place[cut:], lcp[cut:]
        waiting.append((place, lcp))

    induced_sort.sort(induced_sort.Symbols(log, int(begins[-1] + sizes[-1] + 2), 8, held), scratch, held, width, emit)
    judge(*map(np.concatenate, zip(*waiting)))
    hit = np.flatnonzero(high >= 0)
    # Starts in a piece are less than ``width`` apart: they cover one span.
    yield ids[hit], places[hit], low[hit], high[hit] + width


def spans(docs: DataFrame, width: int = 100, key: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """id, copy, begin, end (bytes): what is repeated, not yet merged; see ``_documents`` for the first two."""
    return _spans(_documents(docs, key, text), width, held)


def _spans(docs: DataFrame, width: int, held: int) -> DataFrame:
    spark = docs.sparkSession
    live = live_places(docs, width)
    first = live.groupBy("anchor", "digest").agg(F.min(F.struct("id", "place")).alias("first"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    first = settled(first.select("anchor", "digest", "first.*", "size", "n"), "first_places")
    n_places = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Places that are not the first of their piece.
    known = first.where("n > 1").select("anchor", "digest", F.col("id").alias("first_id"), F.col("place").alias("first_place"), "size", "n")
    hot, rest = F.broadcast(known.where(F.col("n") * HOT >= n_places)), known.where(F.col("n") * HOT < n_places)
    at = live.drop("size")
    met = at.join(hot, ["anchor", "digest"]).unionByName(at.join(hot, ["anchor", "digest"], "left_anti").join(rest, ["anchor", "digest"])).where("id <> first_id or place <> first_place")
    whole = met.select("id", "place", F.lit(0).alias("low"), F.col("size").cast("int").alias("high"))
    # Pieces that share their anchor with other pieces.
    several = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("bytes")).where("pieces > 1")
    n_bytes = several.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    unlike = first.join(several.select("anchor"), "anchor").select("anchor", "id", "place", "size")
    uri = scratch_uri(spark)
    schema = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _sorted_shard(batches, width, held, f"{uri}/{uuid.uuid4().hex}"):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)
        pa.default_memory_pool().release_unused()

    shards = max(shuffle_partitions(spark), n_bytes // SHARD_BYTES + 1)
    dealt = cut(docs, unlike).repartition(shards, "anchor").select("piece", "id", "place")
    part = dealt.mapInArrow(run, "id long, place long, low int, high int")
    start = F.col("place").bitwiseAND(0xFFFFFFFF)
    return settled(whole.unionByName(part), "spans").select("id", F.shiftright("place", 32).alias("copy"), (start + F.col("low")).alias("begin"), (start + F.col("high")).alias("end"))


def deduplicated(docs: DataFrame, width: int = 100, key: str = "doc_id", text: str = "text", digest: bool = False, held: int = HELD) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (binary; with ``digest`` its SHA-256 in hex, as kept_sha256) of every row."""
    from_docs = _documents(docs, key, text)
    gone = _spans(from_docs, width, held).groupBy("id", "copy").agg(F.collect_list(F.struct("begin", "end")).alias("cut"))
    kept = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for k, text, cuts in zip(b.column("key").to_pylist(), filled(b.column("text")).to_pylist(), b.column("cut")):
                raw = text.encode("utf-8", "surrogatepass")
                parts, n = [raw], 0
                if cuts.is_valid and len(cuts.values):
                    begin, end = (cuts.values.field(f).to_numpy() for f in ("begin", "end"))
                    by = np.argsort(begin, kind="stable")
                    begin, end = begin[by], np.maximum.accumulate(end[by])
                    head = np.concatenate([[True], begin[1:] > end[:-1]])
                    begin, end = begin[head], end[np.append(head[1:], True)]
                    n = len(begin)
                    parts = [raw[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(raw)])]
                left = b"".join(parts)
                out.append((k, len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest() if digest else left))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    names = f"{key} long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept binary'}"
    return from_docs.join(gone, ["id", "copy"], "left").select("key", "text", "cut").mapInArrow(run, names)
