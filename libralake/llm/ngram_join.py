"""N-gram Jaccard join by set relations: all links of similarity 0.75 or more, exact, as components.

A document's set holds its distinct word shingles.  Documents with equal sets are
one class.  The join works on classes:

1. *Inverted lists.*  Every class sends its shingles, packed by hash partition, to tasks
   that hold whole inverted lists.  A shingle of one class only links nothing and goes.
   Shingles that a good part of the documents hold are known before and need no list: they
   count as shared at once, so no task gets the list of a very common shingle.
2. *Alive classes.*  A class can have a link only if at least three quarters of its
   shingles stand in other classes too; the others are done.  Of an alive class the rarest
   shingles, as many as the threshold leaves free plus one, are its prefix: two linked
   classes share a shingle of both prefixes.
3. *Block skipping by position.*  With a shingle at position i of a set of n, at most n - i
   shingles are common from there on, which bounds the size of a partner.  A prefix
   shingle's list is kept in blocks by the size of the smaller partner; a set goes to the blocks
   its position admits, and a block in which no position admits a smaller partner is skipped.
4. *Groups.*  All classes of a block go to the group of the block's head, so two linked classes
   meet in some group.  Heads that are linked themselves share one group.  Candidates are never
   closed transitively.  A group of more than ``TILE_BYTES`` is dealt to tiles, one for
   every two parts of it.
5. *Answers from answers.*  In a tile, a class is compared with those that share an admissible
   prefix shingle.  Overlaps with all classes are counted from the tile's lists; those of a
   similar class are derived from them: only the lists of shingles in one set and not in the
   other are read.  Bounds from overlaps already known skip classes that cannot link.
   Classes that are known to be in one component are not compared.

Words: A-Z lower-cased, split at space and the controls 9 to 13.  Texts of fewer than five words
have one shingle; null texts and texts without words have the empty set and link with
nothing.  A null key takes part and never names a component that has another key; repeated
rows link with each other; an empty table gives no rows; other columns are unread.
Shingles are compared by 48-bit hashes, sets are equal by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import row_ids, slices, utf8, whole, with_text
from ._components import components
from ._store import materialize, shuffle_partitions
from ._words import mix, shingles

#: Bytes of packed shingles in one part of a group; a tile holds two parts.
TILE_BYTES = 32 << 20
#: Bytes of shingles that a task holds back before it sends them on.
PACK_BYTES = 8 << 20
#: A shingle is common when it is in this share of the documents; so many are reported by a task at least.
COMMON_SHARE, COMMON_LEAST = 1 / 256, 32
_SALT, _SALT2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_H48 = np.uint64(16)
NUM, DEN = 75, 100


def _six(x: np.ndarray) -> bytes:
    """Unsigned 48-bit numbers as bytes."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(b: bytes) -> np.ndarray:
    n = len(b) // 6
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(b, np.uint8).reshape(n, 6)
    return wide.view("<u8").reshape(-1)


def _sets(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """Digest in two halves and sorted shingles of every text; zeros for the empty set."""
    raw, offs = utf8(batch.column(text))
    s, at = shingles(raw, offs)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        u = np.unique(s[a:b])
        half = lambda salt: int(np.sum(mix(u ^ salt), dtype=np.uint64)) if len(u) else 0  # noqa: B023, E731
        yield half(_SALT), half(_SALT2), u


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _rows(docs: DataFrame, key: str, text: str, carry: bool) -> DataFrame:
    """at, key, n, cls, cls2 (and row) of every row; after them shingles that are common in a task: cls, cls2 their number, n -1."""
    kinds = T.StructType([T.StructField(c, T.LongType()) for c in ("at", "key", "n", "cls", "cls2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, many, seen, row = row_ids(), [], 0, set(), None

        def common() -> Iterator[pa.RecordBatch]:
            tok, count = np.unique(np.concatenate(held) >> _H48, return_counts=True)
            often = count >= max(COMMON_LEAST, len(held) // 64)
            if k := int(often.sum()):
                none = pa.nulls(k, pa.int64())
                cols = [none, none, pa.array(np.full(k, -1)), pa.array(tok[often].astype(np.int64)), pa.array(count[often])]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.nulls(k, row)] if carry else [])], names=["at", "key", "n", "cls", "cls2", *(["row"] if carry else [])])

        for b in slices(with_text(batches, place) if carry else batches, "text"):
            found = list(_sets(b, "text"))
            cols = [[next(ids) for _ in found], b.column("key"), [len(u) for *_, u in found], [_signed(d) for d, *_ in found], [_signed(d) for _, d, _ in found]]
            cols = [pa.array(c, pa.int64()) if isinstance(c, list) else c for c in cols]
            if carry:
                row = b.column("row").type
                cols.append(b.column("row"))
            yield pa.RecordBatch.from_arrays(cols, names=["at", "key", "n", "cls", "cls2", *(["row"] if carry else [])])
            for d, _, u in found:
                if len(u) and d not in seen:
                    seen.add(d)
                    held.append(u)
                    many += u.nbytes
            if many > PACK_BYTES:
                yield from common()
                held, many = [], 0
                if len(seen) > 500_000:
                    seen.clear()
        if held:
            yield from common()

    place = docs.columns.index(text)
    src = docs.select(docs[key].cast("long").alias("key"), whole() if carry else docs[text].cast("string").alias("text"))
    return src.mapInArrow(run, kinds.add("row", docs.schema) if carry else kinds)


def _partition_keys(spark, n: int) -> list[int]:
    """For each of n hash partitions an integer that Spark deals to it."""
    found: dict[int, int] = {}
    ids = spark.range(0, 40 * n + 200, 1, 1).select(F.col("id").cast("int").alias("k"))
    for r in ids.select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect():
        found[r["p"]] = r["k"]
    return [found.get(p, p) for p in range(n)]


_PACK = [("pid", pa.int32()), ("part", pa.int32()), ("cls", pa.binary()), ("size", pa.binary()), ("cnt", pa.binary()), ("tok", pa.binary())]


def _runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of every run of equal numbers."""
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return first, np.diff(first, append=len(own)).astype(np.uint32)


def _packed_lists(docs: DataFrame, text: str, keys: list[int], common: np.ndarray) -> DataFrame:
    """pid, part, cls, size, count (of each class), tok: shingles of a task's classes by hash partition; part -1 has common shingles."""
    schema, n = pa.schema(_PACK), len(keys)
    known = docs.sparkSession.sparkContext.broadcast(common)

    def flush(cls: list[int], sets: list[np.ndarray], turn: int) -> Iterator[pa.RecordBatch]:
        size = np.array([len(s) for s in sets], np.int64)
        own = np.repeat(np.arange(len(sets), dtype=np.int32), size)
        h = np.concatenate(sets) >> _H48
        part = (mix(h) % np.uint64(n)).astype(np.int64)
        if len(known.value):
            part[known.value[np.minimum(np.searchsorted(known.value, h), len(known.value) - 1)] == h] = -1
        order = np.argsort(part, kind="stable")
        h, own = h[order], own[order]
        cut = np.searchsorted(part[order], np.arange(-1, n + 1))
        names = np.array(cls, np.uint64)
        for p in range(-1, n):
            a, b = cut[p + 1], cut[p + 2]
            if a < b:
                first, many = _runs(own[a:b])
                who = own[a:b][first]
                yield _batch(schema, [(keys[p if p >= 0 else turn % n], p, names[who].tobytes(), size[who].astype(np.uint32).tobytes(), many.tobytes(), _six(h[a:b]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, sets, held, seen, turn = [], [], 0, set(), next(row_ids()) >> 33
        for b in slices(batches, text):
            for d, _, u in _sets(b, text):
                if len(u) and d not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(d)
                    cls.append(d)
                    sets.append(u)
                    held += u.nbytes
            if held > PACK_BYTES:
                yield from flush(cls, sets, turn)
                cls, sets, held, turn = [], [], 0, turn + 1
        if cls:
            yield from flush(cls, sets, turn)

    return docs.mapInArrow(run, "pid int, part int, cls binary, size binary, cnt binary, tok binary")


def _shared(packs: DataFrame, keys: list[int]) -> DataFrame:
    """Shingles of two or more classes, packed by partition of the class, with a level that grows with their frequency."""
    schema, n = pa.schema([*_PACK, ("freq", pa.binary())]), len(keys)

    def dealt(tok: np.ndarray, own: np.ndarray, size: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
        to = (mix(own) % np.uint64(n)).astype(np.int64)
        order = np.lexsort((own, to))
        tok, own, size, level, to = tok[order], own[order], size[order], level[order], to[order]
        cut = np.searchsorted(to, np.arange(n + 1))
        for p in range(n):
            a, b = cut[p], cut[p + 1]
            if a < b:
                first, many = _runs(own[a:b])
                yield _batch(schema, [(keys[p], p, own[a:b][first].tobytes(), size[a:b][first].tobytes(), many.tobytes(), _six(tok[a:b]), level[a:b].tobytes())])

    def opened(packs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        many = [np.frombuffer(r["cnt"], np.uint32) for r in packs]
        tok = np.concatenate([_unsix(r["tok"]) for r in packs])
        own, size = (np.concatenate([np.repeat(np.frombuffer(r[c], kind), m) for r, m in zip(packs, many)]) for c, kind in (("cls", np.uint64), ("size", np.uint32)))
        packs.clear()
        return tok, own, size

    def one(packs: list[dict]) -> Iterator[pa.RecordBatch]:
        tok, own, size = opened(packs)
        # What stands once goes before anything else is sorted.
        repeated = np.sort(tok)
        repeated = np.unique(repeated[1:][repeated[1:] == repeated[:-1]])
        if not len(repeated):
            return
        twice = repeated[np.minimum(np.searchsorted(repeated, tok), len(repeated) - 1)] == tok
        tok, own, size = tok[twice], own[twice], size[twice]
        order = np.lexsort((own, tok))
        tok, own, size = tok[order], own[order], size[order]
        keep = np.concatenate([[True], (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])])
        tok, own, size = tok[keep], own[keep], size[keep]
        _, many = _runs(tok)
        freq = np.repeat(many, many)
        keep = freq > 1
        if keep.any():
            yield from dealt(tok[keep], own[keep], size[keep], np.minimum(254, 8 * np.log2(freq[keep])).astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, []
        for b in batches:
            for r in b.to_pylist():
                if r["part"] == -1:
                    tok, own, size = opened([r])
                    yield from dealt(tok, own, size, np.full(len(tok), 255, np.uint8))
                    continue
                if r["part"] != part and held:
                    yield from one(held)
                    held = []
                part = r["part"]
                held.append(r)
        if held:
            yield from one(held)

    packed = packs.repartition(n, "pid").sortWithinPartitions("part")
    return packed.mapInArrow(run, "pid int, part int, cls binary, size binary, cnt binary, tok binary, freq binary")


def _alive(shared: DataFrame, n: int) -> DataFrame:
    """cls, n (size of the set), toks (shingles in other classes too, rarest first, packed), prefix (how many of them)."""
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("toks", pa.binary()), ("prefix", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks, owns, sizes, levels = [], [], [], []
        for b in batches:
            for r in b.to_pylist():
                cnt = np.frombuffer(r["cnt"], np.uint32)
                toks.append(_unsix(r["tok"]))
                owns.append(np.repeat(np.frombuffer(r["cls"], np.uint64), cnt))
                sizes.append(np.repeat(np.frombuffer(r["size"], np.uint32), cnt))
                levels.append(np.frombuffer(r["freq"], np.uint8))
        if not toks:
            return
        tok, own, size, level = map(np.concatenate, (toks, owns, sizes, levels))
        order = np.lexsort((tok, level, own))
        tok, own, size = tok[order], own[order], size[order].astype(np.int64)
        # Common shingles come once from each task that has a copy of the class.
        keep = np.concatenate([[True], (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])])
        tok, own, size = tok[keep], own[keep], size[keep]
        at, n_own = _runs(own)
        n_own, n = n_own.astype(np.int64), size[at]
        out = []
        for i in np.flatnonzero(DEN * n_own >= NUM * n):
            free = n[i] + (-NUM * n[i]) // DEN + 1  # n - ceil(3/4 n) + 1
            out.append((_signed(int(own[at[i]])), int(n[i]), _six(tok[at[i] : at[i] + n_own[i]]), int(min(n_own[i], free - (n[i] - n_own[i])))))
            if len(out) >= 2000:
                yield _batch(schema, out)
                out = []
        if out:
            yield _batch(schema, out)

    return shared.repartition(n, "pid").mapInArrow(run, "cls long, n long, toks binary, prefix int")


def _band(n: np.ndarray) -> np.ndarray:
    """Block of a size: a factor of 4/3, the most that linked sets differ by."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3) + 1e-9).astype(np.int32)


def _blocks(alive: DataFrame) -> DataFrame:
    """tok, band, cls, small: the blocks that a class takes part in, and whether it may be the smaller set of a link there.

    Of linked sets of n and m shingles at least 3 (n + m) / 7 are common.  A set with the first common
    shingle at position i has n - i left, so as the smaller one it needs 7 (n - i) >= 6 n, and
    as the larger one a partner of at most 7 (n - i) / 3 - n.
    """
    schema = pa.schema([("tok", pa.int64()), ("band", pa.int32()), ("cls", pa.int64()), ("small", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("prefix").to_numpy().astype(np.int64)
            packed = b.column("toks").to_pylist()
            if not len(k) or not k.sum():
                continue
            tok = np.concatenate([_unsix(t[: 6 * j]) for t, j in zip(packed, k)]).astype(np.int64)
            own = np.array([len(t) // 6 for t in packed])
            n, cls = np.repeat(b.column("n").to_numpy(), k), np.repeat(b.column("cls").to_numpy(), k)
            place = np.arange(len(tok)) - np.repeat(np.cumsum(k) - k, k) + n - np.repeat(own, k)
            small = 7 * (n - place) >= 6 * n
            band = _band(n)
            low, high = _band(-(-3 * n // 4)), _band(np.minimum(n, 7 * (n - place) // 3 - n))
            for move in (0, -1):
                at = band + move
                here = (low <= at) & (at <= high)
                role = small if move == 0 else np.zeros(len(tok), bool)
                here |= role
                yield pa.RecordBatch.from_arrays([pa.array(tok[here]), pa.array(at[here].astype(np.int32)), pa.array(cls[here]), pa.array(role[here])], schema=schema)

    return alive.mapInArrow(run, "tok long, band int, cls long, small boolean")


def _pairs_linked(pairs: DataFrame, alive: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    side = lambda x: alive.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("toks").alias(f"t{x}"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("a", "b", "na", "nb", "ta", "tb")))
            out = [(x, y) for x, y, n, m, s, t in rows if 7 * len(np.intersect1d(_unsix(s), _unsix(t), True)) >= 3 * (n + m)]
            if out:
                yield _batch(schema, out)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


class Group:
    """Classes of one tile with their inverted lists: sizes of the sets, their shared shingles (rarest first), how many are the prefix."""

    def __init__(self, n: np.ndarray, toks: list[np.ndarray], prefix: np.ndarray):
        self.n, self.m = n.astype(np.int64), len(n)
        self.shared = np.array([len(t) for t in toks], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.shared)])
        _, ids = np.unique(np.concatenate(toks), return_inverse=True)
        self.ids = ids.astype(np.int64)
        self.n_ids = int(self.ids.max()) + 1 if len(self.ids) else 0
        self.prefix = np.minimum(prefix.astype(np.int64), self.shared)
        own = np.repeat(np.arange(self.m), self.shared)
        place = np.arange(len(self.ids)) - self.at[own]
        self.posted, self.heads = self._lists(self.ids, own)
        first = place < self.prefix[own]
        self.first, self.first_heads = self._lists(self.ids[first], own[first])
        left = (self.shared[own] - place)[first]
        self.first_left = left[np.argsort(self.ids[first], kind="stable")]

    def _lists(self, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return own[np.argsort(ids, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=self.n_ids))])

    def own(self, i: int) -> np.ndarray:
        return self.ids[self.at[i] : self.at[i + 1]]

    @staticmethod
    def _places(heads: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens' lists, one after another, and the length of each."""
        a, k = heads[tokens], heads[tokens + 1] - heads[tokens]
        return np.repeat(a - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum()), k

    def _count(self, tokens: np.ndarray) -> np.ndarray:
        """For every class, how many of the tokens it has: reads these tokens' lists."""
        if not len(tokens):
            return np.zeros(self.m, np.int64)
        return np.bincount(self.posted[self._places(self.heads, tokens)[0]], minlength=self.m)

    def overlaps(self, i: int, known: tuple[int, np.ndarray] | None) -> np.ndarray:
        """Overlaps of class i with all, derived from those of a similar class where that reads less."""
        own = self.own(i)
        if known is not None:
            other = self.own(known[0])
            if 2 * known[1][i] > len(other):  # fewer tokens differ than i has
                return known[1] + self._count(np.setdiff1d(own, other, True)) - self._count(np.setdiff1d(other, own, True))
        return self._count(own)

    def candidates(self, i: int) -> np.ndarray:
        """Classes that share a prefix shingle with class i at places that admit a link."""
        mine = self.own(i)[: self.prefix[i]]
        at, k = self._places(self.first_heads, mine)
        y = self.first[at]
        left = np.minimum(np.repeat(self.shared[i] - np.arange(len(mine)), k), self.first_left[at])
        return np.unique(y[(7 * left >= 3 * (self.n[i] + self.n[y])) & (y != i)])

    def labels(self, derive: bool = True) -> np.ndarray:
        """Component of every class: all links found, pairs only looked at where they may matter."""
        lab, done, mark = np.arange(self.m), np.zeros(self.m, bool), np.zeros(self.n_ids, bool)
        members: dict[int, list[int]] = {i: [i] for i in range(self.m)}
        big = 0
        answers: list[tuple[int, np.ndarray]] = []
        while True:
            left = np.flatnonzero(~done & (lab != big))
            if not len(left):
                return lab
            for i in left.tolist():
                if lab[i] == big:
                    continue
                done[i] = True
                y = self.candidates(i)
                y = y[~done[y] & (lab[y] != lab[i])]
                need = -(-3 * (self.n[i] + self.n[y]) // 7)  # least overlap of a link
                best = np.minimum(self.shared[i], self.shared[y])
                for _, c in answers if derive else ():
                    best = np.minimum(best, np.minimum(c[i] + self.shared[y] - c[y], c[y] + self.shared[i] - c[i]))
                y, need = y[best >= need], need[best >= need]
                if not len(y):
                    continue
                own = self.own(i)
                if self.shared[y].sum() <= (self.heads[own + 1] - self.heads[own]).sum():
                    mark[own] = True
                    at, k = self._places(self.at, y)
                    c = np.add.reduceat(mark[self.ids[at]], np.cumsum(k) - k, dtype=np.int64)
                    mark[own] = False
                    linked = y[c >= need]
                else:
                    c = self.overlaps(i, max(answers, key=lambda x: x[1][i], default=None) if derive else None)
                    linked = y[c[y] >= need]
                    answers = [*answers[-3:], (i, c)]
                for other in set(lab[linked].tolist()):
                    a, b = sorted((int(lab[i]), other), key=lambda x: len(members[x]))
                    lab[members[a]] = b
                    members[b] += members.pop(a)
                    if len(members[b]) > len(members[big] if big in members else ()) or big == a:
                        big = b


def _work(tile: pa.Table) -> pa.Table:
    """Links within a tile, as pairs of a class and the least class of its component there."""
    cls = tile.column("cls").to_numpy()
    lab = Group(tile.column("n").to_numpy(), [_unsix(t) for t in tile.column("toks").to_pylist()], tile.column("prefix").to_numpy()).labels()
    head = np.full(len(cls), np.iinfo(np.int64).max)
    np.minimum.at(head, lab, cls)
    joined = head[lab] != cls
    return pa.table({"a": pa.array(cls[joined], pa.int64()), "b": pa.array(head[lab][joined], pa.int64())})


def _groups(alive: DataFrame) -> DataFrame:
    """cls, grp: every two linked classes are together in some group."""
    lists = _blocks(alive)
    heads = lists.groupBy("tok", "band").agg(F.min(F.when(F.col("small"), F.col("cls"))).alias("head"), F.min("cls").alias("_lo"), F.max("cls").alias("_hi"))
    heads = heads.where(F.col("head").isNotNull() & (F.col("_lo") < F.col("_hi"))).select("tok", "band", "head")
    meets = materialize(lists.join(heads, ["tok", "band"]).select("cls", "head").distinct(), "meets")
    own = meets.select(F.col("head").alias("cls")).distinct()
    met = meets.where("cls <> head").join(own, "cls").select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b")).distinct()
    joined = components(_pairs_linked(met, alive)).select(F.col("node").alias("head"), "label")
    return meets.join(joined, "head", "left").select("cls", F.coalesce("label", "head").alias("grp")).distinct()


def _links(alive: DataFrame) -> DataFrame:
    """Pairs (a, b) whose closure has all links between alive classes."""
    groups = materialize(_groups(alive), "groups").join(alive, "cls")
    parts = groups.groupBy("grp").agg(F.ceil(F.sum(F.octet_length("toks")) / F.lit(TILE_BYTES)).cast("int").alias("k"))
    part = F.pmod(F.xxhash64("cls"), F.col("k")).cast("int")
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("k") - 1), F.array("part")))
    tiles = groups.join(parts, "grp").withColumn("part", part).withColumn("other", F.explode(others))
    tiles = tiles.select("grp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "cls", "n", "toks", "prefix")
    return tiles.groupBy("grp", "i", "j").applyInArrow(_work, "a long, b long")


def _linked(docs: DataFrame, key: str, text: str, carry: bool) -> tuple[DataFrame, DataFrame]:
    """The rows, and for every class cls, cls2 the struct ``best`` (no key, key, at) of the row that names its component."""
    spark = docs.sparkSession
    found = materialize(_rows(docs, key, text, carry), "classes")
    rows = found.where("n >= 0")
    # At most 1 / COMMON_SHARE times the mean size of a set.
    common = found.where("n < 0").groupBy("cls").agg(F.sum("cls2").alias("many")).where(F.col("many") >= COMMON_SHARE * rows.count()).select("cls")
    common = np.array(sorted(r[0] for r in common.collect()), np.uint64)
    # Lists are held in a task whole: half as much in each as in other shuffles.
    n = 2 * shuffle_partitions(spark)
    keys = _partition_keys(spark, n)
    texts = docs.select(docs[text].cast("string").alias("text"))
    alive = materialize(_alive(_shared(_packed_lists(texts, "text", keys, common), keys), n), "alive")
    labels = components(_links(alive)).withColumnRenamed("node", "cls")
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "at")).alias("best")
    classes = rows.where("n > 0").groupBy("cls", "cls2").agg(best).join(labels, "cls", "left")
    # A class without links is alone with its whole digest, whatever else has the first half of it.
    classes = classes.select("cls", "cls2", "best", F.coalesce("label", "cls").alias("c"), F.when(F.col("label").isNull(), F.col("cls2")).otherwise(F.lit(0)).alias("c2"))
    classes = materialize(classes, "labels")
    least = classes.groupBy("c", "c2").agg(F.min("best").alias("least"))
    return rows, materialize(classes.join(least, ["c", "c2"]).select("cls", "cls2", F.col("least").alias("best")), "named")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id: the smallest key reachable over links, of every row."""
    rows, named = _linked(docs, key, text, False)
    some = rows.where("n > 0").join(named, ["cls", "cls2"]).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("best.key").alias("component_id"))
    return some.unionByName(rows.where("n = 0").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each component: that of the smallest key, null last; rows with the empty set all stay.

    Of equal keys in one component one row stays; rows in different components all do, whatever their keys.
    """
    rows, named = _linked(docs, key, text, True)
    keep = named.select(F.col("best.at").alias("at")).distinct()
    return rows.where("n > 0").join(keep, "at", "left_semi").select("row.*").unionByName(rows.where("n = 0").select("row.*"))
