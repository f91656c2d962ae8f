"""External induced sorting: the order of all suffixes of a text, and what neighbours have in common, in bounded memory.

Symbols are numbers above 0; the text ends with the only 0.  A suffix is of type S where it is smaller than the next
one, else L; an S suffix after an L suffix is a seed.

1. The substrings from seed to seed get names by their order.  The names are a text of their own, at most half as long; its suffixes
   are sorted by doubling where it fits in memory, else by the same steps again (recursive induction).
2. Seeds in this order induce the L suffixes: whoever leaves the priority queue puts the suffix one symbol longer
   into it, if that is L.  The queue is ordered by first symbol and, within one, by the order of arrival.
3. L suffixes, last first, induce the S suffixes in the same way.

Tuples in the queue carry a suffix's place, the symbols before it, and the length of its common prefix with the tuple
before it under the same symbol: one more than the least such length between the two that induced them.
Beyond ``most`` tuples a queue writes a sorted run to the scratch folder; texts beyond ``most`` symbols are read by blocks.  What stays
in memory: ``most`` tuples a queue, blocks of texts, a number for each symbol in use.

Order and lengths hold up to ``depth`` symbols: suffixes that agree in so many are neighbours, in any order.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
from pyarrow import fs as pafs

BLOCK = 1 << 16
#: Tuples that are handled at once.
BATCH = 1 << 18
#: Bytes of a log that stay in memory.
HOLD = 16 << 20
_TUPLE = (np.int64, np.uint64, np.uint8, np.uint8)  # place, symbols before it, how many of them, common prefix


class Scratch:
    """A folder of files, on any file system that Arrow opens."""

    def __init__(self, uri: str):
        self.fs, self.base = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.base, recursive=True)
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n}"

    def close(self) -> None:
        self.fs.delete_dir(self.base)


class Log:
    """Batches of columns in the order of writing: in memory up to ``HOLD`` bytes, on disk beyond."""

    def __init__(self, scratch: Scratch, kinds: tuple, batch: int | None = None):
        self.scratch, self.kinds, self.batch = scratch, [np.dtype(k) for k in kinds], batch or BATCH
        self.path = self.out = self.file = None
        self.at, self.bytes = 0, 0
        self.index: list[tuple[int, int, list[np.ndarray] | None]] = []  # place on disk, rows, columns in memory
        self.near: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.near.append(columns)
        self.size += len(columns[0])
        if self.size >= self.batch:
            self._write()

    def _write(self) -> None:
        if not self.size:
            return
        cols = [np.concatenate([c[k] for c in self.near]).astype(kind, copy=False) for k, kind in enumerate(self.kinds)]
        size = self.size * sum(k.itemsize for k in self.kinds)
        if self.bytes + size <= HOLD:
            self.index.append((0, self.size, cols))
            self.bytes += size
        else:
            if self.out is None:
                self.path = self.scratch.path()
                self.out = self.scratch.fs.open_output_stream(self.path)
            for c in cols:
                self.out.write(c.tobytes())
            self.index.append((self.at, self.size, None))
            self.at += size
        self.near, self.size = [], 0

    def close(self) -> Log:
        self._write()
        if self.out is not None:
            self.out.close()
            self.file = self.scratch.fs.open_input_file(self.path)
        return self

    def drop(self) -> None:
        self.index = []
        if self.file is not None:
            self.file.close()
            self.scratch.fs.delete_file(self.path)

    def read(self, i: int) -> list[np.ndarray]:
        at, n, held = self.index[i]
        if held is not None:
            return held
        out = []
        for k in self.kinds:
            out.append(np.frombuffer(self.file.read_at(n * k.itemsize, at), k))
            at += n * k.itemsize
        return out


class Cursor:
    """A log whose first column ascends, read group by group."""

    def __init__(self, log: Log):
        self.log, self.i, self.ptr, self.now = log, 0, 0, None
        self._load()

    def _load(self) -> None:
        self.now = self.log.read(self.i) if self.i < len(self.log.index) else None
        self.i, self.ptr = self.i + 1, 0

    def head(self) -> int | None:
        return None if self.now is None else int(self.now[0][self.ptr])

    def take(self, key: int) -> Iterator[list[np.ndarray]]:
        while self.now is not None and self.now[0][self.ptr] == key:
            end = int(np.searchsorted(self.now[0], key, "right"))
            yield [c[self.ptr : end] for c in self.now[1:]]
            self.ptr = end
            if end == len(self.now[0]):
                self._load()


class Queue:
    """Disk-backed priority queue of suffix tuples: smallest key first, within a key in the order of arrival."""

    def __init__(self, scratch: Scratch, most: int):
        self.scratch, self.most = scratch, most
        self.near: dict[int, list[tuple]] = {}
        self.size, self.keys, self.runs = 0, [], []

    def insert(self, key: int, columns: tuple) -> None:
        if key not in self.near:
            self.near[key] = []
            heapq.heappush(self.keys, key)
        self.near[key].append(columns)
        self.size += len(columns[0])
        if self.size > self.most:
            log = Log(self.scratch, (np.int64, *_TUPLE))
            for key in sorted(self.near):
                for c in self.near[key]:
                    log.add(np.full(len(c[0]), key, np.int64), *c)
            self.runs.append(Cursor(log.close()))
            self.near, self.keys, self.size = {}, [], 0

    def head(self) -> int | None:
        while self.keys and self.keys[0] not in self.near:
            heapq.heappop(self.keys)
        for run in [r for r in self.runs if r.now is None]:
            run.log.drop()
            self.runs.remove(run)
        return min((*self.keys[:1], *(r.head() for r in self.runs)), default=None)

    def take(self, key: int) -> Iterator[tuple]:
        """All tuples of a key, those that arrive meanwhile included."""
        while True:
            some = False
            for run in self.runs:  # an older run has what arrived earlier
                for c in run.take(key):
                    some = True
                    yield tuple(c)
            near = self.near.pop(key, [])
            self.size -= sum(len(c[0]) for c in near)
            for part in _batches(near):
                some = True
                yield part
            if not some:
                return


def _batches(parts: list[tuple]) -> Iterator[tuple]:
    """Small parts put together."""
    some, n = [], 0
    for part in parts:
        some.append(part)
        n += len(part[0])
        if n >= BATCH:
            yield tuple(np.concatenate(c) for c in zip(*some)) if len(some) > 1 else part
            some, n = [], 0
    if some:
        yield tuple(np.concatenate(c) for c in zip(*some)) if len(some) > 1 else some[0]


class Symbols:
    """A text on disk; one of at most ``most`` symbols is held, a longer one read by blocks."""

    def __init__(self, log: Log, n: int, bits: int, most: int):
        self.log, self.n, self.bits, self.most = log, n, bits, most
        self.ends = np.cumsum([k for _, k, _ in log.index])
        self.held = np.concatenate([log.read(i)[0] for i in range(len(log.index))]) if n <= most else None
        self.blocks: dict[int, np.ndarray] = {}

    def at(self, place: np.ndarray) -> np.ndarray:
        if self.held is not None:
            return self.held[place]
        out = np.empty(len(place), self.log.kinds[0])
        block = np.searchsorted(self.ends, place, "right")
        by = np.argsort(block, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(block[by])) + 1) if len(by) else ():
            i = int(block[part[0]])
            if i not in self.blocks:
                while self.blocks and (len(self.blocks) + 1) * self.log.batch > self.most:
                    self.blocks.pop(next(iter(self.blocks)))
                self.blocks[i] = self.log.read(i)[0]
            out[part] = self.blocks[i][place[part] - (self.ends[i - 1] if i else 0)]
        return out

    def previous(self, place: np.ndarray, ctx: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbol before each place (0 before the first), and what the longer suffixes carry."""
        none = np.flatnonzero(left == 0)
        if len(none):
            ctx, left, p = ctx.copy(), left.copy(), place[none]
            each = 64 // self.bits
            word = np.zeros(len(p), np.uint64)
            for j in range(each):
                word |= self.at(np.maximum(p - 1 - j, 0)).astype(np.uint64) << np.uint64(self.bits * j)
            ctx[none], left[none] = word, np.minimum(p, each)
        d = np.where(place > 0, ctx & np.uint64((1 << self.bits) - 1), 0).astype(np.int64)
        return d, ctx >> np.uint64(self.bits), np.where(place > 0, left - 1, 0).astype(np.uint8)

    def run(self, place: int, depth: int) -> int:
        """How often the symbol at a place stands there in a row, up to ``depth``."""
        own = self.at(np.arange(place, min(self.n, place + depth)))
        other = np.flatnonzero(own != own[0])
        return int(other[0]) if len(other) else len(own)


def least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of ``values[a..b]``, both included, for many ranges at once."""
    n = b - a + 1
    level = np.frexp(n.astype(np.float64))[1] - 1
    table = np.empty((int(level.max()) + 1, len(values)), values.dtype)
    table[0] = values
    for k in range(1, len(table)):
        h = 1 << (k - 1)
        table[k] = table[k - 1]
        np.minimum(table[k - 1][:-h], table[k - 1][h:], out=table[k][:-h])
    return np.minimum(table[level, a], table[level, b - (1 << level) + 1])


class Inducer:
    """Puts suffixes one symbol longer into the queue, with their common prefixes."""

    def __init__(self, queue: Queue, sign: int, depth: int):
        self.queue, self.sign, self.depth = queue, sign, depth
        self.seen: set[int] = set()
        self.since: dict[int, int] = {}

    def next_symbol(self) -> None:
        """Suffixes of different symbols have nothing in common."""
        self.since = {}

    def push(self, which: np.ndarray, d: np.ndarray, place: np.ndarray, ctx: np.ndarray, left: np.ndarray, lcp: np.ndarray) -> None:
        i = np.flatnonzero(which)
        floor = int(lcp.min())
        if not len(i):
            self.since = {s: min(v, floor) for s, v in self.since.items()}
            return
        # Small numbers are sorted by digits.
        i = i[np.argsort(d[i].astype(np.uint16) if d.max() < 1 << 16 else d[i], kind="stable")]
        s = d[i]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        low = np.zeros(len(i), np.int64)
        inner = np.ones(len(i), bool)
        inner[first] = False
        j = np.flatnonzero(inner)
        if len(j):
            low[j] = least(lcp, i[j - 1] + 1, i[j])
        low += 1
        before = np.minimum.accumulate(lcp)
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.depth)
        since = {k: min(v, floor) for k, v in self.since.items()}
        cols = [place[i] - 1, ctx[i], left[i]]
        ends = np.append(first[1:], len(i))
        for symbol, a, b in zip(s[first].tolist(), first.tolist(), ends.tolist()):
            if symbol in self.since:
                low[a] = 1 + min(self.since[symbol], int(before[i[a]]))
            else:
                low[a] = symbol in self.seen
                self.seen.add(symbol)
            since[symbol] = int(after[i[b - 1] + 1])
            self.queue.insert(self.sign * symbol, (*(c[a:b] for c in cols), np.minimum(low[a:b], self.depth).astype(np.uint8)))
        self.since = since


def _cut(columns: tuple, size: int = BATCH) -> Iterator[tuple]:
    for a in range(0, len(columns[0]), size):
        yield tuple(c[a : a + size] for c in columns)


def _place(n: int) -> type:
    """The kind of number for places in a text."""
    return np.uint32 if n < 1 << 32 else np.int64


def _unread(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tuples that carry no symbols yet."""
    return np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint8)


def induce(text: Symbols, seeds: Log, scratch: Scratch, most: int, depth: int, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """From the seeds in ascending order (symbol and tuple), all suffixes in descending order: ``emit`` gets places, and what each has in common with the one before it."""
    queue, heads = Queue(scratch, most), Cursor(seeds)
    inducer = Inducer(queue, 1, depth)
    larger = Log(scratch, (text.log.kinds[0], _place(text.n), np.uint8, np.bool_))
    while (c := min((x for x in (queue.head(), heads.head()) if x is not None), default=None)) is not None:
        inducer.next_symbol()
        last = -1
        for whole in queue.take(c):
            for place, ctx, left, lcp in _cut(whole):
                d, ctx2, left2 = text.previous(place, ctx, left)
                larger.add(np.full(len(place), c, text.log.kinds[0]), place, lcp, (place > 0) & (d < c))
                inducer.push((place > 0) & (d >= c), d, place, ctx2, left2, lcp)
                last = int(place[-1])
        for whole in heads.take(c):
            for place, lcp in _cut(whole):
                place = place.astype(np.int64)
                if last >= 0:
                    lcp = lcp.copy()
                    lcp[0] = min(text.run(last, depth), text.run(int(place[0]), depth))
                    last = -1
                d, ctx, left = text.previous(place, *_unread(place))
                inducer.push(place > 0, d, place, ctx, left, lcp)
    larger.close()
    queue = Queue(scratch, most)
    inducer = Inducer(queue, -1, depth)
    back = _backwards(larger)
    now = next(back, None)
    while (c := max((x for x in (None if queue.head() is None else -queue.head(), now and int(now[0])) if x is not None), default=None)) is not None:
        inducer.next_symbol()
        last = -1
        for whole in queue.take(-c):
            for place, ctx, left, lcp in _cut(whole):
                d, ctx2, left2 = text.previous(place, ctx, left)
                emit(place, lcp)
                inducer.push((place > 0) & (d <= c), d, place, ctx2, left2, lcp)
                last = int(place[-1])
        ahead = None  # what the suffix handled last has in common with the next smaller one
        while now is not None and now[0] == c:
            _, place, lcp, star = now
            place = place.astype(np.int64)
            mine = np.concatenate([[0 if ahead is None else ahead], lcp[:-1]]).astype(np.uint8)
            if ahead is None and last >= 0:
                mine[0] = min(text.run(last, depth), text.run(int(place[0]), depth))
            ahead = int(lcp[-1])
            emit(place, mine)
            d, ctx, left = text.previous(place, *_unread(place))
            inducer.push(star, d, place, ctx, left, mine)
            now = next(back, None)
    larger.drop()
    emit(np.array([text.n - 1]), np.zeros(1, np.uint8))


def _backwards(log: Log) -> Iterator[tuple]:
    """Batches of one symbol each, from the last tuple to the first."""
    for i in range(len(log.index) - 1, -1, -1):
        cols = [c[::-1] for c in log.read(i)]
        for part in np.split(np.arange(len(cols[0])), np.flatnonzero(np.diff(cols[0])) + 1):
            yield (cols[0][part[0]], *(c[part[0] : part[-1] + 1] for c in cols[1:]))


def seed_places(text: Symbols, scratch: Scratch, step: int) -> tuple[Log, int]:
    """Places of all seeds in ascending order, the last symbol included."""
    parts = Log(scratch, (np.int64,), 1)
    parts.add(np.array([text.n - 1]))
    right_symbol, right_small = 0, True  # the last symbol
    for b in range(text.n - 1, 0, -step):
        a = max(0, b - step)
        s = text.at(np.arange(a, b)).astype(np.int64)
        nxt = np.append(s[1:], right_symbol)
        other = np.where(s != nxt, np.arange(len(s)), len(s))
        other = np.minimum.accumulate(other[::-1])[::-1]
        small = np.append(s < nxt, right_small)[other]
        both = np.append(small, right_small)
        places = a + 1 + np.flatnonzero(both[1:] & ~both[:-1])
        if places.size and places[-1] != text.n - 1:
            parts.add(places)
        elif places.size > 1:
            parts.add(places[:-1])
        right_symbol, right_small = int(s[0]), bool(small[0])
    parts.close()
    out, n = Log(scratch, (np.int64,), BLOCK), 0
    for i in range(len(parts.index) - 1, -1, -1):
        out.add(parts.read(i)[0])
        n += parts.index[i][1]
    parts.drop()
    return out.close(), n


def _words(text: Symbols, place: np.ndarray, size: np.ndarray, skip: int) -> np.ndarray:
    """The next symbols of substrings after ``skip`` of them, as one number; what has ended is filled with ones."""
    each = 64 // text.bits
    word = np.zeros(len(place), np.uint64)
    for j in range(skip, skip + each):
        sym = text.at(np.minimum(place + j, text.n - 1)).astype(np.uint64)
        sym[j >= size] = (1 << text.bits) - 1
        word = (word << np.uint64(text.bits)) | sym
    return word


def names(text: Symbols, place: np.ndarray, size: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of substrings by their order; equal ones share a number.  One that goes on is smaller than one that has ended."""
    code = np.unique(word, return_inverse=True)[1].astype(np.int64)
    each, t = 64 // text.bits, 64 // text.bits
    while t < depth and (more := size > t).any():
        some = np.zeros(code.max() + 1, bool)
        some[code[more]] = True
        sub = np.flatnonzero(some[code])
        w = np.full(len(sub), np.uint64(2**64 - 1))
        on = size[sub] > t
        w[on] = _words(text, place[sub[on]], size[sub[on]], t)
        by = np.lexsort((w, code[sub]))
        c, w = code[sub][by], w[by]
        new_code = np.concatenate([[True], c[1:] != c[:-1]])
        step = new_code | np.concatenate([[True], w[1:] != w[:-1]])
        within = np.cumsum(step) - 1
        within -= within[np.flatnonzero(new_code)][np.cumsum(new_code) - 1]
        n = np.ones(len(some), np.int64)
        np.maximum.at(n, c, within + 1)
        base = np.cumsum(n) - n
        code = base[code]
        code[sub[by]] += within
        t += each
    return code


def doubled(name: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a text of names in memory, in order, and how many names each has in common with the one before it."""
    m = len(name)
    rank, rounds, h = name.astype(np.int64), [name.astype(np.int32)], 1
    while rank.max() + 1 < m and 2 * h < depth + 2:
        key = rank * (m + 1)
        key[: m - h] += rank[h:] + 1
        by = np.argsort(key)
        rank[by] = np.cumsum(np.concatenate([[0], np.diff(key[by]) != 0]))
        rounds.append(rank.astype(np.int32))
        h *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(rounds) - 1, -1, -1):
        inside = (a < m) & (b < m)
        same = np.flatnonzero(inside)[rounds[k][a[inside]] == rounds[k][b[inside]]]
        a[same] += 1 << k
        b[same] += 1 << k
    return order, np.append([0], b - order[1:])


def _reduced(text: Symbols, seeds: Symbols, scratch: Scratch, most: int, depth: int) -> tuple[Log, int]:
    """The text of names, and the largest of them.  Beyond ``most`` seeds substrings are dealt to files by their first word, and the names back by place."""

    def sized(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = seeds.at(i)
        return p, np.where(i + 1 < seeds.n, seeds.at(np.minimum(i + 1, seeds.n - 1)) - p + 1, 1)

    out = Log(scratch, (np.uint32,), BLOCK)
    if seeds.n <= most:
        p, size = sized(np.arange(seeds.n))
        code = names(text, p, size, _words(text, p, size, 0), depth)
        for a in range(0, len(code), BLOCK):
            out.add(code[a : a + BLOCK])
        return out.close(), int(code.max())
    spans = [(a, min(seeds.n, a + most // 8)) for a in range(0, seeds.n, most // 8)]
    dealt = lambda i: (i, *(s := sized(i)), _words(text, *s, 0))
    sample = np.sort(np.concatenate([dealt(np.arange(a, b, 16))[3] for a, b in spans]))
    cuts = np.unique(sample[:: max(1, most // 32)])
    parts = [Log(scratch, (np.int64, np.int64, np.int64, np.uint64), BLOCK) for _ in range(len(cuts) + 1)]
    for a, b in spans:
        cols = dealt(np.arange(a, b))
        to = np.searchsorted(cuts, cols[3], "right")
        for k in np.unique(to):
            parts[k].add(*(c[to == k] for c in cols))
    back = [Log(scratch, (np.int64, np.uint32), BLOCK) for _ in spans]
    base = 0
    for log in parts:
        log.close()
        if log.index:
            i, p, size, word = (np.concatenate(c) for c in zip(*(log.read(k) for k in range(len(log.index)))))
            code = base + names(text, p, size, word, depth)
            base = int(code.max()) + 1
            to = i // (most // 8)
            for k in np.unique(to):
                back[k].add(i[to == k], code[to == k])
        log.drop()
    for log in back:
        log.close()
        i, code = (np.concatenate(c) for c in zip(*(log.read(k) for k in range(len(log.index)))))
        out.add(code[np.argsort(i)])
        log.drop()
    return out.close(), base - 1


def _common(text: Symbols, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffixes that are known to agree in ``known`` symbols."""
    out = known.copy()
    now = np.flatnonzero(out < depth)
    while len(now):
        now = now[text.at(a[now] + out[now]) == text.at(b[now] + out[now])]
        out[now] += 1
        now = now[out[now] < depth]
    return out


def sort(text: Symbols, scratch: Scratch, most: int, depth: int, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """All suffixes of the text in descending order, as batches for ``emit``: places, and common prefixes with the suffix before."""
    log, m = seed_places(text, scratch, min(most, BATCH))
    seeds = Symbols(log, m, 64, most)
    reduced, top = _reduced(text, seeds, scratch, most, depth)
    sorted_seeds = Log(scratch, (text.log.kinds[0], _place(text.n), np.uint8))
    before = [np.int64(-1)]

    def seed(i: np.ndarray, same: np.ndarray) -> None:
        """Seeds in ascending order, and how many names each has in common with the one before it."""
        place = seeds.at(i)
        prev = np.append(before[0], place[:-1])
        known = np.minimum(seeds.at(np.minimum(i + same, m - 1)) - place, depth)
        if first := before[0] < 0:
            known[0] = depth
        lcp = _common(text, prev, place, known, depth)
        lcp[0] *= not first
        before[0] = place[-1]
        sorted_seeds.add(text.at(place), place, lcp.astype(np.uint8))

    if m <= most:
        name = np.concatenate([reduced.read(i)[0] for i in range(len(reduced.index))])
        order, same = (np.argsort(name), np.zeros(m, np.int64)) if top + 1 == m else doubled(name, depth)
        for a in range(0, m, BATCH):
            seed(order[a : a + BATCH], same[a : a + BATCH])
    else:
        found = Log(scratch, (np.int64, np.uint8))
        sort(Symbols(reduced, m, 32, most), scratch, most, depth, lambda place, lcp: found.add(place, lcp))
        found.close()
        ahead = 0
        for i in range(len(found.index) - 1, -1, -1):
            place, lcp = (c[::-1] for c in found.read(i))
            # A common prefix is with the next larger one; here it goes to that one.
            seed(place, np.append(ahead, lcp[:-1]).astype(np.int64))
            ahead = int(lcp[-1])
        found.drop()
    reduced.drop()
    sorted_seeds.close()
    induce(text, sorted_seeds, scratch, most, depth, emit)
    sorted_seeds.drop()
    log.drop()
