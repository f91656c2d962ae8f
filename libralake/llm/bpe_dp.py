"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that its encoding
ends with.  Scanning an automaton of the vocabulary over the piece gives, at each
position, the tokens that end there; the right one is the one that is compatible
with the last token of the prefix before it (two tokens are compatible when
encoding their concatenation gives back the two).  Following back-pointers from
the end emits the exact ids, and counting along them gives the token count of
every prefix.  Compatibility of a pair is decided once and remembered.

Words in order mostly begin as the word before them: ``totals`` keeps the table of
that word and fills in only what follows the common prefix.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from math import inf

import ahocorasick

#: Pairs of tokens whose compatibility is remembered, over all tasks of a worker, where no other number is given: about 20 MB.
MOST_PAIRS = 150_000


class PrefixBpe:
    """``rank(a, b)`` is the priority of merging two adjacent symbols (None: never); lower goes first.

    ``symbols`` splits a string into the units that merging starts from (single characters by default).
    Tokens are handled by number; ``names`` has their strings.
    """

    def __init__(self, tokens: Iterable[str], rank: Callable[[str, str], int | None], symbols: Callable[[str], list[str]] = list, most_pairs: int = MOST_PAIRS):
        self.names = list(tokens)
        self.rank, self.symbols, self.most_pairs = rank, symbols, most_pairs
        self.lengths = [len(t) for t in self.names]
        self.known = frozenset("".join(self.names))
        #: For (token before + 1) * size + token: whether the two are compatible; before 0: whether the token stands alone.
        self._fits: dict[int, bool] = {}
        #: By token, for those that were asked for: under 1 KB each.
        self._traces: dict[int, tuple | None] = {}
        self._auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(self.names):
            self._auto.add_word(t, i)
        self._auto.make_automaton()

    def merge(self, s: str, steps: list[tuple] | None = None) -> list[str]:
        """Plain merging by priority, leftmost first: the definition, used on tokens and pairs of them only.

        ``steps`` gets the priority of each merge, and the first and the last part after it.
        """
        parts = self.symbols(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))
        return parts

    def _trace(self, tok: int) -> tuple | None:
        """How a token comes about by itself: priorities of its merges, and its first and its last part before each and at the end; None if it does not."""
        if tok not in self._traces:
            parts, steps = self.symbols(self.names[tok]), []
            alone = len(self.merge(self.names[tok], steps)) == 1
            ranks, firsts, lasts = zip(*steps) if steps else ((), (), ())
            self._traces[tok] = ((*ranks, inf), (parts[0], *firsts), (parts[-1], *lasts)) if alone else None
        return self._traces[tok]

    def _apart(self, before: int, tok: int) -> bool:
        """Whether two tokens, merged together from single characters, stay apart: both go their own way until a merge over the seam comes first."""
        a, b = self._trace(before), self._trace(tok)
        if a is None or b is None:
            return False
        (left, _, lasts), (right, firsts, _) = a, b
        i = j = 0
        while True:
            r = self.rank(lasts[i], firsts[j])
            if r is not None and r < left[i] and r <= right[j]:
                return False
            if left[i] <= right[j]:
                if left[i] == inf:
                    return True
                i += 1
            else:
                j += 1

    def _decide(self, before: int, tok: int) -> bool:
        if len(self._fits) >= self.most_pairs:
            self._fits.clear()
        if before < 0:
            ok = self.merge(self.names[tok]) == [self.names[tok]]
        elif self.symbols is list:
            ok = self._apart(before, tok)
        else:  # the units of a pair need not be those of its tokens
            ok = self.merge(self.names[before] + self.names[tok]) == [self.names[before], self.names[tok]]
        self._fits[(before + 1) * len(self.names) + tok] = ok
        return ok

    def last_tokens(self, s: str) -> list[int]:
        """The last token of every prefix; entry i is for ``s[:i]`` (-1: empty, or no encoding ends there)."""
        n = len(s)
        last = [-2] * (n + 1)
        last[0] = -1
        fits, lengths, size = self._fits.get, self.lengths, len(self.names)
        for end, tok in self._auto.iter(s):
            end += 1
            if last[end] == -2:
                before = last[end - lengths[tok]]
                if before != -2:
                    ok = fits((before + 1) * size + tok)
                    if ok if ok is not None else self._decide(before, tok):
                        last[end] = tok
        return last

    @cached_property
    def _nodes(self) -> tuple[list[dict[str, int]], list[int], list[tuple[int, ...]]]:
        """The automaton as lists by node, so that a scan can go on in the middle of a word: children, node of the longest suffix, tokens that end there."""
        children, ends = [{}], [()]
        for i, t in enumerate(self.names):
            at = 0
            for ch in t:
                if ch not in children[at]:
                    children[at][ch] = len(children)
                    children.append({})
                    ends.append(())
                at = children[at][ch]
            ends[at] = (i,)
        shorter = [0] * len(children)
        queue = [*children[0].values()]
        for at in queue:
            ends[at] += ends[shorter[at]]
            for ch, child in children[at].items():
                queue.append(child)
                to = shorter[at]
                while to and ch not in children[to]:
                    to = shorter[to]
                shorter[child] = children[to].get(ch, 0)
        return children, shorter, ends

    def totals(self, words: Iterable[str], outside: Callable[[str], int]) -> Iterator[int]:
        """Token count of each word; the table of a word is kept as far as the next one begins alike.

        A character in no token counts ``outside`` of it, and nothing merges over it.
        """
        children, shorter, ends = self._nodes
        fits, lengths, size = self._fits.get, self.lengths, len(self.names)
        node, last, counts = [0], [-1], [0]
        previous = ""
        for word in words:
            end = 0
            for a, b in zip(word, previous):
                if a != b:
                    break
                end += 1
            previous = word
            if len(word) >= len(last):
                more = len(word) + 1 - len(last)
                node += [0] * more
                last += [-2] * more
                counts += [0] * more
            at = node[end]
            for ch in word[end:]:
                end += 1
                to = children[at].get(ch)
                while to is None and at:
                    at = shorter[at]
                    to = children[at].get(ch)
                node[end] = at = to or 0
                for tok in ends[at]:
                    start = end - lengths[tok]
                    before = last[start]
                    if before != -2:
                        ok = fits((before + 1) * size + tok)
                        if ok if ok is not None else self._decide(before, tok):
                            last[end], counts[end] = tok, counts[start] + 1
                            break
                else:
                    last[end], counts[end] = (-2, -1) if ch in self.known else (-1, counts[end - 1] + outside(ch))
            yield counts[len(word)]

    def encode(self, s: str) -> list[int]:
        """The tokens of ``s``, whose characters are all in the vocabulary."""
        last, at, out = self.last_tokens(s), len(s), []
        while at:
            tok = last[at]
            if tok < 0:
                raise ValueError(f"no encoding of {s!r}")
            out.append(tok)
            at -= self.lengths[tok]
        out.reverse()
        return out

    def prefix_counts(self, s: str) -> list[int]:
        """Token count of every prefix of ``s`` (-1 where a prefix has none)."""
        counts = [0] * (len(s) + 1)
        for i, tok in enumerate(self.last_tokens(s)):
            if i:
                counts[i] = counts[i - self.lengths[tok]] + 1 if tok >= 0 else -1
        return counts


class Remembered(dict):
    """Computed values in bounded memory: when the newer generation fills half of ``most_bytes``, the older one goes."""

    most_bytes = 24 << 20

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        """Drops all values; done at the end of every task, so that workers kept for later work hold no more than the model."""
        self.clear()
        self.older: dict = {}
        self.room = self.most_bytes // 2

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > 64:
                return value
        # Both objects and their place in a dictionary that is two thirds full.
        self.room -= sys.getsizeof(key) + sys.getsizeof(value) + 104
        if self.room < 0:
            self.older = dict(self)
            self.clear()
            self.room = self.most_bytes // 2
        self[key] = value
        return value
