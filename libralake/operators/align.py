"""Alignment of two texts by the lengths of their paragraphs, and of words by edit distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Paragraphs taken on either side and what the shape costs.
SHAPES = ((1, 1, 0.0), (1, 0, 3.0), (0, 1, 3.0), (2, 1, 1.2), (1, 2, 1.2), (2, 2, 2.0))


def by_length(a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
    """Beads of paragraphs that belong together, of least cost within a band around the diagonal.

    A bead costs its shape and four times how far the log ratio of its lengths is from that of the whole texts.
    """
    n, m = len(a), len(b)
    ratio = max(0.2, sum(b) / max(1, sum(a)))
    # Wide enough that the bands of neighbouring rows meet, however unequal the sides are.
    band = max(min(400, max(30, math.ceil(0.15 * max(n, m)))), math.ceil(m / max(1, n)) + 2)
    # Logarithms of the lengths of no, one and two paragraphs that end at each place.
    logs = lambda xs, scale: [[math.log((sum(xs[max(0, i - d) : i]) + 20) * scale) for i in range(len(xs) + 1)] for d in range(3)]
    la, lb = logs(a, ratio), logs(b, 1.0)
    inf = math.inf
    lows: list[int] = []
    costs: list[list[float]] = []
    moves: list[list[tuple[int, int] | None]] = []
    for i in range(n + 1):
        mid = round(i * m / max(1, n))
        low, high = max(0, mid - band), min(m, mid + band)
        row, move = [inf] * (high - low + 1), [None] * (high - low + 1)
        before = [(row, low), *((costs[i - d], lows[i - d]) if i >= d else ([], 0) for d in (1, 2))]
        for j in range(low, high + 1):
            best, how = (0.0, None) if i == j == 0 else (inf, None)
            for di, dj, shape in SHAPES:
                prev, start = before[di]
                k = j - dj - start
                if 0 <= k < len(prev) and j >= dj:
                    c = prev[k] + shape + 4 * abs(lb[dj][j] - la[di][i])
                    if c < best:
                        best, how = c, (di, dj)
            row[j - low], move[j - low] = best, how
        lows.append(low)
        costs.append(row)
        moves.append(move)
    out, i, j = [], n, m
    while (i or j) and 0 <= j - lows[i] < len(moves[i]) and moves[i][j - lows[i]]:
        di, dj = moves[i][j - lows[i]]
        out.append((list(range(i - di, i)), list(range(j - dj, j))))
        i, j = i - di, j - dj
    return out[::-1]


def align_arrays(rows: DataFrame, pair: str, a: str, b: str) -> DataFrame:
    """pair, bead, a, b (places from 0, joined by commas) for rows with the lengths of both sides' paragraphs in order; null sides are empty."""
    kind = rows.schema[pair].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = lambda xs: ",".join(map(str, xs))
        some = lambda x: [] if x is None else x.tolist() if hasattr(x, "tolist") else list(x)
        for pdf in batches:
            out = [(k, i, named(x), named(y)) for k, s, t in zip(pdf["_p"], pdf["_a"], pdf["_b"]) for i, (x, y) in enumerate(by_length(some(s), some(t)))]
            if out:
                yield pd.DataFrame(out, columns=["_p", "bead", "a", "b"])

    src = rows.select(F.col(pair).alias("_p"), F.col(a).cast("array<int>").alias("_a"), F.col(b).cast("array<int>").alias("_b"))
    return src.mapInPandas(run, f"_p {kind.simpleString()}, bead int, a string, b string").withColumnRenamed("_p", pair)


def align_pairs(rows: DataFrame, pair: str, side: str, place: str, length: str) -> DataFrame:
    """pair, bead, a, b (places joined by commas): rows hold the paragraphs of sides 'a' and 'b' of each pair."""
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col(side) == s, F.struct(place, length))))
    sides = rows.groupBy(pair).agg(of("a").alias("_sa"), of("b").alias("_sb"))
    lengths = sides.select(pair, F.transform("_sa", lambda x: x[length]).alias("_la"), F.transform("_sb", lambda x: x[length]).alias("_lb"))
    names = sides.select(pair, F.transform("_sa", lambda x: x[place].cast("string")).alias("_na"), F.transform("_sb", lambda x: x[place].cast("string")).alias("_nb"))
    named = lambda col, own: F.array_join(F.transform(F.filter(F.split(col, ","), lambda i: i != ""), lambda i: F.get(F.col(own), i.cast("int"))), ",")
    return align_arrays(lengths, pair, "_la", "_lb").join(names, pair).select(pair, "bead", named("a", "_na").alias("a"), named("b", "_nb").alias("b"))


def words(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Places of words that stand for each other, by least edits (a word without partner has None)."""
    n, m = len(a), len(b)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                d[i][j] = i + j
            else:
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def inherit_times(old: list[tuple[str, float, float]], new: list[str], least: float = 0.85) -> list[tuple[str, float, float]] | None:
    """Times for a corrected wording from the words it replaces; words without partner lie between their neighbours.

    None where fewer than ``least`` of the new words have a partner.
    """
    pairs = [(i, j) for i, j in words([w.lower() for w, _, _ in old], [w.lower() for w in new]) if j is not None]
    if not new or sum(i is not None for i, _ in pairs) < least * len(new):
        return None
    times: list[tuple[float, float] | None] = [(old[i][1], old[i][2]) if i is not None else None for i, _ in pairs]
    known = [k for k, t in enumerate(times) if t]
    for k, t in enumerate(times):
        if t is None:
            left = max((x for x in known if x < k), default=None)
            right = min((x for x in known if x > k), default=None)
            lo = times[left][1] if left is not None else times[right][0]
            hi = times[right][0] if right is not None else times[left][1]
            run = (right if right is not None else len(times)) - (left if left is not None else -1)
            at = k - (left if left is not None else -1)
            times[k] = (lo + (hi - lo) * (at - 1) / run, lo + (hi - lo) * at / run)
            known = sorted([*known, k])
    return [(w, *t) for w, t in zip(new, times)]
