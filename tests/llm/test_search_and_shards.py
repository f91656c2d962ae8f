"""Resampling, ranked search and suffix-array removal against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from libralake.llm import induced_sort, ranked_search, resample, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Clashing names: the operators use some of these inside.
SCHEMA = "doc_id long, text string, block string, term long, score string, piece int, rank long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(k, t, "b", 1, "s", 2, 3) for k, t in rows], schema)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    pool = ["alpha", "Beta", "gamma", "naïve", "日本", "x9", "delta-eps", "zeta", "Eta", "theta"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(pool, [9] * 10 + [1] * 60, k=rng.randint(0, 60)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "!!! --"), (None, "alpha beta " * 15), (3, rows[3][1]), (3, rows[3][1]), (203, "alpha " * 5000), (204, "w" * 70_000)]


def runs(text, longest):
    w = words(text)
    return Counter(" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))


def sampled(docs, target, longest, buckets, percent, least):
    s, t = Counter(), Counter()
    for out, rows in ((s, docs), (t, target)):
        for _, x in rows:
            for f, n in runs(x, longest).items():
                out[zlib.crc32(f.encode()) % buckets] += n
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for k, x in docs:
        own = runs(x, longest)
        weight = sum(n * gain(zlib.crc32(f.encode()) % buckets) for f, n in own.items())
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, sum(own.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return sorted(map(str, [(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in rows if not r[4]]))


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 50, 35), (3, 7, 100)])
def test_resample(spark, corpus, longest, buckets, percent):
    target = [(i, x) for i, (_, x) in enumerate(corpus[:30])] + [(90, None)]
    got = resample.resample(frame(spark, corpus), frame(spark, target), longest, buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == sampled(corpus, target, longest, buckets, percent, 20)


def test_resample_shuffled_features(spark, corpus, monkeypatch):
    """With few broadcast features the others meet their gains in a shuffle."""
    monkeypatch.setattr(resample, "HOT", 3)
    got = resample.resample(frame(spark, corpus), frame(spark, corpus[:9]))
    assert sorted(str(tuple(r)) for r in got.collect()) == sampled(corpus, corpus[:9], 1, 10_000, 10, 20)


def test_resample_empty(spark, corpus):
    assert resample.resample(frame(spark, []), frame(spark, corpus)).count() == 0
    got = resample.resample(frame(spark, corpus), frame(spark, []))
    assert sorted(str(tuple(r)) for r in got.collect()) == sampled(corpus, [], 1, 10_000, 10, 20)


def ranked(docs, items, k=20):
    own = [(key, Counter(words(x))) for key, x in docs]
    own = [(key, c, sum(c.values())) for key, c in own if c]
    N, L = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, x in items:
        found = []
        for key, c, n in own:
            m = 75 + (25 * n * N) // L
            score = sum(times * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(words(x)).items() if t in c)
            if score > 0:
                found.append((score, key))
        found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
        out += [(item, i + 1, key, score) for i, (score, key) in enumerate(found[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize(("k", "most"), [(20, 4 << 20), (3, 2000), (200, 700)])
def test_ranked_search(spark, corpus, monkeypatch, k, most):
    monkeypatch.setattr(ranked_search, "LEAF", 4)
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", 150)
    monkeypatch.setattr(ranked_search, "postings", lambda *a, **b: ranked_search_postings(*a, **{"most": most} | b))
    items = [(1, "alpha gamma"), (2, "naïve 日本 naïve"), (3, "absent words"), (4, None), (5, ""), (6, "w1 w2 w3 W4 alpha Alpha"), (None, "zeta"), (1, "alpha gamma"), (7, corpus[5][1] or "x9"), (8, "w" * 70_000)]
    lists = ranked_search.index(frame(spark, corpus))
    got = ranked_search.search(lists, frame(spark, items).withColumnRenamed("doc_id", "item_id"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == ranked(corpus, items, k)


ranked_search_postings = ranked_search.postings


def test_ranked_search_empty(spark, corpus):
    some = frame(spark, corpus).withColumnRenamed("doc_id", "item_id")
    assert ranked_search.search(ranked_search.index(frame(spark, [])), some).count() == 0
    assert ranked_search.search(ranked_search.index(frame(spark, corpus)), some.limit(0)).count() == 0


def test_max_trees_open_few_leaves():
    """Bounds keep the descent from most of the documents."""
    n = 20_000
    rng = np.random.default_rng(3)
    doc = np.arange(n)
    impact = rng.integers(1, 1000, n)
    impact[[77, 15_000]] = 5000
    trees = ranked_search.MaxTrees(np.zeros(n, np.int64), doc, impact, 1, n)
    opened = []
    first = trees.first

    class Counted:
        def __getitem__(self, i):
            opened.append(i)
            return first[i]

    trees.first = Counted()
    assert sorted(trees.best(np.array([0]), np.array([1]), 2, doc)) == [(5000, 77), (5000, 15_000)]
    assert len(opened) == 4


def order_of(data, depth, most, batch, tmp_path, monkeypatch):
    monkeypatch.setattr(induced_sort, "BATCH", batch)
    monkeypatch.setattr(induced_sort, "HOLD", 16 << 20 if batch > 50 else 100)
    scratch = induced_sort.Scratch(str(tmp_path / "scratch"))
    log = induced_sort.Log(scratch, (np.uint8,), 64)
    text = np.append(np.frombuffer(data, np.uint8) + 2, 0).astype(np.uint8)
    for a in range(0, len(text), 64):
        log.add(text[a : a + 64])
    places, same = [], []
    induced_sort.sort(induced_sort.Symbols(log.close(), len(text), 8, most), scratch, most, depth, lambda p, c: (places.extend(p.tolist()), same.extend(c.tolist())))
    scratch.close()
    assert not (tmp_path / "scratch").exists()
    return bytes(text), places, same


@pytest.mark.parametrize("seed", range(40))
def test_induced_sort(seed, tmp_path, monkeypatch):
    """Queues, texts and names beyond memory, down to recursion, against sorted slices."""
    rng = random.Random(seed)
    data = bytes(rng.randrange(97, 97 + rng.choice([1, 2, 3, 26])) for _ in range(rng.choice([0, 1, 2, 30, 400])))
    if seed % 2:
        data += data[: rng.randrange(len(data) + 1)] + data
    depth = rng.choice([100, 7])
    text, places, same = order_of(data, depth, rng.choice([8, 32, 10**6]), rng.choice([3, 50, 1 << 18]), tmp_path, monkeypatch)
    want = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
    assert sorted(places) == sorted(want)
    assert [text[i : i + depth] for i in places] == [text[i : i + depth] for i in want]
    agree = [next((k for k in range(depth) if text[a + k : a + k + 1] != text[b + k : b + k + 1]), depth) for a, b in zip(want, want[1:])]
    assert same == [0, *agree]


def removed(docs, width):
    """By a dictionary of all strings, rows of equal key and text once."""
    once = sorted({(k is None, k or 0, x or "") for k, x in docs}, key=lambda r: r)
    seen, out = set(), {}
    for none, k, x in once:
        raw = x.encode()
        hit = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            if raw[s : s + width] in seen:
                hit[s : s + width] = b"\1" * width
            seen.add(raw[s : s + width])
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        n = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out[None if none else k, x] = (len(raw), sum(hit), n, hashlib.sha256(kept).hexdigest())
    return sorted(str((k, *out[k, x or ""])) for k, x in docs)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(11)
    letters = "abcdeé日 "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(150) for _ in range(4)]
    rows = [(i, text(rng.randint(0, 300)) + rng.choice(shared)[rng.randint(0, 40) :] + text(rng.randint(0, 200))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(110, "ab" * 400), (111, "b" + "ab" * 300), (112, "z" * 1000), (113, "x" + "z" * 260 + "y"), (114, shared[0] * 3)]
    return rows + [(120, None), (121, ""), (122, "short"), (None, rows[0][1]), (7, rows[7][1]), (130, shared[1][:99]), (131, "日" * 34), (132, "日" * 33)]


def test_suffix_dedup(spark, copies):
    got = suffix_dedup.deduplicated(frame(spark, copies), digest=True)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == removed(copies, 100)
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.deduplicated(frame(spark, copies)).collect()}
    assert kept[122] == b"short" and kept[120] == b""
    assert suffix_dedup.deduplicated(frame(spark, [])).count() == 0


def test_suffix_dedup_beyond_memory(spark, copies, monkeypatch):
    """Sorting with queues, texts and names on disk; no piece broadcast."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    got = suffix_dedup.deduplicated(frame(spark, copies), digest=True, held=512)
    assert sorted(str(tuple(r)) for r in got.collect()) == removed(copies, 100)


@pytest.mark.parametrize("windows", [1 << 16, 90, 7])
def test_pieces(copies, monkeypatch, windows):
    """Every string of a text is in one piece, with an anchor that hangs on the string alone."""
    monkeypatch.setattr(suffix_dedup, "WINDOWS", windows)
    texts = [(x or "").encode() for _, x in copies]
    offs = np.cumsum([0, *map(len, texts)])
    found = list(zip(*(c.tolist() for c in suffix_dedup.pieces(np.frombuffer(b"".join(texts), np.uint8), offs, 100))))
    seen, by = [], {}
    for text, start, size, anchor, digest in found:
        assert by.setdefault(digest, texts[text][start : start + size]) == texts[text][start : start + size]
        for s in range(start, start + size - 99):
            seen.append((text, s))
            assert by.setdefault(texts[text][s : s + 100], anchor) == anchor
    assert sorted(seen) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 99)]


def test_equal_keys_with_other_texts(spark):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefg ") for _ in range(200))
    rows = [(1, shared + "left"), (1, "right" + shared), (0, "x")]
    got = suffix_dedup.deduplicated(frame(spark, rows), digest=True).collect()
    # One of the two is earlier and stays whole.
    assert sorted(r.n_removed for r in got) == [0, 0, 200]
