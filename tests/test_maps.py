"""Maps of vectors against exact neighbourhoods and numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from libralake.operators import clusters


def points(n, dims=16, groups=4, seed=3):
    """Groups that spread over three dimensions of their own."""
    rng = np.random.default_rng(seed)
    label = rng.integers(0, groups, n)
    centres, basis = rng.normal(0, 4, (groups, dims)), rng.normal(0, 1, (groups, 3, dims))
    return label, centres[label] + np.einsum("nk,nkd->nd", rng.normal(0, 1, (n, 3)), basis[label])


def exact(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def test_neighbour_graph(spark, monkeypatch):
    _, x = points(300)
    near, dist = exact(x, 5)
    for block, cell, least in ((4096, 20_000, 1.0), (70, 20_000, 1.0), (4096, 90, 0.9)):
        monkeypatch.setattr(clusters, "BLOCK", block)
        got = clusters.neighbour_graph(frame(spark, x), "vec_id", "embedding", 5, cell, 3).collect()
        found = {(r.key, r.other) for r in got}
        want = {(i, int(j)) for i in range(len(x)) for j in near[i]}
        assert len(found & want) / len(want) >= least and len(got) == 1500


def test_neighbours_are_exact(spark, monkeypatch):
    """All neighbours of random points, which cells would lose, over many tiles; repeated vectors are at no distance and go by their keys."""
    x = np.random.default_rng(9).normal(0, 1, (700, 24))
    x[600:] = x[600]
    near, _ = exact(x[:600], 4)
    for block, parts in ((100, 1), (65_536, 8)):
        monkeypatch.setattr(clusters, "BLOCK", block)
        monkeypatch.setattr(clusters, "PARTS", parts, raising=False)
        monkeypatch.setattr(clusters, "PART", 90, raising=False)
        got = {}
        for r in clusters.neighbour_graph(frame(spark, x), "vec_id", "embedding", 4).orderBy("key", F.round("distance", 9), "other").collect():
            got.setdefault(r.key, []).append((r.other, r.distance))
        assert all([o for o, _ in got[i] if o < 600] == near[i].tolist()[: sum(o < 600 for o, _ in got[i])] for i in range(600))
        assert all(got[i] == [(o, 0.0) for o in range(600, 605) if o != i][:4] for i in range(600, 700))


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, (70, 8)), rng.normal(0, 1, (300, 8))
    y[250:] = y[:50]
    d = np.round(np.sqrt(np.maximum(0, 2 - 2 * (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T)), 9)
    for k, cols in ((3, 64), (70, 64), (400, 128)):
        at, to, _ = clusters.nearest(x, y, k, None, 32, cols)
        assert [to[at == i].tolist() for i in range(70)] == [np.lexsort((np.arange(300), r))[:k].tolist() for r in d]


def test_fuzzy_weights():
    _, dist = exact(points(200)[1], 15)
    w = clusters.fuzzy_weights(dist)
    assert np.allclose(w[:, 0], 1) and np.allclose(w.sum(1), np.log2(15), atol=1e-4) and (np.diff(w, axis=1) <= 1e-12).all()
    short = clusters.fuzzy_weights(np.array([[0.0, 0.5, np.inf], [0.0, 0.0, 0.0]]))
    assert short[0, 2] == 0 and np.isfinite(short).all()
    a, b = clusters.curve(0.1)
    assert abs(a - 1.58) < 0.1 and abs(b - 0.9) < 0.05


def test_umap_keeps_neighbourhoods(spark):
    label, x = points(400)
    got = {r.key: (r.x, r.y) for r in clusters.umap(frame(spark, x), "vec_id", "embedding", 15, 8, 25).collect()}
    at = np.array([got[i] for i in range(len(x))])
    assert len(got) == 400 and np.abs(at).max() <= 1.0001
    d = ((at[:, None] - at[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    flat = np.argsort(d, axis=1)[:, :15]
    assert (label[flat] == label[:, None]).mean() > 0.95
    kept = np.mean([len(set(a) & set(b)) / 15 for a, b in zip(flat.tolist(), exact(x, 15)[0].tolist())])
    assert kept > 0.5


def test_document_map(spark):
    _, x = points(130, dims=6)
    rows = [(i % 2, i, [float(c) for c in r]) for i, r in enumerate(x)] + [(7, 500, [1.0] * 6), (8, 501, None)]
    df = spark.createDataFrame(rows, "doc int, k int, e array<double>")
    got = clusters.document_map(df, "doc", "k", "e", 20).collect()
    for d in (0, 1):
        own = sorted((r.k, r.x, r.y, r.share_x) for r in got if r.doc == d)
        keys = [k for o, k, _ in rows if o == d][::4]
        assert [k for k, *_ in own] == keys
        y = x[keys] - x[keys].mean(0)
        s = np.linalg.svd(y, compute_uv=False)
        assert abs(own[0][3] - s[0] ** 2 / (s**2).sum()) < 1e-9
        flat = np.array([o[1:3] for o in own])
        assert np.allclose(np.linalg.norm(flat, axis=0)[0] / np.linalg.norm(flat, axis=0)[1], s[0] / s[1])
    assert [(r.x, r.y) for r in got if r.doc == 7] == [(0.0, 0.0)] and not any(r.doc == 8 for r in got)
