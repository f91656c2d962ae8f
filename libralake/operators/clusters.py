"""Concept maps: reduction, clusters, placement and summaries of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .graph import _saved


def n_clusters(n: int) -> int:
    """How many clusters a number of points is given."""
    return max(2, n // 5) if n < 50 else int(min(48, max(4, (n / 50) ** 0.5)))


def reduce(vectors: DataFrame, dims: int, vector: str = "embedding", out: str = "reduced") -> DataFrame:
    """Adds the ``dims`` first principal components; the model holds dims x dimensions numbers, whatever the rows."""
    v = vectors.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def project(vectors: DataFrame, dims: int, size: int, seed: int = 7, vector: str = "embedding", out: str = "reduced") -> DataFrame:
    """Adds a Gaussian random projection scaled to length 1."""
    m = np.random.default_rng(seed).normal(0, dims**-0.5, (dims, size))
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in m])
    return vectors.withColumn(out, V.unit(F.transform(rows, lambda r: V.dot(F.col(vector), r))))


def cluster(vectors: DataFrame, k: int, seed: int = 7, vector: str = "reduced") -> DataFrame:
    """Adds cluster, by k-means."""
    v = vectors.withColumn("_v", array_to_vector(vector))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v).transform(v).drop("_v")


def summary(vectors: DataFrame, key: str, cluster: str, vector: str, nearest: int = 8) -> DataFrame:
    """cluster, size, mean_distance, near: the keys nearest to the centroid, joined by commas."""
    from .dense import centroids

    c = centroids(vectors, cluster, vector)
    d = F.sqrt(F.aggregate(F.zip_with(F.col(vector), F.col("centroid"), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda x, y: x + y))
    far = vectors.join(F.broadcast(c), cluster).select(cluster, key, F.round(d, 6).alias("d"))
    ranked = far.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy("d", key)))
    return ranked.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("d"), 4).alias("mean_distance"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= nearest, F.struct("_r", key)))), lambda x: x[key].cast("string")), ",").alias("near"))


def place(points: DataFrame, sample: DataFrame, by: str, key: str, vector: str, x: str = "x", y: str = "y", n: int = 3) -> DataFrame:
    """key, x, y of points outside a bounded sample: the mean of the n nearest sampled points of the same cluster, weighted by inverse distance."""
    held = F.broadcast(sample.groupBy(by).agg(F.collect_list(F.struct(F.col(vector).alias("v"), x, y)).alias("_s")))
    dist = lambda s: F.sqrt(F.aggregate(F.zip_with(F.col(vector), s["v"], lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda p, q: p + q))
    near = F.slice(F.sort_array(F.transform("_s", lambda s: F.struct(dist(s).alias("d"), s[x].alias("x"), s[y].alias("y")))), 1, n)
    w = lambda p: 1.0 / (p["d"] + 1e-9)
    total = F.aggregate("_near", F.lit(0.0), lambda acc, p: acc + w(p))
    mean = lambda c: F.aggregate("_near", F.lit(0.0), lambda acc, p: acc + w(p) * p[c]) / total
    return points.join(held, by).withColumn("_near", near).select(key, mean("x").alias(x), mean("y").alias(y))


#: Points of a cell that are compared in one task with as many others, at most; and how many parts smaller cells of some size have.
BLOCK, PARTS, PART = 65_536, 8, 4096


def nearest(x: np.ndarray, y: np.ndarray, k: int, apart: tuple[np.ndarray, np.ndarray] | None = None, rows: int = 256, cols: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x``, rows of ``y`` and distances of the k nearest of ``y`` to each of ``x``, on the unit sphere; equal distances (9 places) go to the first.

    Products of single precision, less what they can be off, tell which pairs may be among the k; only those are computed in double
    precision.  ``apart`` has a number for each row of either: equal ones never meet.
    """
    nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    a, b = (x / np.sqrt(nx)[:, None]).astype(np.float32), (y / np.sqrt(ny)[:, None]).astype(np.float32)
    off = (x.shape[1] + 16) * 2.4e-7
    out = []
    for i in range(0, len(a), rows):
        n = min(rows, len(a) - i)
        at, to, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(n, -3.0, np.float32)
        for j in range(0, len(b), cols):
            g = a[i : i + n] @ b[j : j + cols].T
            if apart is not None:
                g[apart[0][i : i + n, None] == apart[1][None, j : j + cols]] = -9.0
            if g.shape[1] > k and (least < -2).any():
                least = np.maximum(least, np.partition(g, -k, axis=1)[:, -k] - off)
            hit = np.flatnonzero(g >= np.maximum(least, -2.0)[:, None])
            if not len(hit):
                continue
            r, c = np.divmod(hit, g.shape[1])
            c += j
            d = np.concatenate([np.einsum("ij,ij->i", x[i + r[s : s + 65_536]], y[c[s : s + 65_536]]) for s in range(0, len(r), 65_536)]) / np.sqrt(nx[i + r] * ny[c])
            at, to, dist = np.concatenate([at, r]), np.concatenate([to, c]), np.concatenate([dist, np.sqrt(np.maximum(0.0, 2 - 2 * np.minimum(d, 1.0)))])
            order = np.lexsort((to, np.round(dist, 9), at))
            at, to, dist = at[order], to[order], dist[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            last = rank == k - 1
            least[at[last]] = np.maximum(least[at[last]], (1 - dist[last] ** 2 / 2 - off).astype(np.float32))
            at, to, dist = at[rank < k], to[rank < k], dist[rank < k]
        out.append((at + i, to, dist))
    return tuple(np.concatenate(o) for o in zip(*out))


def neighbour_graph(vectors: DataFrame, key: str, vector: str, k: int = 15, per_cell: int | None = None, probe: int = 4, seed: int = 7) -> DataFrame:
    """key, other, distance: the k nearest points of every point (Euclidean, vectors scaled to length 1).

    The graph is exact: all points meet all others, in tiles of two blocks, so that no task holds more.  Only where ``per_cell`` is given
    and there are more points, they are dealt to cells by k-means and look into their ``probe`` nearest cells.
    """
    unit = V.unit(F.transform(F.col(vector), lambda x: x.cast("double")))
    src = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(unit.isNotNull())
    n_cells = 1 if per_cell is None else max(1, -(-src.count() // per_cell))
    if n_cells == 1:
        target, asked = src.withColumn("cell", F.lit(0)), src.withColumn("cell", F.lit(0))
    else:
        flat = src.withColumn("_u", V.unit(F.transform("v", lambda x: x.cast("double"))))
        model = KMeans(k=n_cells, seed=seed, featuresCol="_v", predictionCol="cell").fit(flat.withColumn("_v", array_to_vector("_u")))
        # One centre a cell.
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
        near = F.slice(F.sort_array(F.transform(centres, lambda c, i: F.struct((-V.dot(F.col("_u"), c)).alias("d"), i.alias("cell")))), 1, probe)
        asked = flat.withColumn("cell", F.explode(F.transform(near, lambda x: x["cell"]))).drop("_u")
        target = flat.withColumn("cell", near[0]["cell"]).drop("_u")
    n = F.count(F.lit(1))
    parts = F.broadcast(target.groupBy("cell").agg(F.greatest(F.ceil(n / BLOCK), F.least(F.lit(PARTS), F.ceil(n / PART))).cast("int").alias("parts")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    q = asked.join(parts, "cell").withColumn("a", own).withColumn("b", every).select("cell", "a", "b", "key", "v")
    t = target.join(parts, "cell").withColumn("b", own).withColumn("a", every).select(F.col("cell").alias("cell2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("key").alias("other"), F.col("v").alias("w"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"key": [], "other": [], "distance": []})
        # Equal distances go to the smaller key.
        right = right.sort_values("other", kind="stable")
        x, y = np.stack(left["v"].to_numpy()).astype(float), np.stack(right["w"].to_numpy()).astype(float)
        mine, others = left["key"].to_numpy(), right["other"].to_numpy()
        same = np.split(pd.factorize(np.concatenate([mine, others]))[0], [len(mine)]) if left["a"].iloc[0] == left["b"].iloc[0] else None
        at, to, d = nearest(x, y, k, same)
        return pd.DataFrame({"key": mine[at], "other": others[to], "distance": d})

    kind = dict(src.dtypes)["key"]
    found = q.groupBy("cell", "a", "b").cogroup(t.groupBy("cell2", "a2", "b2")).applyInPandas(run, f"key {kind}, other {kind}, distance double")
    best = Window.partitionBy("key").orderBy(F.round("distance", 9), "other")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def fuzzy_weights(d: np.ndarray) -> np.ndarray:
    """Weights of the neighbours of many points, from their distances in ascending order (inf: none).

    The nearest distance above 0 counts as none; the scale of each point is such that its weights sum to log2 of the number of neighbours.
    """
    rho = np.where(np.isfinite(d) & (d > 0), d, np.inf).min(1, keepdims=True)
    over = np.maximum(0.0, d - np.where(np.isfinite(rho), rho, 0.0))
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    goal = np.log2(d.shape[1])
    for _ in range(64):
        s = np.exp(-over / sigma[:, None]).sum(1)
        much = s > goal
        high, low = np.where(much, sigma, high), np.where(much, low, sigma)
        sigma = np.maximum(1e-12, np.where(np.isfinite(high), (low + np.minimum(high, 1e300)) / 2, np.minimum(sigma * 2, 1e12)))
    return np.where(np.isfinite(d), np.exp(-over / sigma[:, None]), 0.0)


def fuzzy_graph(graph: DataFrame, k: int) -> DataFrame:
    """a, b (a < b), weight: the union of both points' views of a neighbourhood."""
    lists = graph.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("near"))
    kind = dict(graph.dtypes)["key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                n = pdf["near"].map(len).to_numpy()
                d = np.full((len(pdf), k), np.inf)
                d[np.repeat(np.arange(len(pdf)), n), np.concatenate([np.arange(m) for m in n])] = [x["distance"] for near in pdf["near"] for x in near]
                w = fuzzy_weights(d)
                yield pd.DataFrame({"key": np.repeat(pdf["key"].to_numpy(), n), "other": [x["other"] for near in pdf["near"] for x in near], "w": w[np.isfinite(d)]})

    each = lists.mapInPandas(run, f"key {kind}, other {kind}, w double")
    both = each.groupBy(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).agg(F.sum("w").alias("s"), F.when(F.count(F.lit(1)) > 1, F.max("w") * F.min("w")).otherwise(0.0).alias("p"))
    return both.select("a", "b", (F.col("s") - F.col("p")).alias("weight"))


def curve(nearest: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^2b), fitted to 1 up to ``nearest`` and an exponential decline beyond."""
    x = np.linspace(0, 3 * spread, 300)
    y = np.where(x < nearest, 1.0, np.exp(-(x - nearest) / spread))
    a, b = np.meshgrid(np.arange(0.5, 3.0, 0.05), np.arange(0.5, 1.5, 0.02), indexing="ij")
    error = ((1 / (1 + a[..., None] * x ** (2 * b[..., None])) - y) ** 2).sum(-1)
    at = np.unravel_index(error.argmin(), error.shape)
    return float(a[at]), float(b[at])


def embedded(edges: DataFrame, start: DataFrame, rounds: int = 8, epochs: int = 25, negatives: int = 5, seed: int = 11) -> DataFrame:
    """key, x, y in [-1, 1]: a layout of a weighted graph by attraction along edges and repulsion of random others.

    Each round gives every point its neighbours' places, which are joined once; within the round points move for ``epochs`` steps
    towards them and away from random points of their Arrow batch, as they move themselves.
    """
    a, b = curve()
    top = edges.agg(F.max("weight")).first()[0] or 1.0
    both = edges.select(F.col("a").alias("key"), F.col("b").alias("other"), (F.col("weight") / top).alias("w")).unionByName(edges.select(F.col("b").alias("key"), F.col("a").alias("other"), (F.col("weight") / top).alias("w")))
    both = _saved(both, "edges")
    now = _saved(start.select("key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "places")
    kind = dict(start.dtypes)["key"]
    for r in range(rounds):

        def run(batches: Iterator[pd.DataFrame], r: int = r) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                rng = np.random.default_rng([seed, r, len(pdf)])
                at = pdf[["x", "y"]].to_numpy()
                n = pdf["near"].map(len).to_numpy()
                row = np.repeat(np.arange(len(pdf)), n)
                near = np.array([(p["w"], p["x"], p["y"]) for own in pdf["near"] for p in own]).reshape(-1, 3)
                for e in range(epochs):
                    alpha = 1 - (r * epochs + e) / (rounds * epochs)
                    drawn = rng.random(len(near)) < near[:, 0]
                    i, goal = row[drawn], near[drawn, 1:]
                    d = at[i] - goal
                    d2 = np.maximum((d**2).sum(1, keepdims=True), 1e-12)
                    np.add.at(at, i, alpha * np.clip(-2 * a * b * d2 ** (b - 1) / (a * d2**b + 1) * d, -4, 4))
                    i = np.repeat(i, negatives)
                    d = at[i] - at[rng.integers(0, len(at), len(i))]
                    d2 = (d**2).sum(1, keepdims=True)
                    push = np.where(d2 > 0, np.clip(2 * b / ((0.001 + d2) * (a * d2**b + 1)) * d, -4, 4), 0.0)
                    np.add.at(at, i, alpha * push)
                yield pd.DataFrame({"key": pdf["key"], "x": at[:, 0], "y": at[:, 1]})

        seen = both.join(now.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.collect_list(F.struct("w", "x", "y")).alias("near"))
        now = _saved(now.join(seen, "key").mapInPandas(run, f"key {kind}, x double, y double").unionByName(now.join(seen, "key", "left_anti")), "places")
    lim = now.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if lim[0] is None:
        return now
    half = max(lim[1] - lim[0], lim[3] - lim[2]) / 2 or 1.0
    return now.select("key", ((F.col("x") - (lim[0] + lim[1]) / 2) / half).alias("x"), ((F.col("y") - (lim[2] + lim[3]) / 2) / half).alias("y"))


def umap(vectors: DataFrame, key: str, vector: str, k: int = 15, rounds: int = 8, epochs: int = 25) -> DataFrame:
    """key, x, y: a map of all vectors that keeps neighbourhoods, begun at their first two principal components."""
    edges = _saved(fuzzy_graph(neighbour_graph(vectors, key, vector, k), k), "fuzzy")
    flat = reduce(vectors.select(F.col(key).alias("key"), F.col(vector).alias("_e")).where("_e is not null"), 2, "_e", "flat")
    spread = flat.agg(F.max(F.abs(F.col("flat")[0])), F.max(F.abs(F.col("flat")[1]))).first()
    scale = 10.0 / (max(x or 0.0 for x in spread) or 1.0)
    return embedded(edges, flat.select("key", (F.col("flat")[0] * scale).alias("x"), (F.col("flat")[1] * scale).alias("y")), rounds, epochs)


def document_map(vectors: DataFrame, doc: str, key: str, vector: str, most: int = 400) -> DataFrame:
    """doc, key, x, y, share_x, share_y: the vectors of each document on its own two principal axes, in [-1, 1], and the share of variance of each.

    Of a document with more than ``most`` vectors every n-th is shown, in the order of the key.
    """
    w = Window.partitionBy(doc).orderBy(key)
    n = F.count(F.lit(1)).over(Window.partitionBy(doc))
    step = F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    shown = vectors.select(doc, key, F.col(vector).alias("_v")).where("_v is not null").withColumn("_s", step).withColumn("_r", F.row_number().over(w) - 1).where("_r % _s = 0")
    kinds = dict(vectors.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["_v"].to_numpy()).astype(float)
        x = x - x.mean(0)
        _, s, axes = np.linalg.svd(x, full_matrices=False)
        axes = axes[:2] * np.where(axes[:2].sum(1, keepdims=True) < 0, -1, 1)
        at = np.zeros((len(x), 2))
        at[:, : len(axes)] = x @ axes.T
        share = np.zeros(2)
        share[: len(s[:2])] = (s[:2] ** 2) / max((s**2).sum(), 1e-300)
        at /= max(np.abs(at).max(), 1e-12)
        return pd.DataFrame({doc: pdf[doc], key: pdf[key], "x": at[:, 0], "y": at[:, 1], "share_x": share[0], "share_y": share[1]})

    return shown.groupBy(doc).applyInPandas(run, f"{doc} {kinds[doc]}, {key} {kinds[key]}, x double, y double, share_x double, share_y double")
