"""Nearest neighbours: exact and by cells, with filters before distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Query vectors of one broadcast block.
BLOCK_ROWS = 4096


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k vectors with the largest inner product with the query scaled to length 1; ties by key."""
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1.0)
    rows = vectors if where is None else vectors.where(where)
    lit = F.array(*[F.lit(float(x)) for x in q])
    return rows.select(key, V.dot(F.col(vector), lit).alias("score")).orderBy(F.desc(F.round("score", 9)), key).limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query, key, score, rank: the k nearest of every query, itself left out.

    Queries are streamed through the driver in blocks of bounded size; each block is broadcast and
    multiplied with every batch of vectors.  A task sends on its own k best for each query only, so
    what is shuffled does not grow with the square of anything.
    """
    spark = vectors.sparkSession
    schema = pa.schema([("query", pa.int64()), (key, pa.int64()), ("score", pa.float64())])
    found = None

    def one(ids: list[int], rows: list[list[float]]) -> DataFrame:
        held = spark.sparkContext.broadcast((np.array(ids), np.array(rows, float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            best_s = np.full((len(qid), 0), 0.0)
            best_k = np.full((len(qid), 0), 0)
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column(0).to_numpy(zero_copy_only=False)
                m = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)
                s = np.round(q @ m.T, digits)
                s[qid[:, None] == own[None, :]] = -np.inf
                best_s = np.concatenate([best_s, s], axis=1)
                best_k = np.concatenate([best_k, np.broadcast_to(own, s.shape)], axis=1)
                order = np.lexsort((best_k, -best_s), axis=1)[:, :k]
                best_s, best_k = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_k, order, 1)
            keep = np.isfinite(best_s)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qid[:, None], best_s.shape)[keep]), pa.array(best_k[keep]), pa.array(best_s[keep])], schema=schema)

        return vectors.select(F.col(key).cast("long"), vector).mapInArrow(run, f"query long, {key} long, score double")

    ids, rows = [], []
    for r in queries.select(F.col(key).cast("long"), vector).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK_ROWS:
            found = one(ids, rows) if found is None else found.unionByName(one(ids, rows))
            ids, rows = [], []
    if ids:
        found = one(ids, rows) if found is None else found.unionByName(one(ids, rows))
    if found is None:
        return spark.createDataFrame([], f"query long, {key} long, score double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, label: str, vector: str = "embedding", digits: int = 9) -> DataFrame:
    """label, centroid: the mean vector of each label, summed by position with partial sums."""
    each = vectors.select(label, F.posexplode(vector).alias("i", "x"))
    mean = each.groupBy(label, "i").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("x"))
    return mean.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def assign(vectors: DataFrame, cells: DataFrame, key: str = "vec_id", vector: str = "embedding", n: int = 1, digits: int = 6) -> DataFrame:
    """key, cell, score, rank: the n cells nearest to each vector by cosine (ties: the smaller cell).

    Cells are a bounded table (centroids), so each vector meets all of them in its own row.
    """
    held = F.broadcast(cells.agg(F.sort_array(F.collect_list(F.struct("cell", "centroid"))).alias("_cells")))
    scored = F.transform("_cells", lambda c: F.struct((-F.round(V.cosine(F.col(vector), c["centroid"]), digits)).alias("d"), c["cell"].alias("cell")))
    top = F.slice(F.sort_array(scored), 1, n)
    return vectors.crossJoin(held).select(key, F.posexplode(top).alias("_p", "s")).select(key, "s.cell", (-F.col("s.d")).alias("score"), (F.col("_p") + 1).alias("rank"))


def ivf_search(vectors: DataFrame, assigned: DataFrame, query: list[float], cells: DataFrame, probes: int, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best of the vectors in the cells nearest to the query."""
    q = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], f"_q long, {vector} array<double>")
    near = assign(q, cells, "_q", vector, probes).select("cell")
    inside = vectors.join(assigned.where("rank = 1").join(F.broadcast(near), "cell", "left_semi").select(key), key, "left_semi")
    return knn(inside, query, k, key, vector)


def embedded_once(rows: DataFrame, text: str, embed, out: str = "vector") -> DataFrame:
    """Rows with ``embed`` (a column function) of their text, which is run once for each distinct text."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    pieces = rows.select(digest.alias("_d"), F.coalesce(F.col(text), F.lit("")).alias("_t")).dropDuplicates(["_d"]).select("_d", embed(F.col("_t")).alias(out))
    return rows.withColumn("_d", digest).join(pieces, "_d").drop("_d")
