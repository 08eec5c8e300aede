"""Centroid clustering of integer vectors with a table of pivot distances (LAESA).

The distances of every vector to a few fixed pivots are computed once and written beside
the vector.  In each round the centroids' own distances to the pivots are known, and by
the triangle inequality |d(vector, pivot) - d(centroid, pivot)| bounds d(vector, centroid)
from below for every centroid; only the centroids whose bound does not exceed the best
exact distance so far get an exact integer distance.  A round is one pass over the table:
tasks send sums and counts per centroid, never vectors, and the driver sees those alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .vectors import finite, lists, matrix, scaled

#: Components beyond this stay at it, so that squared distances of 64 components fit a long.
MOST = 1 << 27
#: Rows that are compared at once.
ROWS = 8192


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` vectors of the sample, each the farthest from those before (ties: the first)."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]).astype(float) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return sample[chosen]


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to one point."""
    apart = vectors - point
    return np.einsum("ij,ij->i", apart, apart)


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each vector's nearest centroid (ties: the smaller number), and how
    many exact distances it took.  to_pivots and centroid_pivots are distances, not squared."""
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - centroid_pivots[None, :, p]), out=bound)
    bound *= 1 - 1e-9  # what rounding may add
    bound *= bound
    label = bound.argmin(axis=1)
    best = np.empty(len(vectors), np.int64)
    for c in range(len(centroids)):
        mine = np.flatnonzero(label == c)
        best[mine] = squared(vectors[mine], centroids[c])
    first, taken = label.copy(), len(vectors)
    for c in range(len(centroids)):
        left = np.flatnonzero((bound[:, c] <= best) & (first != c))
        if not len(left):
            continue
        exact = squared(vectors[left], centroids[c])
        taken += len(left)
        closer = (exact < best[left]) | ((exact == best[left]) & (c < label[left]))
        best[left[closer]] = exact[closer]
        label[left[closer]] = c
    return label, best, taken


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: float = 64.0, k: int = 16, rounds: int = 3, seed: str = "1", n_pivots: int = 8, sample: int = 1024
) -> DataFrame:
    """Clusters as ``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256``, a row per kept vector.

    Vectors of exactly ``dims`` finite components take part, as floor(scale * x).  The first centroids are the k
    vectors with the least lowercase-hex sha256 of ``seed:id`` (ties: the smaller vector); each round assigns every
    vector to the nearest centroid (squared Euclidean distance, ties: the smaller number) and puts every centroid with
    vectors at their exact componentwise floor(sum / count).  At last all are assigned once more.  Pivots are chosen
    from at most ``sample`` vectors; which ones they are does not change any result.

    Cases: other vectors give no row.  Repeated rows count each for itself.  A vector with a null id takes part, but is no
    first centroid.  Fewer than k vectors give fewer centroids; an empty table, or one with null ids only, gives an empty result.
    Integers beyond MOST stay at MOST.  Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x")).where(finite("x") & (F.size("x") == dims)).select("id", scaled("x", scale, MOST).alias("v"))
    named = lambda s: F.sha2(F.concat(F.lit(f"{s}:"), F.col("id").cast("string")), 256)
    first = kept.where("id is not null").orderBy(named(seed), "v").limit(k).collect()
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], np.int64)
    some = np.array([r["v"] for r in kept.where("id is not null").orderBy(named("pivot"), "v").limit(sample).collect()], np.int64)
    pivots = pivots_of(some, n_pivots)
    p = len(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dims).astype(np.int64)
            apart = np.column_stack([squared(v, x) for x in pivots]) if len(v) else np.zeros((0, p), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists(apart, pa.int64())], names=["id", "v", "to_pivots"])

    table = written(kept.mapInArrow(measure, "id long, v array<int>, to_pivots array<long>"), "pivot-table")

    def assigned(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        center_pivots = np.sqrt(np.column_stack([squared(centers, x) for x in pivots]).astype(float))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                v = matrix(part.column("v"), dims).astype(np.int64)
                label, best, _ = nearest(v, np.sqrt(matrix(part.column("to_pivots"), p).astype(float)), centers, center_pivots)
                yield part.column("id"), v, label, best

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centers: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(centers.shape, np.int64), np.zeros(len(centers), np.int64)
            for _, v, label, _ in assigned(batches, centers):
                for c in range(len(centers)):
                    mine = label == c
                    total[c] += v[mine].sum(axis=0)
                    count[c] += mine.sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(centers)), pa.int32()), pa.array(count), lists(total, pa.int64())], names=["cluster", "n", "total"])

        wide = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(dims)]
        told = table.mapInArrow(sums, "cluster int, n long, total array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect()  # k rows
        centroids = centroids.copy()
        for r in told:
            if r["n"]:
                centroids[r["cluster"]] = [int(r[f"t{i}"]) // r["n"] for i in range(dims)]

    def final(batches: Iterator[pa.RecordBatch], centers: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for ids, _, label, best in assigned(batches, centers):
            yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    rows = written(table.mapInArrow(final, "id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    per = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in range(len(centroids))]
    about = F.broadcast(spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return rows.join(about, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
