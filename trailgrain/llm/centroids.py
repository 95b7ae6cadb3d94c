"""Centroid clustering of integer vectors with block-norm screening.

A vector of integers is cut into segments, and the norms of its segments are its compressed form. By the inequality of Cauchy
and Schwarz the squared distance to a centroid is at least the squared distance of the two compressed forms. A vector gets its
exact distance to the centroid of the least bound first; of the others only those whose bound is not above the best exact
distance so far are computed, in integers. Rounds store nothing but the vectors; a task returns one row of sums for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.llm.shared import small_batches, stored

SEGMENT = 8  # components of a segment
SLACK = 1e-9  # share by which bounds are lowered for rounding; far above the error of sums of 64 doubles
LARGEST = 1 << 27  # of components in absolute value, so that squared distances and a round's sums fit 64 bits


def norms(v: np.ndarray) -> np.ndarray:
    """The norm of each segment of each row."""
    width = -(-v.shape[1] // SEGMENT) * SEGMENT
    padded = np.zeros((len(v), width))
    padded[:, : v.shape[1]] = v
    return np.sqrt((padded.reshape(len(v), -1, SEGMENT) ** 2).sum(2))


def nearest(v: np.ndarray, compressed: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector its nearest centroid (ties: the smaller number), the squared distance, and how many distances were computed in all."""
    short = norms(centroids)
    size, sizes = (compressed**2).sum(1), (short**2).sum(1)
    bound = size[:, None] + sizes[None, :] - 2 * compressed @ short.T
    bound -= SLACK * (size[:, None] + sizes[None, :]) + SLACK
    best = bound.argmin(1)
    least = ((v - centroids[best]) ** 2).sum(1)
    first, done = best.copy(), len(v)
    for k in range(len(centroids)):
        at = np.flatnonzero((bound[:, k] <= least) & (first != k))
        done += len(at)
        d = ((v[at] - centroids[k]) ** 2).sum(1)
        win = (d < least[at]) | ((d == least[at]) & (k < best[at]))
        best[at[win]], least[at[win]] = k, d[win]
    return best, least, done


def _matrix(column: pa.ListArray, dtype: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def integer_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, v (array of floor(scale * x)) and the compressed form of the rows with exactly `dims` components, none null or not finite."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.floor(scale * _matrix(b.column("x"), np.float64))
                if np.abs(x).max() >= LARGEST:
                    raise ValueError(f"components of {LARGEST / scale:g} or more in absolute value are not supported")
                v = x.astype(np.int32)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(t)) for a, t in ((v, pa.int32()), (norms(v), pa.float64()))]
                yield pa.record_batch([b.column("vec_id"), *lists], ["vec_id", "v", "compressed"])

    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == dims).where(~bad)
    return rows.mapInArrow(pack, "vec_id long, v array<int>, compressed array<double>")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """One row for each vector kept: vec_id, cluster, distance, cluster_inertia, inertia (long; squared Euclidean) and centroid_sha256.

    Kept are vectors of `dims` components, none null or not finite; each component becomes floor(scale * x). The k vectors with
    the smallest SHA-256 of `seed:vec_id` are the first centroids (a null vec_id comes last; equal ids by their components).
    Rounds assign every vector to the nearest centroid and move each centroid that has vectors to the floor of their mean. Fewer
    than k vectors make fewer centroids; repeated rows count each; no vectors give no rows. Components of LARGEST / scale or more
    raise an error. Only centroids, k rows of sums a task and k totals pass the driver.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kept = stored(integer_vectors(vectors, dims, scale), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds if len(first) else 0):
        centroids = moved(kept, centroids)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    placed = stored(assigned(kept, centroids), "placed")
    totals = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    table = [(r.cluster, r.cluster_inertia, sum(t.cluster_inertia for t in totals), names[r.cluster]) for r in totals]
    known = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of each vector."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                best, least, _ = nearest(_matrix(b.column("v"), np.int64), _matrix(b.column("compressed"), np.float64), centroids)
                yield pa.record_batch([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(least)], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(place, "vec_id long, cluster int, distance long")


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of exact means; those without vectors stay."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"), np.int64)
                best, _, _ = nearest(v, _matrix(b.column("compressed"), np.float64), centroids)
                at = np.argsort(best, kind="stable")
                there, starts = np.unique(best[at], return_index=True)
                sums[there] += np.add.reduceat(v[at], starts, axis=0)
                counts += np.bincount(best, minlength=k)
        own = np.flatnonzero(counts)
        columns = [pa.array(own.astype(np.int32)), pa.array(counts[own]), *[pa.array(sums[own, d]) for d in range(dims)]]
        yield pa.record_batch(columns, ["cluster", "n", *[f"s{d}" for d in range(dims)]])

    sums = [f"s{d}" for d in range(dims)]
    parts = kept.mapInArrow(add, "cluster int, n long, " + ", ".join(f"{s} long" for s in sums))
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect():
        out[r.cluster] = [r[s] // r.n for s in sums]
    return out
