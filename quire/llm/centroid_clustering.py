"""Centroid clustering by weighted deduplication: Lloyd's rounds run over distinct quantised vectors with multiplicities.

Equal vectors are grouped first; each round compares the distinct ones with the few centroids and adds up whole numbers,
weighted by the multiplicities, so the result doesn't depend on how rows are dealt out or tasks repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Components stay below this in magnitude, so that squared distances of 64 of them fit a long.
LIMIT = 1 << 27
#: Vectors that are joined by broadcast at most: those with at least one HOT-th of all rows.
HOT = 1024
#: Vectors that a task compares at a time.
STEP = 8192


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equally near ones) and squared distance of each row, exact."""
    most = max(1, int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64  # doubles are whole numbers up to there
    x, c = x.astype(kind), centroids.astype(kind)
    far = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    label = far.argmin(1)
    return label, far[np.arange(len(x)), label].astype(np.int64)


def quantised(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, q) of the rows whose vectors have `dim` finite components: floor(scale * component)."""
    fine = f"size(embedding) = {dim} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < {LIMIT // scale})"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).filter(fine)
    return rows.select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale} * x) as int))").alias("q"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors of the k rows with the smallest hashes of their ids; rows without an id come last, equal ids in the order of their vectors."""
    name = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    return [r.q for r in rows.select(name.alias("name"), "q").orderBy(F.asc_nulls_last("name"), "q").limit(k).collect()]  # k is the feature


def moved(distinct: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """The centroids after a round: the floor of the mean of their vectors, as they were where they have none."""

    def add(batches: Iterator[pa.RecordBatch], own=tuple(map(tuple, centroids))) -> Iterator[pa.RecordBatch]:
        known = np.array(own, np.int64)
        total = np.zeros((len(known), dim + 1), object)  # Python's whole numbers, however large
        for batch in batches:
            for part in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                x, times = matrix(part["q"], dim), part["copies"].to_numpy()
                x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
                label, _ = nearest(x[:, :dim], known)
                wide = int(times.max(initial=0)) * len(x) * LIMIT >= 1 << 62
                for j in np.unique(label):
                    at = label == j
                    weighted = x[at].astype(object if wide else np.int64) * times[at, None].astype(object if wide else np.int64)
                    total[j] += weighted.sum(0).astype(object)
        j, d = np.nonzero(total)
        values = pa.array([Decimal(int(v)) for v in total[j, d]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(d.astype(np.int32)), values], ["cluster", "at", "total"])

    sums = distinct.mapInArrow(add, "cluster int, at int, total decimal(38,0)").groupBy("cluster", "at").agg(F.sum("total").alias("total"))
    found = {(r.cluster, r.at): int(r.total) for r in sums.collect()}  # k * (dim + 1) numbers at most
    return [[found.get((j, d), 0) // found[j, dim] for d in range(dim)] if (j, dim) in found else c for j, c in enumerate(centroids)]


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """One row per kept row of `vectors` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are rows whose vector has `dim` components, none of them null, not finite, or LIMIT / scale or more in magnitude
    (squared distances of such would not fit a long). Repeated rows count and return each; a null vec_id takes part, and
    starts a centroid only where fewer than `k` rows have an id. With fewer than `k` rows there are as many centroids.
    Rounds end early where nothing moves, which changes no result. A sum that no long holds is null. Other columns are
    ignored. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, dim, scale)
    distinct = written(rows.groupBy("q").agg(F.count("*").alias("copies")), "vectors")
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, moved(distinct, centroids, dim)
        if centroids == before:
            break

    def assign(batches: Iterator[pa.RecordBatch], own=tuple(map(tuple, centroids))) -> Iterator[pa.RecordBatch]:
        known = np.array(own, np.int64)
        for batch in batches:
            for part in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                label, far = nearest(matrix(part["q"], dim), known)
                yield pa.RecordBatch.from_arrays([part["q"], part["copies"], pa.array(label.astype(np.int32)), pa.array(far)], ["q", "copies", "cluster", "distance"])

    assigned = written(distinct.mapInArrow(assign, "q array<int>, copies long, cluster int, distance long"), "assigned")
    forget(distinct)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)") * F.col("copies")).alias("s"), F.sum("copies").alias("n")).collect()  # k rows
    fits = lambda x: x if x < 1 << 63 else None
    every, count = sum(int(r.s) for r in sums), sum(r.n for r in sums)
    names = [(r.cluster, fits(int(r.s)), fits(every), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    known = F.broadcast(spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    # A vector with many copies would bring all of them to one task: there are HOT such vectors at most, which are broadcast.
    hot = assigned.filter(F.col("copies") * HOT >= count)
    few, rest = F.broadcast(hot.select("q", "cluster", "distance")), assigned.filter(F.col("copies") * HOT < count).select("q", "cluster", "distance")
    out = rows.join(few, "q").unionByName(rows.join(F.broadcast(hot.select("q")), "q", "left_anti").join(rest, "q"))
    return out.join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
