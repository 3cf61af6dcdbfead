"""Centroid clustering with a table of pivot distances (LAESA).

Every vector's distance to a few fixed pivots is worked out once and stored beside it. In
each round the centroids' distances to the pivots are known too, and the difference of
the two distances to any pivot bounds the distance between vector and centroid from
below. The centroid of the least bound is measured first; only centroids whose bound does
not already exceed that distance are measured after it. Bounds are whole numbers with the
rounding taken off, and a centroid is passed over only when it is strictly farther, so
assignments equal those of a full search; measured distances are exact integers and ties
go to the smaller number.

The driver holds the centroids (clusters x components) and nothing that grows with the
table. A round reads the stored table once; each task adds up its vectors by centroid.

Defined cases: only vectors with the asked number of components, all there and finite,
take part; other rows have no result. A repeated ``vec_id`` is a vector of its own in
every row. Start vectors with equal hashes are ordered by their components; a null
``vec_id`` comes last. With fewer vectors than clusters there are as many clusters as
vectors. Components beyond ``component_limit`` (134,217,728 at 64 components, values
beyond 524,288 at scale 256) count as that limit, so that a squared distance fits in a
long. An empty table gives an empty result. Other columns decide nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.plan import local_table
from gavel.llm.vectors import (
    SLACK, Sums, added_up, in_chunks, integers, is_finite_vector, matrix, rooted, squared, squared_to, stored,
)

CLUSTERS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SALT = 2
PIVOTS = 8


def whole_vectors(embeddings: DataFrame, dims: int, scale: int) -> DataFrame:
    """``vec_id, v``: the vectors that take part, as integers."""
    raw = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    kept = raw.where((F.size("e") == dims) & is_finite_vector(F.col("e")))
    return kept.select("vec_id", integers(F.col("e"), scale, dims).alias("v"))


def start_order(salt: int) -> list[Column]:
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return [mark.asc_nulls_last(), F.col("v")]


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the points: the first, then always the one farthest from those taken."""
    taken = [0]
    nearest = squared(points, points[0])
    while len(taken) < min(n, len(points)):
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(points, points[taken[-1]]))
    return points[taken]


def nearest_centroids(
    vectors: np.ndarray, pivot_roots: np.ndarray, centroids: np.ndarray, centroid_roots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, how many distances were measured).

    Roots are in sixteenths and off by ``SLACK`` at most, each of the two in a difference
    and the one they are compared with.
    """
    bound = np.zeros((len(vectors), len(centroids)), np.int64)
    for p in range(pivot_roots.shape[1]):
        np.maximum(bound, np.abs(pivot_roots[:, p, None] - centroid_roots[None, :, p]), out=bound)
    bound -= 2 * SLACK
    first, row = bound.argmin(axis=1), np.arange(len(vectors))
    distance = np.full(bound.shape, np.iinfo(np.int64).max)
    distance[row, first] = squared(vectors, centroids[first])
    reach = rooted(distance[row, first]) + SLACK
    left = bound < reach[:, None]  # the others are strictly farther than the first
    left[row, first] = False
    at, centre = np.nonzero(left)
    distance[at, centre] = squared(vectors[at], centroids[centre])
    best = distance.argmin(axis=1)  # the first of equals
    return best, distance[row, best], len(at) + len(vectors)


@dataclass(frozen=True)
class Clustering:
    """``assigned`` (vec_id, cluster, distance) and the final ``centroids``; ``measured``
    and ``possible`` count the distances worked out in the rounds and those of a full search."""

    assigned: DataFrame
    centroids: np.ndarray
    measured: int
    possible: int


def cluster(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS,
    scale: int = SCALE, salt: int = SALT, pivots: int = PIVOTS,
) -> Clustering:
    vectors = whole_vectors(embeddings, dims, scale)
    start = vectors.orderBy(*start_order(salt)).limit(clusters).collect()
    centroids = np.array([r["v"] for r in start], np.int64).reshape(-1, dims)
    fixed = far_apart(centroids, pivots) if len(centroids) else centroids
    width = len(fixed)

    def to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            roots = rooted(squared_to(matrix(batch.column("v"), dims), fixed))
            offsets = pa.array(np.arange(0, roots.size + 1, width), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(roots.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], names=["vec_id", "v", "p"])

    if not len(centroids):
        empty = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(empty.limit(0), centroids, 0, 0)
    table = stored(vectors.mapInArrow(to_pivots, "vec_id long, v array<int>, p array<long>"), "pivot-table")

    def search(batch: pa.RecordBatch, now: np.ndarray, roots: np.ndarray):
        rows = matrix(batch.column("v"), dims)
        return rows, *nearest_centroids(rows, matrix(batch.column("p"), width), now, roots)

    def round_sums(now: np.ndarray):
        roots = rooted(squared_to(now, fixed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, measured = Sums(len(now), dims), 0
            for batch in in_chunks(batches):
                rows, centre, _, n = search(batch, now, roots)
                sums.add(rows, centre)
                measured += n
            found = np.flatnonzero(sums.counts)
            columns = [
                pa.array(found, pa.int32()), pa.array(sums.counts[found], pa.int64()),
                pa.array(sums.totals[found].tolist(), pa.list_(pa.int64())),
                pa.array([measured] + [0] * (len(found) - 1) if len(found) else [], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["centre", "n", "sums", "measured"])

        return table.mapInArrow(run, "centre int, n long, sums array<long>, measured long")

    measured = possible = 0
    for _ in range(rounds):
        total = Sums(len(centroids), dims)
        spread = round_sums(centroids).withColumn("sums", F.concat("sums", F.array("measured")))
        for r in added_up(spread, "centre", dims + 1):
            total.counts[r["centre"]] = r["n"]
            total.totals[r["centre"]] = [r[f"s{i}"] for i in range(dims)]
            measured, possible = measured + r[f"s{dims}"], possible + r["n"] * len(centroids)
        centroids = total.moved(centroids)

    final_roots = rooted(squared_to(centroids, fixed))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            _, centre, distance, _ = search(batch, centroids, final_roots)
            columns = [batch.column("vec_id"), pa.array(centre, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    assigned = stored(table.mapInArrow(last, "vec_id long, cluster int, distance long"), "clusters")
    return Clustering(assigned, centroids, measured, possible)


def cluster_report(embeddings: DataFrame, **settings) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    done = cluster(embeddings, **settings)
    sums = {r["cluster"]: r["s"] for r in done.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [
        (i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(done.centroids.tolist())
    ]
    names = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = local_table(embeddings.sparkSession, rows, names)
    return done.assigned.join(F.broadcast(centroids), "cluster").select(  # one row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
