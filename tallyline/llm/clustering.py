"""Centroid clustering on integer vectors; bounds are kept over rounds and loosened by planar geometry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import fresh_dir
from .vectors import matrix

#: Points of a centroid's move at which the sphere is viewed.
VIEWS = 16
_STATE = "vec_id long, vector array<int>, cluster int, distance long, lower double, scans int"


def drift(own: np.ndarray, radius: float, before: np.ndarray, after: np.ndarray, views: int = VIEWS) -> float:
    """How much |x - before| - |x - after| can be at most for x in the sphere around `own`: what a lower bound on the distance to a
    centroid that moves loses for the vectors of a cluster.

    The difference is the integral over the move of the cosine of the angle between the move and the sight of x. In the plane
    through the move and the sphere's centre the least such angle is that of a tangent, or 0 where the line of the move
    meets the sphere, and it grows as the centroid moves on. So the cosine at the start of each of `views` pieces holds for
    the piece. The full length of the move is the bound without this geometry; the result is never above it, and is
    negative where the centroid moves away from the whole sphere.
    """
    move = after - before
    length = float(np.sqrt(move @ move))
    if length == 0.0:
        return 0.0
    to = own - before
    along = float(to @ move) / length
    aside = float(np.linalg.norm(to - along / length * move))
    x = along - length * np.arange(views) / views  # the centre as seen from the start of each piece
    far = np.hypot(x, aside)
    inside = far <= radius
    angle = np.arctan2(aside, x) - np.arcsin(np.minimum(radius / np.where(inside, 1.0, far), 1.0))
    return length * float(np.mean(np.where(inside, 1.0, np.cos(np.maximum(angle, 0.0)))))


def loosening(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Per cluster the most that the lower bound on the distance to any other centroid loses."""
    k = len(before)
    return np.array([max((drift(before[i], radii[i], before[j], after[j]) for j in range(k) if j != i), default=0.0) for i in range(k)])


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact: in floats while these hold every integer, else in longs."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) ** 2 * 4 * x.shape[1] < 2**53:
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


def _assign(centroids: np.ndarray, loss: np.ndarray | None):
    """Assign vectors; with `loss`, those whose own centroid is surely nearest keep it without a look at the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, dims = centroids.astype(float), centroids.shape[1]
        for batch in batches:
            x = matrix(batch.column("vector"), dims)
            n = len(x)
            if loss is None:
                cluster, lower, distance, scans = np.zeros(n, np.int32), np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int32)
                open_ = np.ones(n, bool)
            else:
                cluster, lower, scans = (batch.column(name).to_numpy(zero_copy_only=False).copy() for name in ("cluster", "lower", "scans"))
                gap = x.astype(np.int64) - centroids[cluster]
                distance = (gap * gap).sum(1)
                lower = lower - loss[cluster]
                near = np.sqrt(distance.astype(float))
                lower = np.where(np.isinf(lower), lower, lower - 1e-9 * (np.abs(lower) + near + 1))  # above any rounding
                open_ = near >= lower
            at = np.flatnonzero(open_)
            if len(at):
                d = _squares(x[at], c)
                best = d.argmin(axis=1)  # the first, so ties go to the smaller number
                cluster[at], distance[at] = best, d[np.arange(len(at)), best]
                d[np.arange(len(at)), best] = np.iinfo(np.int64).max
                lower[at] = np.sqrt(d.min(axis=1).astype(float)) if len(c) > 1 else np.inf
                scans[at] += 1
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(lower), pa.array(scans.astype(np.int32))], ["vec_id", "vector", "cluster", "distance", "lower", "scans"])

    return run


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """k-means on (vec_id, vector array<int> of one length, see grid_vectors): the assignments (vec_id, cluster, squared distance,
    scans) and the final centroids.

    Centroids start as the k vectors with the least sha256 of `seed:vec_id`. Each round assigns all vectors to the nearest
    centroid (ties: the smaller number) and moves non-empty centroids to floor(sum / count) of each component; then vectors are
    assigned once more. A vector keeps a lower bound on its distance to all other centroids. When centroids move, the bound
    is loosened by drift() over the sphere of its cluster; only vectors whose exact distance to their own centroid is not
    below the bound are compared with all centroids (`scans` counts how often), so results are those of full scans.

    Each round reads and writes the vectors with their bounds as Parquet in the shared folder; the driver holds k centroids,
    their radii and sums. No shuffle carries vectors: sums are made in each task first.

    Defined cases: repeated rows are vectors of their own; null ids are clustered, and are last among starts; of starts with
    equal ids the lesser vector comes first; with fewer than k vectors each starts a centroid; equal centroids leave the
    larger number empty, and it stays where it is; an empty table gives an empty result and no centroids.
    """
    spark = vectors.sparkSession
    path = fresh_dir(spark, "clusters")
    vectors.select("vec_id", "vector").write.parquet(f"{path}/start")
    state = spark.read.schema("vec_id long, vector array<int>").parquet(f"{path}/start")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = state.orderBy(digest.asc_nulls_last(), "vector").limit(k).collect()  # k rows
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, scans int"), []
    centroids, loss = np.array([r["vector"] for r in starts], np.int64).reshape(len(starts), -1), None
    dims = centroids.shape[1]
    for step in range(rounds + 1):
        state.mapInArrow(_assign(centroids, loss), _STATE).write.parquet(f"{path}/round={step}")
        state = spark.read.schema(_STATE).parquet(f"{path}/round={step}")
        if step == rounds:
            break
        sums = [F.sum(F.get("vector", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)]
        moved, radii = centroids.copy(), np.zeros(len(centroids))
        for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect():  # k rows
            moved[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
            radii[r["cluster"]] = np.sqrt(float(r["far"])) * (1 + 1e-12)
        loss, centroids = loosening(centroids.astype(float), moved.astype(float), radii), moved
    return state.select("vec_id", "cluster", "distance", "scans"), centroids.tolist()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add cluster_inertia and inertia (squared distances summed over the cluster and over all) and centroid_sha256 (of the
    centroid's components as decimal integers, joined by commas)."""
    prints = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    marks = assigned.sparkSession.createDataFrame(prints, "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # a row per cluster
    return assigned.join(F.broadcast(sums.join(F.broadcast(marks), "cluster")), "cluster")
