"""Centroid clustering by sort-means, in whole numbers.

In each round the other centroids are ordered by their distance from each centroid. A vector starts at the
centroid that it was assigned to before and scans the others in that order; it stops at the first one that is
strictly farther from its old centroid than twice the vector's own distance from it, since by the triangle
inequality none of the rest can be as near. Ties go to the smaller number, which is why the stop is strict.

Vectors stay where Spark put them: a round is one pass that rewrites each vector's number and one that sums the
vectors of each cluster within tasks. Only k centroids of `size` whole numbers pass through the driver. The table
of the round before is deleted once the next one is written, so a lost executor costs its own tasks.

Defined cases: vectors of another length, or with a null or non-finite component, are left out, as are null
vectors; components are scaled and floored, and those beyond LARGEST in magnitude count as LARGEST, so that
squared distances fit in a long; sums beyond a long count as the largest long. With fewer vectors than k every
vector is a centroid at first; an empty table gives an empty result. Rows are vectors: repeated rows are clustered
each, and of rows that share an id or have none (hashed as an empty id) those of smaller components seed first.
Other columns, whatever their names, are not looked at. Texts play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written

LARGEST = 1 << 27
MOST_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    k: int = 16
    size: int = 64
    scale: int = 64
    rounds: int = 3
    seed: str = "1"


def whole_vectors(df: DataFrame, by: Settings, id_column: str, vector: str) -> DataFrame:
    """(id, v): the vectors that are kept, scaled and floored."""
    v = F.col(f"`{vector}`")
    sound = (F.size(v) == by.size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.lit(float(LARGEST))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * by.scale, most), -most)).cast("bigint")
    return df.where(v.isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(f"`{id_column}`").alias("id"), F.transform(v, whole).alias("v"))


def first_centroids(points: DataFrame, by: Settings) -> np.ndarray:
    """The vectors of the k smallest hashed ids, in the order of the hashes."""
    key = F.sha2(F.concat(F.lit(f"{by.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = points.select(key.alias("h"), "v").orderBy("h", "v").limit(by.k).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), by.size)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = x - centroid
    return np.einsum("ij,ij->i", apart, apart)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid and squared distance, scanned outwards from the one it had before."""
    k = len(centroids)
    between = np.stack([squared(centroids, c) for c in centroids])
    at, best = before.copy(), np.empty(len(x), dtype=np.int64)
    for c in range(k):
        rows = np.flatnonzero(before == c)
        if not len(rows):
            continue
        own = squared(x[rows], centroids[c])
        # farthest vectors first: those that a centroid can still matter to are then a beginning of the list
        far = np.argsort(-own, kind="stable")
        rows, own = rows[far], own[far]
        found, which = own.copy(), np.full(len(rows), c, dtype=before.dtype)
        for o in np.lexsort((np.arange(k), between[c])):
            if o == c:
                continue
            # stop strictly beyond twice the own distance, that is where between > 4 * own in squares
            n = int(np.count_nonzero(own >= (between[c, o] + 3) // 4))
            if n == 0:
                break
            d = squared(x[rows[:n]], centroids[o])
            nearer = (d < found[:n]) | ((d == found[:n]) & (o < which[:n]))
            found[:n] = np.where(nearer, d, found[:n])
            which[:n] = np.where(nearer, o, which[:n])
        at[rows], best[rows] = which, found
    return at, best


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """points (id, v, cluster) with the nearest centroid as cluster, and the squared distance from it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"), centroids.shape[1])
                cluster, distance = nearest(x, b.column("cluster").to_numpy(), centroids)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "v", "cluster").mapInArrow(rows, f"id {kind}, v array<bigint>, cluster int, distance bigint")


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters; a centroid without vectors stays. Each task sums its own vectors first."""
    k, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), dtype=np.int64)
        for b in batches:
            x, cluster = matrix(b.column("v"), size), b.column("cluster").to_numpy()
            np.add.at(total[:, size], cluster, 1)
            for c in np.unique(cluster):
                total[c, :size] += x[cluster == c].sum(axis=0)
        c, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(total[c, i], pa.int64())], ["cluster", "i", "s"])

    found = points.select("v", "cluster").mapInArrow(sums, "cluster int, i int, s bigint").groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = {(r.cluster, r.i): int(r.s) for r in found}  # k * (size + 1) numbers at most
    after = centroids.copy()
    for c in range(k):
        if n := total.get((c, size), 0):
            after[c] = [total.get((c, i), 0) // n for i in range(size)]
    return after


def long_sum(column: str) -> Column:
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("bigint")


def clusters(df: DataFrame, by: Settings = Settings(), id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept."""
    points = written(whole_vectors(df, by, id_column, vector).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(points, by)
    for turn in range(by.rounds + 1):
        if not len(centroids):
            break
        before, points = points, written(assigned(points, centroids), "assigned")
        drop(before)
        if turn < by.rounds:
            centroids = moved(points, centroids)
    if not len(centroids):
        points = points.withColumn("distance", F.lit(0).cast("bigint"))
    digest = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    named = df.sparkSession.createDataFrame(digest, "cluster int, centroid_sha256 string")
    sums = points.groupBy("cluster").agg(long_sum("distance").alias("cluster_inertia"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    every = sums.agg(F.least(F.sum("d"), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("bigint").alias("inertia"))
    of_cluster = sums.drop("d").join(F.broadcast(named), "cluster").crossJoin(every)  # k rows and one row
    return points.join(F.broadcast(of_cluster), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
