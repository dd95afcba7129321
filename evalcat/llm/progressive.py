"""Centroid clustering of integer vectors by Walsh-Hadamard progressive search.

Vectors of ``WIDTH`` = 64 components become integers floor(1024 * x). The
Walsh-Hadamard transform of integers is exact and keeps distances but for the
factor 64, so a squared distance is the sum of 64 squared coefficient
differences over 64. Coefficients are taken coarse to fine (by the number of
sign changes of their base vector): after each band of them a centroid's sum is
a bound from below, and with the energy left in both vectors the Cauchy-Schwarz
inequality gives one from above; centroids strictly worse than the best bound
from above are out. Those left after all 64 are compared by exact distance,
ties to the smaller number.

Vectors are staged once in the shared folder. Every round is one scan of them:
tasks return per centroid the count and component sums of their vectors, Spark
adds these up, and only the k x 64 sums reach the driver. The next centroids
travel back with the tasks.

Edge cases: vectors that are null, of another length or hold null or non-finite
components take no part. Neither do those with a component of 16384 or more in
size, whose squared distances a long might not hold. Rows of equal ids are
vectors of their own. A row without an id takes part but starts no centroid.
Fewer than k rows with ids: so many centroids; of several starts with equal
hashes the smaller vectors come first. No such row: no vector has a cluster,
and the result is empty. Other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcat.llm.common import staged

WIDTH, SCALE, LARGEST = 64, 1024, 1 << 24
#: Coefficients done after each step of the search.
BANDS = (1, 4, 8, 16, 32, 64)
#: Vectors per step within a task.
ROWS = 4096


def sequency_order(width: int = WIDTH) -> np.ndarray:
    """Rows of the Hadamard matrix by sign changes: coarse to fine."""
    h = np.ones((1, 1), np.int64)
    while len(h) < width:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of integer rows, coefficients coarse to fine."""
    y, width = x.astype(np.int64), x.shape[1]
    half = 1
    while half < width:
        z = y.reshape(len(y), -1, 2, half)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), width)
        half *= 2
    return y[:, sequency_order(width)]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of integer rows by progressive search."""
    v, c = hadamard(x), hadamard(centroids)
    n, k = len(v), len(c)
    sums = np.zeros((n, k), np.int64)
    open_ = np.ones((n, k), bool)
    done = 0
    for end in BANDS:
        for j in range(k):
            rows = np.flatnonzero(open_[:, j])
            diff = v[rows, done:end] - c[j, done:end]
            sums[rows, j] += np.einsum("ij,ij->i", diff, diff)
        done = end
        if end < x.shape[1]:
            rest_v = np.sqrt((v[:, end:].astype(np.float64) ** 2).sum(axis=1))
            rest_c = np.sqrt((c[:, end:].astype(np.float64) ** 2).sum(axis=1))
            above = sums + (rest_v[:, None] + rest_c[None, :]) ** 2
            best = np.where(open_, above, np.inf).min(axis=1)
            # a little more than rounding can take away
            open_ &= sums <= (best * (1 + 1e-12) + 1.0)[:, None]
    sums[~open_] = np.iinfo(np.int64).max
    cluster = sums.argmin(axis=1)
    return cluster, sums[np.arange(n), cluster] // x.shape[1]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<int>) of the vectors that take part."""
    v = F.col("v")
    small = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(LARGEST // SCALE)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = rows.where(v.isNotNull() & (F.size(v) == WIDTH) & F.coalesce(F.forall(v, small), F.lit(False)))
    return kept.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE))).cast("int")).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.int64)


def _sums(centroids: np.ndarray):
    """Per task: (cluster, n, sums) of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        n, total = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = _matrix(b.slice(at, ROWS))
                cluster, _ = nearest(x, centroids)
                n += np.bincount(cluster, minlength=k)
                np.add.at(total, cluster, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                cluster, distance = nearest(_matrix(part), centroids)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of the means of their vectors."""
    parts = points.select("x").mapInArrow(_sums(centroids), "cluster long, n long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")) if isinstance(c, str) else F.sum(c.cast("decimal(38,0)"))
    rows = parts.groupBy("cluster").agg(exact("n").alias("n"), *[exact(F.col("sums")[i]).alias(f"s{i}") for i in range(WIDTH)]).collect()  # k rows
    now = centroids.copy()
    for r in rows:
        now[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(WIDTH)]
    return now


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Clusters and final centroids. Centroids start as the k vectors with the
    smallest sha256 of "<seed>:<id>". A row per vector: id column, cluster,
    distance, cluster_inertia, inertia, centroid_sha256."""
    points = staged(integer_vectors(vectors, id_col, vector_col), "integer-vectors")
    starts = points.where(F.col("id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    centroids = np.array([r["x"] for r in starts.orderBy("h", "x").limit(k).collect()], np.int64).reshape(-1, WIDTH)
    spark = points.sparkSession
    if not len(centroids):
        none = spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        return none, centroids
    for _ in range(rounds):
        centroids = moved(points, centroids)
    found = staged(points.mapInArrow(_assigned(centroids), "id long, cluster int, distance long"), "clusters")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(total("distance").alias("s")).collect()}  # k rows
    facts = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    of = spark.createDataFrame(facts, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    joined = found.join(F.broadcast(of), F.col("cluster") == F.col("of"))
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
