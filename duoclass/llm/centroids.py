"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers, so few different values occur in a dimension.  Each round
tabulates, for every dimension, the squared difference of each occurring value and each
centroid; a vector's distances are then rows gathered from these tables and summed.  Tasks
add up their vectors by cluster, and the sums of all tasks give the next centroids exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoclass.llm.common import batch_of, cut, drop, no_state, prepare

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
# Scaled components below this bound have squared distances that fit a long (64 * 2^56).
MOST = 1 << 27
TABLE_ROWS = 4096        # vectors whose occurring values are tabulated at once


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a column, ascending, and the place of each row's value."""
    low = int(column.min())
    span = int(column.max()) - low + 1
    if span > 4 * len(column) + 1024:
        return np.unique(column, return_inverse=True)
    at = column - low
    there = np.zeros(span, bool)
    there[at] = True
    place = np.cumsum(there) - 1
    return np.flatnonzero(there) + low, place[at]


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (of equals the first) and squared distance of each vector."""
    total = np.zeros((len(vectors), len(centroids)), np.int64)
    for d in range(vectors.shape[1]):
        values, place = occurring(vectors[:, d])
        table = (values[:, None] - centroids[:, d][None, :]) ** 2
        total += table[place]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(vectors)), best]


def _vectors(rb: pa.RecordBatch, at: int, dims: int):
    col = rb.column(at)
    return np.asarray(col.flatten()).astype(np.int64).reshape(len(col), dims)


def _sums(sent, dims: int):
    def run(batches):
        no_state()
        c = sent.value
        n, total = np.zeros(len(c), np.int64), np.zeros((len(c), dims), np.int64)
        for rb in batches:
            for lo in range(0, rb.num_rows, TABLE_ROWS):
                v = _vectors(rb.slice(lo, TABLE_ROWS), 1, dims)
                best, _ = assign(v, c)
                n += np.bincount(best, minlength=len(c))
                np.add.at(total, best, v)
        full = np.flatnonzero(n)
        if len(full):
            yield batch_of(["cluster", "n", "total"], pa.array(full, pa.int32()), pa.array(n[full]),
                           pa.array(total[full].tolist(), pa.list_(pa.int64())))

    return run


def _assigned(sent, dims: int):
    def run(batches):
        no_state()
        for rb in batches:
            for lo in range(0, rb.num_rows, TABLE_ROWS):
                part = rb.slice(lo, TABLE_ROWS)
                best, dist = assign(_vectors(part, 1, dims), sent.value)
                yield batch_of(["id", "cluster", "distance"], part.column(0), pa.array(best, pa.int32()), pa.array(dist))

    return run


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v) of the vectors with exactly ``dims`` components, none null or non-finite:
    v = floor(scale * component), calculated in doubles.

    Vectors with a value of 2^27 or more after scaling are left out as well, as their squared
    distances wouldn't fit a long.
    """
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < MOST))
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return df.where((F.size(vec_col) == dims) & whole).select(F.col(id_col).alias("id"), v.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:id`` (hex), in that order.

    Repeated ids follow each other by their components; rows without an id come last.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(h.asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def next_centroids(found: list, centroids: np.ndarray) -> np.ndarray:
    """Floors of the exact means; a centroid without vectors stays."""
    new = centroids.copy()
    for r in found:
        new[r["cluster"], r["d"]] = int(r["total"]) // int(r["n"])
    return new


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS,
                    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, cluster_inertia, inertia) of each kept vector, and the final
    centroids.

    Kept are the vectors that ``integer_vectors`` names; rows that repeat count each time.
    With fewer kept vectors than ``clusters`` there are as many centroids as vectors; an
    empty table gives an empty one.  What reaches the driver is one number for each centroid
    and dimension, exact (decimal sums).
    """
    spark = df.sparkSession
    prepare(spark)
    vectors = cut(integer_vectors(df, id_col, vec_col, dims, scale), "vectors")
    centroids = first_centroids(vectors, clusters, seed)
    if len(centroids):
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(centroids)
            parts = vectors.mapInArrow(_sums(sent, dims), "cluster int, n long, total array<long>")
            found = (parts.select("cluster", "n", F.posexplode("total").alias("d", "x")).groupBy("cluster", "d")
                     .agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("total"), F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect())
            sent.unpersist()
            centroids = next_centroids(found, centroids)
    kind = vectors.schema["id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(centroids)
    out = cut(vectors.mapInArrow(_assigned(sent, dims), f"id {kind}, cluster int, distance long"), "assigned")
    drop(vectors)
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in sums)
    by = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total) for r in sums], "cluster int, cluster_inertia long, inertia long")
    return out.join(F.broadcast(by), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    """SHA-256 of each centroid's components in decimal, joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
