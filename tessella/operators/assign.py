"""Nearest centroid of every point: three plans of the same operator.

* arrow: Arrow batches against a broadcast matrix, a block of centroids at a time, so a batch needs rows times TILE numbers whatever K;
* sql: one broadcast row per batch and a running minimum over its array, all in the JVM (works on streams as well);
* join: points times centroids, then a minimum per point. Every pair is a row, so it is for checks on small inputs only.

Of equal distances the lowest cluster id wins. Euclidean distances are squared and never below zero; for cosine and dot the largest dot
product wins (points and centroids are taken as they are: normalise before for cosine).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.vectors import dot, let, sq_dist, sq_norm

from .centroids import Centers, from_frame, packed, to_frame

METRICS = ("euclidean", "cosine", "dot")
TILE = 1024


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")


def assign(points: DataFrame, centers: DataFrame | Centers, metric: str = "euclidean", engine: str = "arrow", with_distance: bool = False) -> DataFrame:
    """(batch_id, point_id, cluster_id[, distance]). distance is the squared Euclidean one, or minus the dot product.

    Points of a batch without centroids are an error in the arrow engine and dropped by the others. An empty table gives an empty one.
    """
    check_metric(metric)
    spark = points.sparkSession
    if engine == "arrow":
        out = _arrow(points, from_frame(centers) if isinstance(centers, DataFrame) else centers, metric)
    elif engine in ("sql", "join"):
        frame = centers if isinstance(centers, DataFrame) else to_frame(spark, centers)
        out = (_sql if engine == "sql" else _join)(points, frame, metric)
    else:
        raise ValueError("engine is 'arrow', 'sql' or 'join'")
    return out if with_distance else out.drop("distance")


def score(metric: str, x: Column, x_sq: Column, c: Column) -> Column:
    """What is to be smallest. c: a struct of cluster_id, center, c_sq."""
    return sq_dist(x, x_sq, c["center"], c["c_sq"]) if metric == "euclidean" else -dot(x, c["center"])


def nearest(x: Column, cs: Column, metric: str) -> Column:
    """STRUCT<distance, cluster_id> of the nearest of an array of centroids."""
    scored = lambda x_sq: F.array_min(F.transform(cs, lambda c: F.struct(score(metric, x, x_sq, c).alias("distance"), c["cluster_id"].alias("cluster_id"))))
    return let(sq_norm(x), scored) if metric == "euclidean" else scored(F.lit(0.0))


def _sql(points: DataFrame, centers: DataFrame, metric: str) -> DataFrame:
    best = nearest(F.col("features"), F.col("cs"), metric)
    met = points.join(F.broadcast(packed(centers)), "batch_id").select("batch_id", "point_id", best.alias("best"))
    return met.select("batch_id", "point_id", F.col("best.cluster_id").alias("cluster_id"), F.col("best.distance").alias("distance"))


def _join(points: DataFrame, centers: DataFrame, metric: str) -> DataFrame:
    c = F.struct("cluster_id", "center", sq_norm(F.col("center")).alias("c_sq"))
    pairs = points.withColumn("x_sq", sq_norm(F.col("features"))).join(F.broadcast(centers.select("batch_id", c.alias("c"))), "batch_id")
    best = F.min(F.struct(score(metric, F.col("features"), F.col("x_sq"), F.col("c")).alias("distance"), F.col("c.cluster_id")))
    return pairs.groupBy("batch_id", "point_id").agg(best.alias("best")).select("batch_id", "point_id", F.col("best.cluster_id").alias("cluster_id"), F.col("best.distance").alias("distance"))


def _arrow(points: DataFrame, centers: Centers, metric: str) -> DataFrame:
    sent = points.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        for batch in batches:
            owner, x = columns(batch)
            labels, distance = label(owner, x, sent.value, metric)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.int32()), pa.array(distance, pa.float64())], ["batch_id", "point_id", "cluster_id", "distance"])

    return points.select("batch_id", "point_id", "features").mapInArrow(run, "batch_id long, point_id long, cluster_id int, distance double")


def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Batch ids and the matrix of features of rows of (batch_id, point_id, features)."""
    column = batch.column(2)
    n = len(column)
    if column.null_count:
        raise ValueError("a point has no features")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if n and (lengths != lengths[0]).any():
        raise ValueError("points differ in length")
    return batch.column(0).to_numpy(), flat.reshape(n, -1) if n else np.empty((0, 0))


def label(owner: np.ndarray, x: np.ndarray, centers: Centers, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Labels and distances of rows, each by the centroids of its batch."""
    labels, distance = np.zeros(len(x), np.int32), np.zeros(len(x))
    for b in np.unique(owner).tolist():
        if b not in centers:
            raise ValueError(f"batch {b} has no centroids")
        c = centers[b]
        own = owner == b
        rows = x if own.all() else x[own]
        if rows.shape[1] != c.shape[1]:
            raise ValueError("points and centroids differ in length")
        labels[own], distance[own] = closest(rows, c, metric)
    return labels, distance


def closest(x: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
    x_sq = np.einsum("ij,ij->i", x, x)[:, None] if metric == "euclidean" else None
    c_sq = np.einsum("ij,ij->i", c, c) if metric == "euclidean" else None
    for k in range(0, len(c), TILE):
        d = x @ c[k : k + TILE].T
        if metric == "euclidean":
            d *= -2.0
            d += x_sq
            d += c_sq[k : k + TILE]
            np.maximum(d, 0.0, out=d)
        else:
            np.negative(d, out=d)
        i = d.argmin(axis=1)  # the first of equal ones
        own = d[np.arange(len(x)), i]
        less = own < best
        best[less], at[less] = own[less], i[less] + k
    return at, best
