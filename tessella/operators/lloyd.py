"""Lloyd's iteration over a DataFrame of points, for one or many batches at once.

Semantics that are easy to get wrong and are kept here: labels belong to the centroids before the last update; a run that stops because
centroids moved less than tol returns those before the update, one that runs out of iterations those after it (`return_updated` asks for
the latter always); the move is absolute, compared strictly and taken over all batches together; a cluster without points keeps its
centroid; cosine normalises points and starting centroids; dot doesn't, but its updates do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tessella.functions.vectors import l2_normalize

from .assign import assign, check_metric
from .centroids import Centers, from_frame, packed, seeded, to_frame
from .update import finalize, means, partial_sums, step_sums, unit


@dataclass(frozen=True)
class Run:
    """labels: (batch_id, point_id, cluster_id), lazily from the points; centers: final centroids; history: the move per iteration."""

    labels: DataFrame
    centers: DataFrame
    n_iter: int
    history: list[float] = field(default_factory=list)


def kmeans(
    points: DataFrame,
    k: int,
    metric: str = "euclidean",
    max_iters: int = 100,
    tol: float = 0.0,
    init: DataFrame | None = None,
    seed: int = 0,
    engine: str = "arrow",
    return_updated: bool = False,
    verbose: bool = False,
) -> Run:
    """K-means over (batch_id, point_id, features). init: starting centroids (batch_id, cluster_id, center); else drawn by `seed`, with
    replacement. engine 'arrow' assigns and sums in one Arrow pass per iteration, 'sql' stays in the JVM. An empty table is an error."""
    check_metric(metric)
    if max_iters < 1:
        raise ValueError("max_iters is at least 1")
    if k < 1:
        raise ValueError("k is at least 1")
    if engine not in ("arrow", "sql"):
        raise ValueError("engine is 'arrow' or 'sql'")
    spark = points.sparkSession
    start = init if init is not None else seeded(points, k, seed)
    if metric == "cosine":
        points = points.withColumn("features", l2_normalize(F.col("features")))
    kept = points.storageLevel.useMemory or points.storageLevel.useDisk  # a table that the caller cached stays cached
    centers = from_frame(start)
    if not centers:
        raise ValueError("there are no points")
    if any(len(c) != k for c in centers.values()):
        raise ValueError("a batch hasn't K starting centroids")
    if metric == "cosine":
        centers = {b: unit(c) for b, c in centers.items()}
    history: list[float] = []
    before = centers
    cached = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(max_iters):
            before = centers
            new = (_arrow_step if engine == "arrow" else _sql_step)(cached, centers, metric)
            move = max(float(np.linalg.norm(new[b] - centers[b], axis=1).max()) for b in centers)
            history.append(move)
            if verbose:
                print(f"iteration {len(history)}: shift {move:.6g}")
            stop = move < tol
            centers = new if return_updated or not stop else centers
            if stop:
                break
    finally:
        if not kept:
            cached.unpersist()
    return Run(assign(points, before, metric, engine), to_frame(spark, centers), len(history), history)


def _arrow_step(points: DataFrame, centers: Centers, metric: str) -> Centers:
    return means(step_sums(points, centers, metric), centers, metric != "euclidean")


def _sql_step(points: DataFrame, centers: Centers, metric: str) -> Centers:
    from .assign import nearest

    frame = to_frame(points.sparkSession, centers)
    best = nearest(F.col("features"), F.col("cs"), metric)["cluster_id"]
    labelled = points.join(F.broadcast(packed(frame)), "batch_id").select("batch_id", best.alias("cluster_id"), "features")
    return from_frame(finalize(partial_sums(labelled, "sql"), frame, metric != "euclidean"))
