"""Centroid update: partial sums, their merge, and the means.

Sums can be taken of several parts, merged and finished later, so a run over blocks or streams needs no second pass. All sums are in
double precision; their order isn't set, so means agree to rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.functions.vectors import EPS, l2_normalize, movement

from .assign import columns, label
from .centroids import Centers, lists

PARTIALS = "batch_id long, cluster_id int, sum array<double>, cnt long"


def clamped(labels: DataFrame, k: int) -> DataFrame:
    """Cluster ids from K on (and below 0) are cluster 0."""
    return labels.withColumn("cluster_id", F.when((F.col("cluster_id") >= k) | (F.col("cluster_id") < 0), 0).otherwise(F.col("cluster_id")))


def partial_sums(labelled: DataFrame, engine: str = "arrow") -> DataFrame:
    """Sums and counts of (batch_id, cluster_id, features) rows; whole arrays in Arrow, combined in each task before the shuffle, or
    ('sql') by position and all in the JVM."""
    if engine == "sql":
        parts = labelled.select("batch_id", "cluster_id", F.posexplode("features").alias("pos", "value"))
        sums = parts.groupBy("batch_id", "cluster_id", "pos").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("cnt"))
        row = F.sort_array(F.collect_list(F.struct("pos", "value")))
        return sums.groupBy("batch_id", "cluster_id").agg(F.transform(row, lambda x: x["value"]).alias("sum"), F.max("cnt").alias("cnt"))
    rows = labelled.select(F.col("batch_id").cast("long"), F.col("cluster_id").cast("int"), F.col("features").alias("sum"), F.lit(1).cast("long").alias("cnt"))
    return added(rows.mapInArrow(tallied, PARTIALS))


def merge_sums(*partials: DataFrame) -> DataFrame:
    """Partial sums of several parts as those of all."""
    whole = partials[0]
    for p in partials[1:]:
        whole = whole.unionByName(p)
    return added(whole.select("batch_id", "cluster_id", "sum", "cnt"))


def finalize(partials: DataFrame, old: DataFrame, normalize: bool = False) -> DataFrame:
    """New centroids: the mean of each cluster; one without points keeps its old centroid; with `normalize` all have length one."""
    means = partials.select("batch_id", "cluster_id", "sum", "cnt").where("cnt > 0")
    mean = F.transform("sum", lambda x: x / F.col("cnt"))
    center = F.coalesce(F.when(F.col("cnt").isNotNull(), mean), F.col("center"))
    out = old.select("batch_id", "cluster_id", "center").join(means, ["batch_id", "cluster_id"], "left")
    return out.select("batch_id", "cluster_id", (l2_normalize(center) if normalize else center).alias("center"))


def update(points: DataFrame, labels: DataFrame, old: DataFrame, normalize: bool = False, clamp: int | None = None) -> DataFrame:
    """One update from labels (batch_id, point_id, cluster_id). clamp: the K beyond which ids count as cluster 0; without it ids beyond
    the old centroids' are an error."""
    labels = clamped(labels, clamp) if clamp is not None else labels
    labelled = points.join(labels, ["batch_id", "point_id"]).select("batch_id", "cluster_id", "features")
    if clamp is None:
        known = F.broadcast(old.select("batch_id", "cluster_id", F.lit(True).alias("known")))
        wrong = F.raise_error(F.lit("a cluster id has no centroid")).cast("int")
        labelled = labelled.join(known, ["batch_id", "cluster_id"], "left").withColumn("cluster_id", F.when(F.col("known"), F.col("cluster_id")).otherwise(wrong)).drop("known")
    return finalize(partial_sums(labelled), old, normalize)


def shifts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(batch_id, cluster_id, shift): how far each centroid moved."""
    moved = movement(F.col("a"), F.col("b")).alias("shift")
    a, b = old.select("batch_id", "cluster_id", F.col("center").alias("a")), new.select("batch_id", "cluster_id", F.col("center").alias("b"))
    return a.join(b, ["batch_id", "cluster_id"]).select("batch_id", "cluster_id", moved)


def max_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(shift): the farthest move of any centroid of any batch."""
    return shifts(old, new).agg(F.max("shift").alias("shift"))


def step_sums(points: DataFrame, centers: Centers, metric: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Assignment and sums in one pass: a task sends at most batches times K sums, whatever its number of points. Few are added up on
    the driver, more by cluster on the executors first."""
    sent = points.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        sums = {b: np.zeros(c.shape) for b, c in centers_of(sent).items()}
        counts = {b: np.zeros(len(c), np.int64) for b, c in sums.items()}
        for batch in batches:
            owner, x = columns(batch)
            labels, _ = label(owner, x, sent.value, metric)
            for b in np.unique(owner).tolist():
                own = owner == b
                rows, ids = (x, labels) if own.all() else (x[own], labels[own])
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                sums[b][ids[first]] += np.add.reduceat(rows[order], first)
                counts[b] += np.bincount(ids, minlength=len(counts[b]))
        out = [(b, int(k), sums[b][k], int(counts[b][k])) for b in sums for k in np.flatnonzero(counts[b])]
        if out:
            yield partials(out)

    spark = points.sparkSession
    parts = points.select("batch_id", "point_id", "features")
    tasks, most = points.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism
    if tasks > most:  # a task's sums are as many whatever its points, so there are only as many tasks as can run at once, twice over
        parts, tasks = parts.coalesce(most), most
    parts = parts.mapInArrow(run, PARTIALS)
    n = sum(c.size for c in centers.values())
    if 8 * n * tasks > MOST_BYTES:
        parts = added(parts, min(tasks, sum(len(c) for c in centers.values())))
    found = {b: (np.zeros(c.shape), np.zeros(len(c), np.int64)) for b, c in centers.items()}
    table = parts.toArrow()  # all tasks at once; at most MOST_BYTES, or batches times K rows
    for batch in table.to_batches():
        add_rows(found, batch)
    sent.destroy()
    return found


#: Bytes of sums that the driver adds up; more are added by cluster on the executors first.
MOST_BYTES = 1 << 26


def add_rows(found: dict[int, tuple[np.ndarray, np.ndarray]], batch: pa.RecordBatch) -> None:
    """Adds rows of PARTIALS to the sums of their batches and clusters."""
    if not batch.num_rows:
        return
    owner, cluster, n = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
    rows = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
    for b in np.unique(owner).tolist():
        own = owner == b
        np.add.at(found[b][0], cluster[own], rows[own])
        np.add.at(found[b][1], cluster[own], n[own])


def tallied(batches):
    """PARTIALS summed by batch and cluster within a task, whole arrays at a time. A task holds batches times K rows."""
    total: dict[tuple[int, int], list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        owner, cluster, n = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
        order = np.lexsort((cluster, owner))
        new = np.append(True, (np.diff(owner[order]) != 0) | (np.diff(cluster[order]) != 0))
        first = np.flatnonzero(new)
        sums, counts = np.add.reduceat(rows[order], first), np.add.reduceat(n[order], first)
        for i, j in enumerate(order[first].tolist()):
            own = total.setdefault((int(owner[j]), int(cluster[j])), [0.0, 0])
            own[0], own[1] = own[0] + sums[i], own[1] + int(counts[i])
    if total:
        yield partials([(b, k, *own) for (b, k), own in total.items()])


def added(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """PARTIALS summed by batch and cluster after an exchange on these."""
    keys = ["batch_id", "cluster_id"]
    return (parts.repartition(tasks, *keys) if tasks else parts.repartition(*keys)).mapInArrow(tallied, PARTIALS)


def partials(out: list[tuple[int, int, np.ndarray, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), lists(np.stack([o[2] for o in out])), pa.array([o[3] for o in out], pa.int64())], ["batch_id", "cluster_id", "sum", "cnt"])


def centers_of(sent) -> Centers:
    return sent.value


def means(found: dict[int, tuple[np.ndarray, np.ndarray]], old: Centers, normalize: bool) -> Centers:
    """finalize for collected sums."""
    out = {}
    for b, (total, n) in found.items():
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old[b])
        out[b] = unit(new) if normalize else new
    return out


def unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), EPS)
