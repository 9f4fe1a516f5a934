"""Registered queries over the test tables, one or more per operator, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import vectors as V
from tessella.operators import assign as A, centroids as C, update as U
from tessella.operators.estimator import KMeans
from tessella.operators.lloyd import Run, kmeans
from tessella.sources.points import as_points, blocks, read_points, unbatched, write_labels

from . import sql

#: Parameters of the registered runs, the same in the SQL.
K, T, TOL = sql.K, sql.T, sql.TOL
METRICS = A.METRICS


def embeddings(spark: SparkSession, sf_dir: str, batch: bool = False, scale: bool = True) -> DataFrame:
    """All embeddings as points; scaled by 1 to 3 so that the metrics differ (the vectors have length one)."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if scale:
        df = df.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)))
    return as_points(df, "vec_id", "embedding", "label" if batch else None)


def start(points: DataFrame, k: int = K) -> DataFrame:
    return C.first_k(points, k)


def labels(df: DataFrame, *more: str) -> DataFrame:
    return unbatched(df).select(F.col("point_id").alias("vec_id"), "cluster_id", *more)


def rounded(v, digits: int = 6):
    return F.round(v, digits) + F.lit(0.0)


def exploded(centers: DataFrame, *keys: str) -> DataFrame:
    return centers.select(*keys, "cluster_id", F.posexplode("center").alias("pos", "value")).withColumn("value", rounded("value"))


def scan_points(spark, sf_dir):
    points = read_points(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding")
    return unbatched(points).select(F.col("point_id").alias("vec_id"), F.size("features").alias("dim"))


def batch_lift(spark, sf_dir):
    return embeddings(spark, sf_dir, batch=True).select("batch_id", F.col("point_id").alias("vec_id"), F.size("features").alias("dim"))


def column_points(spark, sf_dir):
    """Points from numeric columns rather than an array."""
    points = read_points(spark, f"{sf_dir}/part.parquet", "p_partkey", ["p_size", "p_retailprice"])
    return points.select(F.col("point_id").alias("p_partkey"), rounded(V.sq_norm(F.col("features")), 3).alias("sq_norm"))


def sq_norm(spark, sf_dir):
    return embeddings(spark, sf_dir).select(F.col("point_id").alias("vec_id"), rounded(V.sq_norm(F.col("features"))).alias("sq_norm"))


def centroid_sq_norm(spark, sf_dir):
    packed = C.packed(start(embeddings(spark, sf_dir)))
    return packed.select(F.explode("cs").alias("c")).select("c.cluster_id", rounded("c.c_sq").alias("sq_norm"))


def l2_normalize(spark, sf_dir):
    v = V.l2_normalize(F.col("features"))
    return embeddings(spark, sf_dir).select(F.col("point_id").alias("vec_id"), rounded(V.sq_norm(v)).alias("norm_after"), rounded(v[0]).alias("first"))


def dot_cross(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    pairs = points.join(F.broadcast(start(points)), "batch_id")
    return pairs.select(F.col("point_id").alias("vec_id"), "cluster_id", rounded(V.dot(F.col("features"), F.col("center"))).alias("d"))


def sq_dist(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    pairs = points.join(F.broadcast(start(points)), "batch_id")
    x, c = F.col("features"), F.col("center")
    return pairs.select(F.col("point_id").alias("vec_id"), "cluster_id", rounded(V.sq_dist(x, V.sq_norm(x), c, V.sq_norm(c))).alias("d"))


def init_first_k(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    ids = points.select("point_id", F.col("features").alias("center"))
    return start(points).join(ids, "center").select("cluster_id", F.col("point_id").alias("vec_id"))


def init_seeded(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    drawn = C.seeded(points, len(sql.UNIFORMS), uniforms={0: sql.UNIFORMS})
    ids = points.select("point_id", F.col("features").alias("center"))
    return drawn.join(ids, "center").select("cluster_id", F.col("point_id").alias("vec_id"))


def _assign(metric: str, engine: str = "arrow", distance: bool = False):
    def query(spark, sf_dir):
        points = embeddings(spark, sf_dir)
        centers = start(points)
        if metric == "cosine":
            points = points.withColumn("features", V.l2_normalize(F.col("features")))
            centers = centers.withColumn("center", V.l2_normalize(F.col("center")))
        out = A.assign(points, centers, metric, engine, with_distance=True)
        return labels(out.withColumn("d", rounded("distance")), "d") if distance else labels(out)

    return query


def assign_blocked(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    return labels(A.assign(blocks(points, 7), start(points)))


def assign_tie_duplicate_centroids(spark, sf_dir):
    """Every centroid twice: the lower id wins."""
    points = embeddings(spark, sf_dir)
    own = start(points)
    return labels(A.assign(points, own.unionByName(own.withColumn("cluster_id", F.col("cluster_id") + K))))


def assign_batched(spark, sf_dir):
    points = embeddings(spark, sf_dir, batch=True)
    return A.assign(points, start(points, 3), engine="sql").select("batch_id", F.col("point_id").alias("vec_id"), "cluster_id")


def _labelled(points: DataFrame) -> DataFrame:
    """Fixed labels that leave cluster K - 1 empty."""
    return points.select("batch_id", "point_id", (F.col("point_id") % (K - 1)).cast("int").alias("cluster_id"))


def partial_sums_counts(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    sums = U.partial_sums(points.join(_labelled(points), ["batch_id", "point_id"]))
    return sums.select("cluster_id", "cnt", F.posexplode("sum").alias("pos", "value")).withColumn("value", rounded("value"))


def merge_partials(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    own = points.join(_labelled(points), ["batch_id", "point_id"])
    sums = U.merge_sums(*[U.partial_sums(own.where(F.col("point_id") % 3 == i)) for i in range(3)])
    return sums.select("cluster_id", "cnt", F.posexplode("sum").alias("pos", "value")).withColumn("value", rounded("value"))


def _update(normalize: bool):
    def query(spark, sf_dir):
        points = embeddings(spark, sf_dir)
        return exploded(U.update(points, _labelled(points), start(points), normalize))

    return query


def update_empty_cluster(spark, sf_dir):
    return update_euclid(spark, sf_dir).where(F.col("cluster_id") == K - 1)


update_euclid, update_cosine = _update(False), _update(True)


def update_id_clamp(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    wide = points.select("batch_id", "point_id", (F.col("point_id") % (2 * K)).cast("int").alias("cluster_id"))
    return U.clamped(wide, K).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cnt"))


def center_shift(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    old = start(points)
    return U.shifts(old, U.update(points, _labelled(points), old)).select("cluster_id", rounded("shift").alias("shift"))


def max_shift(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    old = start(points)
    return U.max_shift(old, U.update(points, _labelled(points), old)).select(rounded("shift").alias("shift"))


def _run(spark, sf_dir, metric: str = "euclidean", batch: bool = False, k: int = K, **more) -> Run:
    points = embeddings(spark, sf_dir, batch=batch)
    return kmeans(points, k, metric, **({"max_iters": T} | more), init=start(points, k))


def _kmeans(metric: str, what: str, **more):
    def query(spark, sf_dir):
        run = _run(spark, sf_dir, metric, **more)
        return labels(run.labels) if what == "labels" else exploded(run.centers)

    return query


def _batched(metric: str):
    def query(spark, sf_dir):
        return _run(spark, sf_dir, metric, batch=True, k=3).labels.select("batch_id", F.col("point_id").alias("vec_id"), "cluster_id")

    return query


def kmeans_trace(spark, sf_dir):
    run = _run(spark, sf_dir)
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(run.history)], "iteration int, shift double").withColumn("shift", rounded("shift"))


def _trained(spark, sf_dir) -> tuple[KMeans, DataFrame]:
    points = embeddings(spark, sf_dir)
    return KMeans(64, K, niter=T, tol=0.0).fit(points, start(points)), points


def fit_predict(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    return labels(KMeans(64, K, niter=T, tol=0.0).fit_predict(points, start(points)))


def predict(spark, sf_dir):
    model, points = _trained(spark, sf_dir)
    return labels(model.predict(points))


def cluster_sizes(spark, sf_dir):
    return _run(spark, sf_dir).labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def float_points(spark, sf_dir):
    """Single precision asked for: components are rounded to it."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    points = as_points(df.withColumn("v", F.array(F.col("p_retailprice") / 3, F.col("p_size") / 7)), "p_partkey", "v", compute_type="float")
    return points.select(F.col("point_id").alias("p_partkey"), rounded(F.col("features")[0]).alias("x"), rounded(F.col("features")[1]).alias("y"))


def write_labels_round_trip(spark, sf_dir):
    """Labels written by the sink and read again (to the folder that driver and executors share)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder}/labels-{uuid.uuid4().hex}"
    write_labels(_run(spark, sf_dir).labels, path)
    return labels(spark.read.parquet(path))


def estimator_auto(spark, sf_dir):
    """The estimator that picks its engine itself, over batches."""
    points = embeddings(spark, sf_dir, batch=True)
    out = KMeans(64, 3, niter=T, tol=0.0, engine="auto").fit_predict(points, start(points, 3))
    return out.select("batch_id", F.col("point_id").alias("vec_id"), "cluster_id")


def kmeans_seeded_labels(spark, sf_dir):
    """A whole run from a drawn start (fixed uniforms)."""
    points = embeddings(spark, sf_dir)
    return labels(kmeans(points, len(sql.UNIFORMS), max_iters=T, init=C.seeded(points, len(sql.UNIFORMS), uniforms={0: sql.UNIFORMS})).labels)


def kmeans_seeded_events(spark, sf_dir):
    """The same over the values of all events by their type, of which there are many more."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    points = as_points(df.withColumn("b", F.ascii("event_type")), "event_id", ["value"], "b")
    batches = [r.batch_id for r in points.select("batch_id").distinct().collect()]
    drawn = C.seeded(points, len(sql.UNIFORMS), uniforms={b: sql.UNIFORMS for b in batches})
    return drawn.select("batch_id", "cluster_id", rounded(F.col("center")[0]).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (scan_points, batch_lift, column_points, sq_norm, centroid_sq_norm, l2_normalize, dot_cross, sq_dist, init_first_k, init_seeded, assign_blocked, assign_tie_duplicate_centroids, assign_batched, partial_sums_counts, merge_partials, update_empty_cluster, update_id_clamp, center_shift, max_shift, kmeans_trace, fit_predict, predict, cluster_sizes, float_points, write_labels_round_trip, estimator_auto, kmeans_seeded_labels, kmeans_seeded_events)
    found = {f.__name__: f for f in plain} | {"update_euclid": update_euclid, "update_cosine": update_cosine}
    found |= {f"assign_{m}": _assign(m) for m in METRICS}
    found |= {f"assign_{m}_with_dist": _assign(m, "sql", True) for m in METRICS} | {"assign_join": _assign("euclidean", "join", True)}
    found |= {f"kmeans_{m}_{w}": _kmeans(m, w) for m in METRICS for w in ("labels", "centroids")}
    found |= {"kmeans_sql_labels": _kmeans("euclidean", "labels", engine="sql"), "kmeans_batched_euclidean": _batched("euclidean"), "kmeans_batched_cosine": _batched("cosine"), "kmeans_batched_dot": _batched("dot")}
    found |= {f"kmeans_large_{w}": _kmeans("euclidean", w, tol=TOL, return_updated=True) for w in ("labels", "centroids")}
    found |= {f"kmeans_converged_{w}": _kmeans("euclidean", w, tol=TOL) for w in ("labels", "centroids")}
    return found


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
