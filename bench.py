"""Times of the headline queries. Prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8). Each query runs once to warm up and then
BENCH_RUNS (3) times; the median counts. The k-means runs are over all embeddings; `ml_kmeans` is Spark ML's own k-means with the same K
and number of iterations, for comparison, and isn't in the total, nor is the comparison of both on replicated points over 32 partitions.
`bench.py --scaling` prints JSON lines instead: ten iterations over 1000 copies of each embedding on one, two, four and all cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH")) if x)

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR, CPUS, RUNS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))


def timed(f, runs: int = RUNS) -> float:
    return round(statistics.median(measured(f, runs)[1]), 4)


def measured(f, runs: int = RUNS) -> tuple[float, list[float]]:
    """Seconds of the warm-up run and of the others."""
    took = []
    for _ in range(runs + 1):
        t = time.perf_counter()
        f()
        took.append(round(time.perf_counter() - t, 4))
    return took[0], took[1:]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def done(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def replicated(spark: SparkSession, copies: int, partitions: int):
    """Every embedding `copies` times, each copy moved a little, over many partitions."""
    from pyspark.sql import functions as F

    from tessella.sources.points import as_points

    base = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = base.repartition(partitions).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    moved = F.transform("embedding", lambda x: x.cast("double") + F.sin(F.col("copy").cast("double")) / 50)
    return as_points(rows.withColumn("embedding", moved).withColumn("id", F.col("vec_id") * copies + F.col("copy")), "id", "embedding")


def ml(points, k: int, iters: int):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = points.select(array_to_vector("features").alias("features")).cache()
    vectors.count()
    return vectors, lambda: KMeans(k=k, maxIter=iters, tol=0.0, initMode="random", seed=1).fit(vectors)


def scaling() -> None:
    """JSON lines: warm-up and timed runs of ten iterations over replicated points, on one, two, four and all cores."""
    from tessella.operators.centroids import first_k
    from tessella.operators.lloyd import kmeans

    for cpus in ("1", "2", "4", CPUS):
        spark = session(cpus)
        points = replicated(spark, int(os.environ.get("BENCH_COPIES", "1000")), 32).cache()
        n = points.count()
        start = first_k(points, 16).cache()
        row = {"cpus": int(cpus), "n": n, "d": 64, "k": 16, "iters": 10, "partitions": points.rdd.getNumPartitions()}
        warm, took = measured(lambda points=points, start=start: kmeans(points, 16, "euclidean", 10, -1.0, start), 1)
        print(json.dumps(row | {"engine": "arrow", "warm_up_s": warm, "run_s": took, "s_per_iter": round(min(took) / 10, 4)}), flush=True)
        vectors, fit = ml(points, 16, 10)
        points.unpersist()
        warm, took = measured(fit, 1)
        print(json.dumps(row | {"engine": "spark-ml", "warm_up_s": warm, "run_s": took, "s_per_iter": round(min(took) / 10, 4)}), flush=True)
        vectors.unpersist()
        spark.stop()


def main() -> None:
    spark = session(CPUS)
    from tessella.operators.centroids import first_k
    from tessella.operators.lloyd import kmeans
    from tessella.plans.catalog import embeddings, queries

    found, compared = {}, {}
    for name in ("assign_euclidean", "assign_cosine", "update_euclid", "cluster_sizes", "predict"):
        found[name] = timed(lambda name=name: done(queries()[name](spark, SF_DIR)))
    points = embeddings(spark, SF_DIR).cache()
    points.count()
    for metric in ("euclidean", "cosine", "dot"):
        for k in (8, 16, 64):
            start = first_k(points, k).cache()
            found[f"kmeans_{metric}_k{k}_t10"] = timed(lambda metric=metric, k=k, start=start: done(kmeans(points, k, metric, 10, -1.0, start).labels))
    for k in (8, 16, 64):
        compared[f"ml_kmeans_k{k}_t10"] = timed(ml(points, k, 10)[1])
    many = replicated(spark, 250, 32).cache()
    n = many.count()
    start = first_k(many, 16).cache()
    compared[f"kmeans_euclidean_k16_t10_n{n}"] = timed(lambda: kmeans(many, 16, "euclidean", 10, -1.0, start), 1)
    compared[f"ml_kmeans_k16_t10_n{n}"] = timed(ml(many, 16, 10)[1], 1)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "comparison": compared, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    scaling() if "--scaling" in sys.argv[1:] else main()
