"""K-means against a NumPy version, hand-made cases, and the semantics that are easy to get wrong."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from tessella.operators import assign as A, centroids as C, update as U
from tessella.operators.estimator import KMeans
from tessella.operators.lloyd import kmeans
from tessella.sources.points import as_points, blocks
from tessella.streaming.assign import assign_stream

POINTS = "batch_id long, point_id long, features array<double>"


def points(spark, x, batch=None):
    batch = [0] * len(x) if batch is None else batch
    return spark.createDataFrame([(int(b), i, [float(v) for v in row]) for i, (b, row) in enumerate(zip(batch, x, strict=True))], POINTS)


def centers(spark, c, batches=(0,)):
    return C.to_frame(spark, {b: np.array(c, float) for b in batches})


def got(labels):
    return [r.cluster_id for r in labels.orderBy("batch_id", "point_id").collect()]


def oracle(x, c, metric, iters, tol=-1.0, updated=False):
    """(labels, centroids, iterations) by loops over clusters."""
    x, c = np.array(x, float), np.array(c, float)
    norm = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    if metric == "cosine":
        x, c = norm(x), norm(c)
    for n in range(1, iters + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2) if metric == "euclidean" else -(x @ c.T)
        labels = d.argmin(1)
        new = np.array([x[labels == k].mean(0) if (labels == k).any() else c[k] for k in range(len(c))])
        new = new if metric == "euclidean" else norm(new)
        move = np.linalg.norm(new - c, axis=1).max()
        if move < tol:
            return labels, new if updated else c, n
        c = new
    return labels, c, n


@pytest.mark.parametrize("metric", A.METRICS)
@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_run_matches_numpy(spark, metric, engine):
    x = np.random.default_rng(1).normal(size=(60, 5)) / 3
    run = kmeans(points(spark, x), 4, metric, 3, init=centers(spark, x[:4]), engine=engine)
    labels, c, n = oracle(x, x[:4], metric, 3)
    assert got(run.labels) == labels.tolist() and run.n_iter == n == len(run.history)
    assert np.allclose(C.from_frame(run.centers)[0], c, atol=1e-12)


@pytest.mark.parametrize("engine", ["arrow", "sql", "join"])
@pytest.mark.parametrize("metric", A.METRICS)
def test_engines_agree_on_one_assignment(spark, engine, metric):
    x = np.random.default_rng(2).normal(size=(40, 17))
    c = np.random.default_rng(3).normal(size=(9, 17))
    out = A.assign(points(spark, x), centers(spark, c), metric, engine, with_distance=True).orderBy("point_id").collect()
    d = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T, 0) if metric == "euclidean" else -(x @ c.T)
    assert [r.cluster_id for r in out] == d.argmin(1).tolist()
    assert np.allclose([r.distance for r in out], d.min(1))


def test_many_centroids_are_tiled(spark):
    x = np.random.default_rng(4).normal(size=(30, 3))
    c = np.random.default_rng(5).normal(size=(2 * A.TILE + 31, 3))
    assert got(A.assign(points(spark, x), centers(spark, c))) == ((x[:, None] - c) ** 2).sum(2).argmin(1).tolist()


@pytest.mark.parametrize("engine", ["arrow", "sql", "join"])
def test_ties_go_to_the_lowest_id(spark, engine):
    assert got(A.assign(points(spark, [[0, 0]]), centers(spark, [[1, 0], [-1, 0]]), engine=engine)) == [0]
    assert got(A.assign(points(spark, [[2, 0]]), centers(spark, [[0, 1], [1, 0], [1, 0]]), "dot", engine)) == [1]


def test_empty_cluster_and_duplicates_keep_their_centroid(spark):
    run = kmeans(points(spark, [[0, 0], [1, 0], [9, 9]]), 3, max_iters=1, init=centers(spark, [[0, 0], [0, 0], [50, 50]]))
    c = C.from_frame(run.centers)[0]
    assert got(run.labels) == [0, 0, 0] and c[1].tolist() == [0, 0] and c[2].tolist() == [50, 50]


def test_duplicate_may_win_points_later(spark):
    x = [[0.0], [0.2], [5.0], [6.0]]
    labels, _, _ = oracle(x, [[0.0], [0.0]], "euclidean", 2)
    assert 1 in labels and got(kmeans(points(spark, x), 2, max_iters=2, init=centers(spark, [[0], [0]])).labels) == labels.tolist()


def test_cosine_zero_vector_and_negative_scores(spark):
    assert got(kmeans(points(spark, [[0, 0], [1, 0], [0, 1]]), 2, "cosine", 1, init=centers(spark, [[5, 0], [0, 5]])).labels) == [0, 0, 1]
    assert got(A.assign(points(spark, [[-1, -0.1]]), centers(spark, [[1, 0], [0, 1]]), "cosine")) == [1]


def test_dot_gives_unit_centroids_after_a_step(spark):
    run = kmeans(points(spark, [[3, 0], [0, 3], [2, 2]]), 2, "dot", 1, init=centers(spark, [[3, 0], [0, 3]]))
    assert np.allclose(np.linalg.norm(C.from_frame(run.centers)[0], axis=1), 1)


def test_stopping(spark):
    x = np.random.default_rng(6).normal(size=(50, 2))
    p, start = points(spark, x), centers(spark, x[:3])
    for updated in (False, True):
        run = kmeans(p, 3, max_iters=30, tol=0.2, init=start, return_updated=updated)
        labels, c, n = oracle(x, x[:3], "euclidean", 30, 0.2, updated)
        assert run.n_iter == n < 30 and got(run.labels) == labels.tolist()
        assert np.allclose(C.from_frame(run.centers)[0], c)
    assert kmeans(points(spark, [[0.0], [1.0]]), 1, max_iters=4, tol=0.0, init=centers(spark, [[0.5]])).n_iter == 4  # strictly less


def test_labels_lag_unless_converged(spark):
    x = np.random.default_rng(7).normal(size=(80, 2))
    model = KMeans(2, 5, niter=1, tol=0.0)
    train = got(model.fit_predict(points(spark, x), centers(spark, x[:5])))
    assert train == oracle(x, x[:5], "euclidean", 1)[0].tolist()
    assert got(model.predict(points(spark, x))) == oracle(x, C.from_frame(model.centers)[0], "euclidean", 1)[0].tolist() != train


@pytest.mark.parametrize("metric", A.METRICS)
def test_batches_stop_together(spark, metric):
    x = np.random.default_rng(8).normal(size=(40, 3))
    batch = [i % 2 for i in range(40)]
    start = {b: x[[i for i in range(40) if i % 2 == b][:3]] for b in (0, 1)}
    run = kmeans(points(spark, x, batch), 3, metric, 4, init=C.to_frame(spark, start))
    by = {b: oracle(x[b::2], start[b], metric, 4) for b in (0, 1)}
    rows = run.labels.orderBy("point_id").collect()
    assert [r.cluster_id for r in rows] == [int(by[i % 2][0][i // 2]) for i in range(40)]
    still = np.repeat([[1.0, 1.0, 1.0]], 4, axis=0)
    mixed = points(spark, np.concatenate([still, x[:20]]), [0] * 4 + [1] * 20)
    both = kmeans(mixed, 2, metric, 6, tol=1e-9, init=C.to_frame(spark, {0: still[:2], 1: x[:2]}))
    assert both.n_iter > 1  # batch 0 stands still from the start


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_partitions_do_not_matter(spark, parts):
    x = np.random.default_rng(9).normal(size=(90, 4)) / 3
    run = kmeans(blocks(points(spark, x), parts), 5, max_iters=4, init=centers(spark, x[:5]))
    labels, c, _ = oracle(x, x[:5], "euclidean", 4)
    assert got(run.labels) == labels.tolist() and np.allclose(C.from_frame(run.centers)[0], c, atol=1e-12)


def test_seeded_start(spark):
    p = points(spark, [[float(i)] for i in range(10)])
    a, b = (C.from_frame(C.seeded(q, 20, seed=3))[0].ravel().tolist() for q in (p.repartition(1), p.repartition(3)))
    assert a == b and len(a) == 20 and len(set(a)) < 20
    assert a != C.from_frame(C.seeded(p, 20, seed=4))[0].ravel().tolist()
    assert C.from_frame(C.seeded(points(spark, [[1.0], [2.0]]), 3, seed=0))[0].shape == (3, 1)
    assert kmeans(p, 3, max_iters=2, seed=1).n_iter == 2


@pytest.mark.parametrize("n", [20_000, 200_000])
@pytest.mark.parametrize("mixed", [False, True])
def test_seeded_start_of_many_points(spark, n, mixed):
    """Any partitioning and width of rows; AQE and partitions as Spark has them by itself."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.unset("spark.sql.shuffle.partitions")
    try:
        width = F.when(F.col("id") % 97 == 0, 400).otherwise(4) if mixed else F.lit(64)
        p = spark.range(n, numPartitions=5).select(F.lit(3).cast("long").alias("batch_id"), (F.col("id") * F.col("id") - 7).alias("point_id"), F.transform(F.sequence(F.lit(1), width), lambda i: F.col("id") + 0.5 * i).alias("features"))
        drawn = {r.cluster_id: r.center[0] - 0.5 for r in C.seeded(p.repartition(7), 16, seed=5).collect()}
        assert drawn == {i: float(int(u * n)) for i, u in enumerate(C.draws(16, [3], 5)[3])}
        if not mixed:
            assert kmeans(p, 16, max_iters=1, seed=5).n_iter == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_starts_of_batches_and_odd_ids(spark):
    ids = {0: [-(2**63), -5, 0, 2**63 - 1], 1: [7], -9: list(range(300))}
    p = spark.createDataFrame([(b, i, [float(k)]) for b, own in ids.items() for k, i in enumerate(own)], POINTS).repartition(3)
    first = sorted((r.batch_id, r.cluster_id, r.center[0]) for r in C.first_k(p, 3).collect())
    assert first == sorted((b, k, float(k)) for b, own in ids.items() for k in range(min(3, len(own))))
    twice = p.unionByName(p.withColumn("features", F.array(F.lit(-1.0))))
    assert {r.center[0] for r in C.first_k(twice, 2).collect()} == {-1.0}
    assert C.first_k(p.limit(0), 2).count() == 0
    run = kmeans(p, 2, max_iters=2, seed=3)
    assert {b: c.shape for b, c in C.from_frame(run.centers).items()} == {b: (2, 1) for b in ids}


def test_many_tasks_sum_by_cluster_first(spark, monkeypatch):
    monkeypatch.setattr(U, "MOST_BYTES", 8)
    x = np.random.default_rng(12).normal(size=(300, 3))
    p = points(spark, x).repartition(40)
    run = kmeans(p, 5, max_iters=3, init=centers(spark, x[:5]))
    assert np.allclose(C.from_frame(run.centers)[0], oracle(x, x[:5], "euclidean", 3)[1]) and not p.storageLevel.useMemory


def test_too_many_centroids_are_refused(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_BYTES", 100)
    with pytest.raises(Exception, match="too many"):
        C.from_frame(centers(spark, np.zeros((20, 3))))


def test_public_names():
    import tessella

    assert all(getattr(tessella, x) for x in tessella.__all__) and {"KMeans", "kmeans"} <= set(tessella.__all__)


def test_parts_merge_and_clamp(spark):
    x = np.random.default_rng(10).normal(size=(30, 3))
    p = points(spark, x)
    labels = p.selectExpr("batch_id", "point_id", "cast(point_id % 6 as int) as cluster_id")
    old = centers(spark, x[:4])
    new = C.from_frame(U.update(p, labels, old, clamp=4))[0]
    ids = np.array([i % 6 if i % 6 < 4 else 0 for i in range(30)])
    assert np.allclose(new, [x[ids == k].mean(0) for k in range(4)])
    with pytest.raises(Exception, match="no centroid"):
        U.update(p, labels, old).collect()
    own = p.join(labels, ["batch_id", "point_id"])
    whole = {r.cluster_id: r for r in U.partial_sums(own).collect()}
    merged = {r.cluster_id: r for r in U.merge_sums(U.partial_sums(own.where("point_id < 11")), U.partial_sums(own.where("point_id >= 11"))).collect()}
    assert all(np.allclose(whole[k]["sum"], merged[k]["sum"]) and whole[k].cnt == merged[k].cnt for k in whole)


def test_inputs_are_checked(spark):
    p = points(spark, [[1.0, 2.0]])
    for bad in ({"max_iters": 0}, {"metric": "manhattan"}, {"engine": "c"}, {"k": 0}):
        with pytest.raises(ValueError):
            kmeans(p, **({"k": 1} | bad))
    with pytest.raises(RuntimeError):
        KMeans(2, 1).predict(p)
    with pytest.raises(ValueError):
        KMeans(2, 1, niter=1).fit(p).predict(points(spark, [[1.0, 2.0]], [5]))
    with pytest.raises(ValueError):
        KMeans(3, 1, niter=1).fit(p)
    with pytest.raises(ValueError):
        kmeans(p.where("point_id < 0"), 1)
    table = spark.createDataFrame([(1, [1.0, None]), (2, [1.0, float("nan")])], "id long, v array<double>")
    for i in (1, 2):
        with pytest.raises(Exception, match="null or non-finite"):
            as_points(table.where(f"id = {i}"), "id", "v").collect()
    with pytest.raises(ValueError):
        as_points(spark.createDataFrame([(1, "a")], "id long, v string"), "id", "v")
    with pytest.raises(Exception, match="length"):
        A.assign(spark.createDataFrame([(0, 0, [1.0]), (0, 1, [1.0, 2.0])], POINTS).coalesce(1), centers(spark, [[1.0]])).collect()


def test_stream(spark, tmp_path):
    x = np.random.default_rng(11).normal(size=(20, 2))
    points(spark, x).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POINTS).parquet(str(tmp_path / "in"))
    out = assign_stream(stream, centers(spark, x[:3]))
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(60)
    assert got(spark.read.parquet(str(tmp_path / "out"))) == oracle(x, x[:3], "euclidean", 1)[0].tolist()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=2, max_size=12), st.integers(1, 4))
def test_any_points(spark, rows, k):
    x = np.array(rows, float)
    start = x[np.arange(k) % len(x)]
    run = kmeans(points(spark, x), k, max_iters=2, init=centers(spark, start))
    labels, c, _ = oracle(x, start, "euclidean", 2)
    assert got(run.labels) == labels.tolist() and np.allclose(C.from_frame(run.centers)[0], c)
