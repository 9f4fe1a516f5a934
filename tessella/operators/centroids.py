"""Centroid sets: their DataFrame form, their broadcast form, and where a run starts from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessella.functions.vectors import sq_norm

SCHEMA = "batch_id long, cluster_id int, center array<double>"
#: Bytes that a broadcast centroid set may have; beyond it a run is refused rather than left to fail on the executors.
MOST_BYTES = 1 << 30
#: Ranges of ids that are counted first; each is cut in 2 ** STEP if a wanted rank lies in it.
RANGES, STEP = 4096, 6

Centers = dict[int, np.ndarray]


def to_frame(spark: SparkSession, centers: Centers) -> DataFrame:
    if not centers:
        return spark.createDataFrame([], SCHEMA)
    batch = np.concatenate([np.full(len(c), b, np.int64) for b, c in sorted(centers.items())])
    cluster = np.concatenate([np.arange(len(c), dtype=np.int32) for _, c in sorted(centers.items())])
    rows = np.concatenate([np.asarray(c, float) for _, c in sorted(centers.items())])
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(batch), pa.array(cluster), lists(rows)], ["batch_id", "cluster_id", "center"]), SCHEMA)


def lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as a column of lists."""
    ends = np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rows.ravel())) if ends[-1] < 1 << 31 else pa.array(list(rows), pa.list_(pa.float64()))


def from_frame(df: DataFrame) -> Centers:
    """Collects centroids (their number is batches times clusters) as Arrow, in one job; ids must be 0 to K - 1 in every batch.

    Above MOST_BYTES the query itself raises before its rows reach the driver."""
    rows = df.select(F.col("batch_id").cast("long").alias("b"), F.col("cluster_id").cast("int").alias("k"), F.col("center").cast("array<double>").alias("c"))
    size = F.sum(F.size("c").cast("long")).over(Window.partitionBy())  # a set that is checked to be small
    told = F.raise_error(F.concat(F.lit("too many centroid components to broadcast: "), F.col("size").cast("string"))).cast("array<double>")
    table = rows.withColumn("size", size).select("b", "k", F.when(F.col("size") * 8 > MOST_BYTES, told).otherwise(F.col("c")).alias("c")).toArrow()
    if not table.num_rows:
        return {}
    owner, cluster = table.column("b").to_numpy(), table.column("k").to_numpy()
    column = table.column("c").combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(lengths) - lengths
    out = {}
    for b in np.unique(owner).tolist():
        own = np.flatnonzero(owner == b)
        own = own[np.argsort(cluster[own], kind="stable")]
        if cluster[own].tolist() != list(range(len(own))):
            raise ValueError(f"cluster ids of batch {b} aren't 0 to K - 1")
        if len(set(lengths[own].tolist())) != 1:
            raise ValueError(f"centroids of batch {b} differ in length")
        out[b] = np.stack([flat[first[i] : first[i] + lengths[i]] for i in own]).astype(float)
    if len({c.shape for c in out.values()}) > 1:
        raise ValueError("batches differ in the number or length of centroids")
    return out


def packed(centers: DataFrame) -> DataFrame:
    """One row per batch: cs ARRAY<STRUCT<cluster_id, center, c_sq>>, in the order of cluster ids, with norms computed once."""
    one = F.struct("cluster_id", "center", sq_norm(F.col("center")).alias("c_sq"))
    return centers.groupBy("batch_id").agg(F.sort_array(F.collect_list(one)).alias("cs"))


def first_k(points: DataFrame, k: int) -> DataFrame:
    """The K points of smallest id in each batch."""
    sizes = {r.batch_id: r.n for r in points.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _numbered(at_ranks(points, {b: {i: i for i in range(min(k, n))} for b, n in sizes.items()}))


def draws(k: int, batches: list[int], seed: int) -> dict[int, list[float]]:
    """K uniforms for each batch, independent of how points are partitioned."""
    return {b: np.random.default_rng([seed & 0xFFFFFFFF, b & 0xFFFFFFFF, (b >> 32) & 0xFFFFFFFF]).random(k).tolist() for b in batches}


def seeded(points: DataFrame, k: int, seed: int = 0, uniforms: dict[int, list[float]] | None = None) -> DataFrame:
    """K points of each batch drawn with replacement: the uniform u takes the point of rank floor(u * N) by id. Repeats and K > N are
    allowed, and there are always K rows."""
    sizes = {r.batch_id: r.n for r in points.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    uniforms = uniforms or draws(k, sorted(sizes), seed)
    return _numbered(at_ranks(points, {b: {i: int(u * sizes[b]) for i, u in enumerate(us[:k])} for b, us in uniforms.items() if b in sizes}))


def at_ranks(points: DataFrame, wanted: dict[int, dict[int, int]]) -> DataFrame:
    """(batch_id, cluster_id, features) of the points of these ranks (from 0, by id within the batch): batch to cluster to rank.

    Ids are counted in ranges that get narrower, only where a wanted rank lies, until few ids are left to look at; ranges are of ids, so
    the answer doesn't depend on partitions, and nothing is shuffled but counts. Points that share an id are one (the least features).
    """
    spark = points.sparkSession
    ids = points.select("batch_id", "point_id")
    ends = ids.agg(F.min("point_id"), F.max("point_id")).first()
    shift = 0
    while ends[0] is not None and (ends[1] >> shift) - (ends[0] >> shift) >= RANGES:
        shift += 1
    targets = {(b, rank) for b, own in wanted.items() for rank in own.values()}
    base = {(b, rank): 0 for b, rank in targets}  # of each target the number of ids before its range
    within: dict[tuple[int, int], tuple[int, int]] = {}  # the target's range (shift, range)
    found: dict[tuple[int, int], int] = {}
    left = ids
    last = None
    while targets:
        if last is not None:
            ranges = sorted({(b, within[b, r][1]) for b, r in targets})
            some = F.broadcast(spark.createDataFrame(ranges, "batch_id long, range long"))  # at most batches times K rows
            left = ids.withColumn("range", F.shiftright("point_id", last)).join(some, ["batch_id", "range"], "left_semi").select("batch_id", "point_id")
        counts: dict[tuple[int, int | None], list[tuple[int, int]]] = {}
        for r in left.groupBy("batch_id", F.shiftright("point_id", shift).alias("range")).count().collect():  # ranges, not points
            counts.setdefault((r.batch_id, None if last is None else r.range >> (last - shift)), []).append((r.range, r["count"]))
        steps = {k: (sorted(v), np.cumsum([n for _, n in sorted(v)])) for k, v in counts.items()}
        for t in list(targets):
            b, rank = t
            own, upto = steps[b, within[t][1] if last is not None else None]
            i = int(np.searchsorted(upto, rank - base[t], "right"))
            base[t] += int(upto[i - 1]) if i else 0
            within[t] = (shift, own[i][0])
            if shift == 0:
                found[t] = own[i][0]
                targets.remove(t)
        last, shift = shift, max(0, shift - STEP)
    chosen = [(b, i, found[b, rank]) for b, own in wanted.items() for i, rank in own.items()]
    chosen = F.broadcast(spark.createDataFrame(chosen, "batch_id long, cluster_id int, point_id long"))  # batches times K rows
    return points.join(chosen, ["batch_id", "point_id"]).groupBy("batch_id", "cluster_id").agg(F.min("features").alias("features"))


def _numbered(df: DataFrame) -> DataFrame:
    return df.select("batch_id", F.col("cluster_id").cast("int").alias("cluster_id"), F.col("features").alias("center"))
