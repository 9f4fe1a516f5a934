"""Approximate nearest neighbours by a forest of random-projection trees.

Equal vectors are one entry with its smallest ids (as many as an answer can need), so a vector that very many rows share is one point.
Trees are grown on a sample of at most SAMPLE entries drawn by hash (the documented bound; beyond it leaves grow with the data): each
node splits its points at the median of a projection, the difference of two of its points' directions, until LEAF points are left. Every
entry, sampled or not, is filed in its leaf of every tree.

A query walks all trees at once with one priority queue, ordered by the margin by which a branch was passed over, and opens the leaves
that come up first. How many is measured: on the sample, some points' exact neighbours are looked up, and a query opens leaves until
they hold as many points as were needed to have TARGET of these neighbours. So the share of the index that a query reads is small where
vectors have structure and falls as the data grow, and is large where there is none to use. Queries go in blocks of bounded size to all parts
of the index, where an inverted list of each leaf gives a query's candidates, and are ranked exactly by cosine in double precision.
Nothing of the index moves, each task answers with its best few, and the best of these are the answer.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import new_path, stored

SAMPLE, TREES, LEAF = 100_000, 16, 64
#: Share of the nearest that the opened leaves are to hold, measured on so many of the sampled points; the least number of leaves.
TARGET, CALIBRATED, LEAST_LEAVES = 0.95, 128, 24
#: Queries that are sent to all tasks at once.
BLOCK = 2048

FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: children (below 0: leaf ~x), hyperplanes and thresholds; sizes of leaves in the sample."""

    roots: list[int]
    children: np.ndarray
    planes: np.ndarray
    cuts: np.ndarray
    sizes: np.ndarray
    tree_of: np.ndarray

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaves of all rows, a column per tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(at >= 0)
                if not len(inner):
                    break
                node = at[inner]
                side = (np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.cuts[node]).astype(int)
                at[inner] = self.children[node, side]
            out[:, t] = ~at
        return out

    def walk(self, q: np.ndarray):
        """Leaves in the order of the shared queue."""
        queue = [(0.0, root) for root in self.roots]
        while queue:
            missed, node = heapq.heappop(queue)
            while node >= 0:
                margin = float(self.planes[node] @ q - self.cuts[node])
                near, far = (self.children[node, 1], self.children[node, 0]) if margin > 0 else (self.children[node, 0], self.children[node, 1])
                heapq.heappush(queue, (max(missed, abs(margin)), int(far)))
                node = int(near)
            yield ~node

    def open(self, q: np.ndarray, points: float, least: int) -> list[int]:
        """The first leaves, until they hold so many points."""
        found, total = [], 0
        for leaf in self.walk(q):
            found.append(leaf)
            total += self.sizes[leaf]
            if total >= points and len(found) >= least:
                break
        return found


def calibrated(forest: Forest, x: np.ndarray, k: int, target: float = TARGET, queries: int = CALIBRATED) -> float:
    """How many points the leaves that a query opens must hold so that this share of the k nearest of x is in them: the quantile, over
    some rows of x as queries, of the points that were opened when each of a row's nearest came up. x are the forest's own points."""
    if len(x) < 2:
        return float(len(x))
    filed = forest.file(x)
    needed = []
    for i in range(min(queries, len(x))):
        near = x @ x[i]
        near[i] = -np.inf
        left = {int(j): set(filed[j].tolist()) for j in np.argpartition(-near, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]}
        total = 0
        for leaf in forest.walk(x[i]):
            total += int(forest.sizes[leaf])
            for j in [j for j, leaves in left.items() if leaf in leaves]:
                needed.append(total)
                del left[j]
            if not left:
                break
    return float(np.quantile(needed, target, method="higher"))


def grow(x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    children, planes, cuts, sizes, tree_of, roots = [], [], [], [], [], []
    for t in range(trees):
        todo = [(np.arange(len(x)), None)]
        while todo:
            rows, parent = todo.pop()
            split = None
            if len(rows) > leaf:
                for _ in range(5):
                    a, b = rng.choice(rows, 2, replace=False)
                    plane = x[a] - x[b]
                    length = np.linalg.norm(plane)
                    if length:
                        plane = plane / length
                        value = x[rows] @ plane
                        cut = float(np.median(value))
                        right = value > cut
                        if 0 < right.sum() < len(rows):
                            split = plane, cut, right
                            break
            if split:
                me = len(children)
                children.append([0, 0])
                planes.append(split[0])
                cuts.append(split[1])
                todo += [(rows[~split[2]], (me, 0)), (rows[split[2]], (me, 1))]
            else:
                me = ~len(sizes)
                sizes.append(len(rows))
                tree_of.append(t)
            if parent is None:
                roots.append(me)
            else:
                children[parent[0]][parent[1]] = me
    d = x.shape[1]
    return Forest(roots, np.array(children, np.int64).reshape(-1, 2), np.array(planes).reshape(-1, d), np.array(cuts), np.array(sizes), np.array(tree_of))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows that take part."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))


def nearest(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row whose id is divisible by `every`, the k nearest other rows found, by cosine,
    ties to the smaller id; fewer if there are fewer candidates found.

    Rows whose id or vector is null, or whose vector is zero or holds null or non-finite components, take no part; vectors of different
    lengths are an error. Rows that repeat an id are candidates of their own, but not for a query of that id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    context = spark.sparkContext
    rows = usable(vectors, id_col, vector_col)
    # An entry needs the k + 1 smallest ids of a vector: a query may have to skip its own.
    entries = stored(smallest(rows, k + 1), "entries")
    drawn = entries.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(SAMPLE).select("v").toArrow()  # at most SAMPLE
    if not drawn.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = unit(matrix(drawn.column("v").combine_chunks()))
    forest = grow(sample)
    points = calibrated(forest, sample, k)
    sent = context.broadcast(forest)  # bounded by SAMPLE

    def file(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = sent.value.file(unit(matrix(batch.column(1)))).astype(np.int32)
                leaves = pa.FixedSizeListArray.from_arrays(pa.array(leaf.ravel()), leaf.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), leaves], ["ids", "v", "leaves"])

    def open_leaves(batches):
        for batch in batches:
            if batch.num_rows:
                opened = [sent.value.open(q, points, LEAST_LEAVES) for q in unit(matrix(batch.column(1)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(opened, pa.list_(pa.int32()))], ["id", "v", "leaves"])

    index = stored(entries.select("ids", "v").mapInArrow(file, "ids array<long>, v array<double>, leaves array<int>"), "index")
    queries = stored(rows.where(F.col("id") % every == 0).select("id", "v").mapInArrow(open_leaves, "id long, v array<double>, leaves array<int>"), "queries")
    n_blocks = -(-queries.count() // BLOCK)
    path = new_path(spark, "found")
    for i in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == i).toArrow()  # about BLOCK queries
        asked = context.broadcast((part.column("id").to_pylist(), matrix(part.column("v").combine_chunks()), [np.array(x, np.int32) for x in part.column("leaves").to_pylist()]))
        index.mapInArrow(lambda batches, asked=asked: search(batches, asked.value, k), FOUND).write.mode("append").parquet(path)
        asked.unpersist()
    if not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = spark.read.schema(FOUND).parquet(path)
    # Entries of one leaf and task are already the best; the best of all tasks are the answer.
    per = found.groupBy("query_id").agg(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("all"))
    top = per.select("query_id", F.posexplode(F.slice(F.sort_array("all"), 1, k)).alias("p", "x"))
    return top.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def search(batches, block, k: int):
    """Every query's best k + 1 entries of a task, with their ids, among the entries in leaves that the query opened."""
    q_ids, queries, opened = block
    best: list[list[tuple[float, int, list[int]]]] = [[] for _ in q_ids]  # (-score, first id, ids)
    for batch in batches:
        if not batch.num_rows or not q_ids:
            continue
        ids, e = batch.column(0).to_pylist(), matrix(batch.column(1))
        first = np.array([x[0] for x in ids])
        near = unit(e)
        leaf = batch.column(2).flatten().to_numpy()
        order = np.argsort(leaf, kind="stable")
        rows, leaf = order // (len(leaf) // len(ids)), leaf[order]
        for i, (q, open_) in enumerate(zip(queries, opened, strict=True)):
            low, high = np.searchsorted(leaf, open_), np.searchsorted(leaf, open_, "right")
            has = np.zeros(len(ids), bool)
            has[rows[spans(low, high)]] = True
            some = np.flatnonzero(has)
            if len(some) > 4 * k:
                about = near[some] @ (q / np.linalg.norm(q / np.abs(q).max()) / np.abs(q).max())
                least = np.partition(about, len(about) - k - 1)[len(about) - k - 1]
                if len(best[i]) > k:
                    least = max(least, -best[i][k][0])
                some = some[about >= least - 1e-9]  # with ties and what rounding may have moved
            if len(some):
                exact = cosine(q, e[some])
                top = np.lexsort((first[some], -exact))[: k + 1].tolist()
                best[i] = sorted(best[i] + [(-float(exact[j]), int(first[some[j]]), ids[some[j]]) for j in top])[: k + 1]
    out = [(q, x, -s) for q, own in zip(q_ids, best, strict=True) for s, _, found in own for x in found if x != q]
    q_id, vec_id, score = zip(*out, strict=True) if out else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(q_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from low[i] to high[i] - 1, for every i."""
    n = high - low
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that very large and very small ones keep theirs."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """In double precision; only vectors whose squares would leave its range are scaled, by a power of two, which changes no digit."""
    q, e = tame(q[None, :])[0], tame(e)
    return (e * q).sum(axis=1) / (np.sqrt((e * e).sum(axis=1)) * np.sqrt((q * q).sum()))


def tame(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1)
    wild = (most > 1e140) | (most < 1e-140)
    if not wild.any():
        return x
    return np.where(wild[:, None], np.ldexp(x, -np.frexp(most)[1][:, None]), x)


def smallest(rows: DataFrame, m: int) -> DataFrame:
    """(v, ids): distinct vectors with their m smallest ids. Ids are first reduced within salts, so no task gets all rows of a vector."""
    least = lambda ids: F.slice(F.sort_array(ids), 1, m)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("v", "salt").agg(least(F.collect_list("id")).alias("ids"))
    return salted.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).select("ids", "v")
