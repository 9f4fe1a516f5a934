"""Jaccard join of documents' shingle sets, size-aware, and the groups that its links form.

Exact copies of a set are one class, represented by its smallest id. Sets are split by size at a boundary chosen by cost.

* Light sets (up to the boundary): two sets of s and t shingles link if they share a subset of c(s, t) shingles, the least overlap that
  the threshold asks for. For each t that can match, all subsets of that fixed size are enumerated (by leaving out s - c shingles), and
  sets with an equal subset meet.
* Heavy sets (with the light ones large enough to match one): inverted lists of a set's rarest shingles. Any order of shingles that is
  the same for all sets is right: two sets that link share one of their first s - ceil(threshold * s) + 1. The order is by counts over
  all documents (kept in a table of bounded size by hash), so shingles that very many documents have come last.

Sets that meet in a short list are pairs if their sketches allow it (counts of shingles by hash, whose lesser ones add up to more than the
overlap can be, so no link is lost). A long list is linked along its length (each set to the first it may match in size, else to the one
before), never in all pairs. The connected candidates are then compared exactly: their sets are brought together once, in blocks of bounded size; in a block every
shingle has an inverted list, scanning the lists of a set's shingles counts its overlap with all others, and pairs at the threshold are
links. A large candidate group is cut by size class and hash into parts, and pairs of parts are compared only as far as components are
still to be joined. Of a block only its components are returned, so small groups need no further rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected
from .shared import forget, pieces, small_batches, stored, text_bytes
from .words import Words, distinct, mix, shingles

#: Bounds of the number of counters (powers of two); the shingles' order is by these. Beyond the upper one the order gets coarser, and
#: candidates more, but never fewer.
LEAST_COUNTERS, MOST_COUNTERS = 16, 25
#: Boundaries that are considered; what reading one posting costs against enumerating one subset.
LARGEST_BOUNDARY, SCAN = 32, 4.0
#: Lists up to this length are short; counters of a sketch (sets of k shingles by hash: the sums of lesser counts bound an overlap).
SHORT, SKETCH = 16, 256
#: Classes that are compared at once.
BLOCK = 256
#: Rows of (id, block) up to which they are sent to all tasks.
FEW = 500_000


def least_overlap(s: int, t: int, percent: int) -> int:
    """Smallest i with 100 * i >= percent * (s + t - i)."""
    return -(-percent * (s + t) // (100 + percent))


def partners(s: int, percent: int) -> range:
    """Sizes that a set of s can link with."""
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def n_prefix(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1


def n_subsets(s: int, percent: int) -> int:
    return sum(comb(s, least_overlap(s, t, percent)) for t in partners(s, percent) if t <= LARGEST_BOUNDARY)


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The size up to which sets are light: the one with the least cost over these numbers of sets by size."""

    def cost(x: int) -> float:
        light = sum(n * n_subsets(s, percent) for s, n in sizes.items() if 0 < s <= x)
        return light + SCAN * sum(n * n_prefix(s, percent) for s, n in sizes.items() if s > 0 and partners(s, percent)[-1] > x)

    return min(range(LARGEST_BOUNDARY + 1), key=lambda x: (cost(x), x))


def subset_keys(h: np.ndarray, percent: int, most: int) -> np.ndarray:
    """Keys of the fixed-size subsets of a light set (sizes of both sets and the subset's hash), for partners up to `most`."""
    s, total = len(h), h.sum(dtype=np.uint64)
    m = mix(h)
    total = m.sum(dtype=np.uint64)
    keys = []
    for t in partners(s, percent):
        if t > most:
            break
        left_out = s - least_overlap(s, t, percent)
        gone = np.array([m[list(c)].sum(dtype=np.uint64) for c in combinations(range(s), left_out)], np.uint64) if left_out > 1 else m if left_out else np.zeros(1, np.uint64)
        keys.append(mix((total - gone) ^ np.uint64((min(s, t) << 32) + (max(s, t) << 8) + 1)))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def each_set(batch: pa.RecordBatch, column: int, kind: np.ndarray, k: int, most: int = 2 << 20):
    """The shingle set (sorted hashes) of every text of a batch."""
    data, offsets = text_bytes(batch.column(column))
    for a, b in pieces(offsets, most):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kind)
        h, first = words.hashes, words.first.tolist()
        for i in range(b - a):
            yield distinct(shingles(h[first[i] : first[i + 1]], k))


def n_counters(docs: DataFrame) -> int:
    """One counter for about 32 shingles of what Catalyst reads from the files, within fixed bounds."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << min(max((size // 100).bit_length() - 1, LEAST_COUNTERS), MOST_COUNTERS)


def statistics(docs: DataFrame, kind: np.ndarray, k: int, counters: int) -> tuple[np.ndarray, dict[int, int]]:
    """Codes (0 to 255, rising with the count) of the counters of all shingles of all documents, and numbers of documents by set size up
    to what a boundary needs. A shingle's counter is given by its hash's upper bits."""
    spread, slices = 2 * LARGEST_BOUNDARY, 64
    shift = np.uint64(65 - counters.bit_length())

    def run(batches):
        forget()
        count, sizes, pending, n = np.zeros(counters, np.uint16), np.zeros(spread, np.int64), [], 0
        for batch in batches:
            for h in each_set(batch, 0, kind, k):
                if len(h) < spread:
                    sizes[len(h)] += 1
                pending.append(h)
                n += len(h)
                if n > 1 << 20:
                    tally(count, pending, shift)
                    pending, n = [], 0
        if pending:
            tally(count, pending, shift)
        if count.any() or sizes.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(slices + 1), pa.int64()), pa.array([*(zlib.compress(x, 1) for x in np.split(count, slices)), sizes.tobytes()], pa.binary())], ["slice", "counts"])

    def add(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = key[0].as_py(), 0
        for batch in groups:
            for x in batch.column("counts"):
                total = total + (np.frombuffer(x.as_buffer(), np.int64) if at == slices else np.frombuffer(zlib.decompress(x.as_buffer()), np.uint16).astype(np.int64))
        if at < slices:
            total = np.where(total < 200, total, np.minimum(255, 200 + 2 * np.log2(np.maximum(total, 200) / 200))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])

    parts = docs.select("text").mapInArrow(run, "slice long, counts binary").groupBy("slice").applyInArrow(add, "slice long, counts binary").collect()  # a byte per counter
    parts = {r["slice"]: r["counts"] for r in parts}
    if not parts:
        return np.zeros(counters, np.uint8), {}
    sizes = np.frombuffer(parts[slices], np.int64)
    return np.concatenate([np.frombuffer(parts[i], np.uint8) for i in range(slices)]), {s: int(n) for s, n in enumerate(sizes) if n}


def tally(count: np.ndarray, sets: list[np.ndarray], shift: np.uint64) -> None:
    at, n = np.unique((np.concatenate(sets) >> shift).astype(np.int64), return_counts=True)
    count[at] = np.minimum(count[at] + n, np.iinfo(count.dtype).max)


def jaccard_groups(docs: DataFrame, percent: int, k: int, kind: np.ndarray, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links lead to, its own included), text_hash (xxhash64 of the text).

    Documents link if 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles; one with fewer words has them all as its
    only shingle; null texts and those without words have an empty set and link with nothing, and a null id takes no part. Repeated
    rows are copies; different texts under one id are compared as documents of their own. Other columns aren't looked at.
    """
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    context = docs.sparkSession.sparkContext
    counters = counters or n_counters(docs)
    shift = np.uint64(65 - counters.bit_length())
    counts, sizes = statistics(docs, kind, k, counters)
    light = boundary(sizes, percent)
    rank = context.broadcast(counts)  # a byte per counter

    def sign(batches):
        forget()
        count = rank.value
        for batch in batches:
            n, h1, h2, subsets, prefix, sketch = [], [], [], [], [], []
            for h in each_set(batch, 1, kind, k):
                n.append(len(h))
                h1.append(int(h.sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                h2.append(int(mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                subsets.append(subset_keys(h, percent, light).view(np.int64) if 0 < len(h) <= light else ())
                if len(h) and partners(len(h), percent)[-1] > light:
                    order = np.lexsort((h, count[(h >> shift).astype(np.int64)]))
                    prefix.append(h[order[: n_prefix(len(h), percent)]].view(np.int64))
                else:
                    prefix.append(())
                sketch.append(np.minimum(np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes())
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(subsets, many), pa.array(prefix, many), pa.array(sketch, pa.binary()), batch.column(2)], ["doc_id", "n", "h1", "h2", "subsets", "prefix", "sketch", "text_hash"])

    signed = stored(docs.mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, subsets array<long>, prefix array<long>, sketch binary, text_hash long"), "signed")
    # A class is known by its h1 (`rep`); `first` is the smallest id that has it.
    signature = ["n", "h1", "h2"]
    classes = signed.where("n > 0 and doc_id is not null").groupBy(*signature).agg(F.min("doc_id").alias("first"), F.min_by(F.struct("subsets", "prefix", "sketch"), "doc_id").alias("keys"))
    classes = stored(classes.select("n", F.col("h1").alias("rep"), "h2", "first", "keys.subsets", "keys.prefix", "keys.sketch"), "classes")
    edges = candidates(classes, percent)
    members = connected(edges).select(F.col("node").alias("rep"), F.col("component").alias("pool"))
    found = compare(docs, classes.select("rep", "first", "n").join(members, "rep"), percent, k, kind)
    groups = classes.select("n", "rep", "h2", "first").join(found, "rep", "left")
    least = groups.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    named = groups.join(least, "component", "left").select("n", F.col("rep").alias("h1"), "h2", F.coalesce("least", "first").alias("component_id"))
    out = signed.select("doc_id", "text_hash", *signature).join(named, signature, "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash")


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Distinct edges of lists of equal subsets and of prefix shingles: of a short list all pairs whose sketches allow a link, of a long
    one each set with the first it may match in size, else with the one before."""
    from pyspark.sql import Window

    subset = classes.select("rep", "n", F.lit(0).alias("kind"), F.explode("subsets").alias("key"))
    prefix = classes.select("rep", "n", F.lit(1).alias("kind"), F.explode("prefix").alias("key"))
    rows = Window.partitionBy("kind", "key").orderBy("n", "rep")
    one = F.struct("rep", "n")
    length = F.count(F.lit(1)).over(rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lists = subset.unionByName(prefix).withColumn("length", length).where("length > 1")
    earlier = F.collect_list(one).over(rows.rowsBetween(1 - SHORT, -1))
    lists = lists.select("kind", "rep", "n", "length", F.when(F.col("length") <= SHORT, earlier).alias("earlier"), F.lag(one).over(rows).alias("before"), F.first(one).over(rows).alias("first"))
    fits = lambda x: (F.col("kind") == 0) | (100 * x["n"] >= percent * F.col("n"))
    to = F.when(fits(F.col("first")), F.col("first")).when(fits(F.col("before")), F.col("before"))
    long = F.when(to.isNotNull() & F.col("before").isNotNull(), F.array(to)).otherwise(F.array().cast("array<struct<rep:long,n:long>>"))
    met = lists.select("rep", "kind", "length", F.explode(F.when(F.col("length") <= SHORT, F.filter("earlier", fits)).otherwise(long)).alias("to"))
    met = met.select(F.col("rep").alias("a"), F.col("to.rep").alias("b"), (F.col("length") > SHORT).alias("sure")).where("a != b")
    met = stored(met.groupBy("a", "b").agg(F.max("sure").alias("sure")), "met")
    sketch = classes.select("rep", "n", "sketch")
    unsure = met.where("not sure").join(sketch.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
    unsure = unsure.join(sketch.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")

    def possible(batches):
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (3, 5))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            most[((x == 255) | (y == 255)).any(axis=1)] = 1 << 40  # a full counter bounds nothing
            ok = 100 * most >= percent * (n - np.minimum(most, n // 2))
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    checked = unsure.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(possible, "a long, b long")
    return met.where("sure").select("a", "b").unionByName(checked)


def size_class(n, percent: int):
    """Sizes that can link are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) * (1 - 1e-12)).cast("int")


def compare(docs: DataFrame, members: DataFrame, percent: int, k: int, kind: np.ndarray) -> DataFrame:
    """(rep, component) of the members (rep, first, n, pool), by the links within each pool.

    A pool of BLOCK sets is one block, whose components are known in its task. A larger one is cut by size class and hash into parts. Each
    is compared within itself first; then one set of each component that this gives, with the others of its size class and the next; and
    of a pool that isn't one component by now, all pairs of parts that can match in size, without those within its largest component. So
    a group of very many near copies costs about one comparison a set, and no pair that could join two components goes unseen.
    """
    members = stored(members.withColumn("class", size_class(F.col("n"), percent)), "members")
    pools = members.groupBy("pool").agg(F.count(F.lit(1)).alias("in_pool"))
    whole = members.join(pools, "pool")
    small = whole.where(F.col("in_pool") <= BLOCK).select("rep", "first", F.concat_ws("/", "pool").alias("block"))
    large = stored(whole.where(F.col("in_pool") > BLOCK).drop("in_pool").withColumn("side", F.lit(0)), "large")
    own = parted(large).select("rep", "first", F.concat_ws("/", "pool", "place").alias("block"))
    groups = stored(scanned(docs, small.unionByName(own), percent, k, kind), "groups")
    if large.isEmpty():
        return groups
    roots = large.join(groups.where("rep = component").select("rep"), "rep", "left_semi")
    links = stored(scanned(docs, pairs_of_parts(roots), percent, k, kind).where("rep != component"), "links")
    groups = renamed(groups, connected(links, "rep", "component"))
    sizes = large.join(groups, "rep").groupBy("pool", "component").agg(F.count(F.lit(1)).alias("size"))
    several = sizes.groupBy("pool").agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("size", "component")).alias("largest")).where("components > 1")
    rest = large.drop("side").join(groups, "rep").join(several.select("pool", F.col("largest.component").alias("largest")), "pool")
    rest = stored(rest.withColumn("side", (F.col("component") == F.col("largest")).cast("int")).select("rep", "first", "n", "pool", "class", "side"), "rest")
    if rest.isEmpty():
        return groups
    links = scanned(docs, pairs_of_parts(rest), percent, k, kind).where("rep != component").withColumnRenamed("component", "other")
    named = groups.select(F.col("rep").alias("other"), F.col("component").alias("to"))
    links = stored(links.join(groups, "rep").join(named, "other").where("component != to").select("component", "to").distinct(), "links")
    return groups if links.isEmpty() else renamed(groups, connected(links, "component", "to"))


def renamed(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(rep, component) with the components' new names (node, component), stored."""
    new = found.select(F.col("node").alias("component"), F.col("component").alias("name"))
    return stored(groups.join(new, "component", "left").select("rep", F.coalesce("name", "component").alias("component")), "groups")


def parted(members: DataFrame) -> DataFrame:
    """The members with `place`, their part of pool, size class and side (about BLOCK / 2 sets each)."""
    key = ["pool", "class", "side"]
    parts = members.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (BLOCK // 2)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    return members.join(parts, key).withColumn("place", F.concat_ws(":", "class", "side", part))


def pairs_of_parts(members: DataFrame) -> DataFrame:
    """(rep, first, block): a block for each two parts of a pool whose size classes are the same or neighbours and that aren't both of
    side 1; a member goes to all blocks of its part."""

    def names(there: Column, other: Column) -> Column:
        both = lambda j: (F.col("place"), F.concat_ws(":", other, j))
        return F.transform(there, lambda j: F.concat_ws("/", "pool", F.least(*both(j)), F.greatest(*both(j))))

    placed = parted(members)
    counts = placed.groupBy("pool", "class", "side").agg(F.max("parts").alias("parts"))
    known = counts.groupBy("pool").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "class", "side").alias("key"), "parts"))).alias("known"))  # an entry per size class
    blocks = []
    for step in (-1, 0, 1):
        for side in (0, 1):
            other = F.concat_ws(":", F.col("class") + step, F.lit(side))
            n = F.when((F.col("side") == 0) | F.lit(side == 0), F.coalesce(F.try_element_at("known", other), F.lit(0))).otherwise(0)
            there = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
            blocks.append(names(there, other))
    return placed.join(known, "pool").select("rep", "first", F.explode(F.concat(*blocks)).alias("block"))


def scanned(docs: DataFrame, wanted: DataFrame, percent: int, k: int, kind: np.ndarray) -> DataFrame:
    """(rep, component) of the sets of each block (rep, first, block) by the links within it; a component's name is one of its sets."""
    wanted = stored(wanted.withColumnRenamed("first", "doc_id"), "blocks")

    def sets(batches):
        for batch in batches:
            reps, found, size, first = batch.column(0).to_numpy(), [], 0, 0
            for i, x in enumerate(each_set(batch, 2, kind, k)):
                own = len(x) and int(x.sum(dtype=np.uint64).view(np.int64)) == reps[i]  # not another text of the same id
                found.append(x.tobytes() if own else None)
                size += x.nbytes
                if size > 1 << 20 or i == batch.num_rows - 1:  # in small portions
                    part = batch.slice(first, len(found))
                    out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], ["rep", "block", "shingles"])
                    yield out.filter(pa.array([x is not None for x in found], pa.bool_()))
                    found, size, first = [], 0, i + 1

    # A table of few ids (counted) is sent to the texts, a larger one is met by a shuffle.
    few = wanted.count() <= FEW
    texts = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("rep", "block", "text")
    shipped = texts.mapInArrow(sets, "rep long, block string, shingles binary")

    def scan(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}  # a repeated id comes once
        for batch in batches:
            own |= {r: np.frombuffer(x.as_buffer(), np.uint64) for r, x in zip(batch.column("rep").to_pylist(), batch.column("shingles"), strict=True)}
        reps = list(own)
        root = forest(list(own.values()), percent)
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array([reps[i] for i in root], pa.int64())], ["rep", "component"])

    return shipped.groupBy("block").applyInArrow(scan, "rep long, component long")


def forest(sets: list[np.ndarray], percent: int) -> list[int]:
    """Of each set the first one that links among these sets lead to, by inverted lists of all their shingles."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(local, kind="stable")
    lists = owner[order]
    ends = np.cumsum(np.bincount(local))
    starts = np.append(0, ends[:-1])
    first = np.append(0, np.cumsum(size))
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n):
        mine = local[first[i] : first[i + 1]]
        s, length = starts[mine], ends[mine] - starts[mine]
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(s, length)
        overlap = np.bincount(lists[at], minlength=n)
        for j in np.flatnonzero(100 * overlap[:i] >= percent * (size[i] + size[:i] - overlap[:i])).tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]
