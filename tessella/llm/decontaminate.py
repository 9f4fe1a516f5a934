"""Benchmark decontamination by a positional inverted index.

The index is document-partitioned: a shard holds the postings of every token of a run of whole documents, so a term that stands in a
third of all documents has short lists in many shards rather than one long list, and neither building nor searching shuffles. Shards
are stored as a table, a row per shard: sorted term hashes, list ends, and the lists' position gaps as variable-length bytes.

A search takes phrases in blocks of bounded size, one after the other, each sent to all shards. In a shard a phrase is dropped at once if one of its terms
has no list; else the lists are intersected after subtracting each term's offset in the phrase, beginning with the shortest list (the
shard's rarest term). What is left are the exact starts of the phrase. Proximity search keeps starts of the rarest term for which
every other term stands within a distance.

Nulls and texts without words have no postings, but keep their rows; repeated rows are separate documents; other columns of the
documents aren't looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import forget, new_path, pieces, small_batches, text_bytes
from .words import ALNUM, Words

#: Text bytes of a shard; a longer document is a shard of its own.
SHARD_BYTES = 2 << 20
#: Phrases that are sent at once (each has at most `window` terms of 8 bytes).
BLOCK = 100_000
#: What stands for a null id in a shard; the digest of no items.
NULL, NONE = np.iinfo(np.int64).min, hashlib.sha256(b"").hexdigest()

SHARD = "name string, doc_ids binary, text_hashes binary, first binary, terms binary, ends binary, gaps binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, 7 bits a byte, low bits first; the high bit says that more follow."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >= np.uint64(1 << bits)
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        has = size > i
        byte = (values[has] >> np.uint64(7 * i)) & np.uint64(127)
        out[at[has] + i] = byte.astype(np.uint8) | ((size[has] > i + 1) * np.uint8(128)).astype(np.uint8)
    return out.tobytes()


def unpack(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first) if len(data) else np.empty(0, np.int64)


def build_index(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards. Positions of different documents are at least `window` apart, so that no phrase match spans two."""

    def run(batches):
        forget()
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            ids = np.where(np.asarray(ids.is_null()), NULL, np.asarray(ids.fill_null(0)))
            text_hash = batch.column(2).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for a, b in pieces(offsets, SHARD_BYTES):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                h, first = words.hashes, words.first
                position = np.arange(len(h)) + np.repeat(np.arange(b - a) * window, np.diff(first))
                order = np.argsort(h, kind="stable")
                h, position = h[order], position[order]
                new = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
                gaps = np.diff(position, prepend=0)
                gaps[new] = position[new]
                size = np.ones(len(h), np.int64)
                for bits in range(7, 64, 7):
                    size += gaps >= 1 << bits
                ends = np.append(np.cumsum(size)[np.flatnonzero(new)[1:] - 1], size.sum()) if len(h) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([x], pa.binary()) for x in (ids[a:b].tobytes(), text_hash[a:b].tobytes(), first.astype(np.int64).tobytes(), h[new].tobytes(), ends.astype(np.int64).tobytes(), pack(gaps)))], ["name", "doc_ids", "text_hashes", "first", "terms", "ends", "gaps"])

    spark = docs.sparkSession
    path = new_path(spark, "index")
    small_batches(docs).select(id_col, text_col, F.xxhash64(F.col(text_col)).alias("text_hash")).mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(SHARD).parquet(path)


class Shard:
    def __init__(self, doc_ids: bytes, text_hashes: bytes, first: bytes, terms: bytes, ends: bytes, gaps: bytes, window: int):
        self.doc_ids, self.text_hashes, self.first = (np.frombuffer(x, np.int64) for x in (doc_ids, text_hashes, first))
        self.terms, self.ends, self.gaps = np.frombuffer(terms, np.uint64), np.frombuffer(ends, np.int64), np.frombuffer(gaps, np.uint8)
        self.base = self.first[:-1] + np.arange(len(self.doc_ids)) * window  # position of each document's first word
        self.lists: dict[int, np.ndarray] = {}

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms in the shard's dictionary, -1 if it has no such term."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def list(self, at: int) -> np.ndarray:
        if at not in self.lists:
            self.lists[at] = np.cumsum(unpack(self.gaps[self.ends[at - 1] if at else 0 : self.ends[at]]))
        return self.lists[at]

    def size(self, at: np.ndarray) -> np.ndarray:
        """Bytes of the lists: what reading them costs, and nearly their lengths."""
        return self.ends[at] - np.where(at > 0, self.ends[at - 1], 0)

    def exact(self, at: np.ndarray) -> np.ndarray:
        """Starts of the phrase whose terms have these places in the dictionary."""
        found = None
        for i in np.argsort(self.size(at), kind="stable").tolist():
            if found is None:
                found = self.list(at[i]) - i
            else:
                has = self.list(at[i])
                to = np.searchsorted(has, found + i)
                to[to == len(has)] = 0
                found = found[has[to] == found + i]
            if not len(found):
                break
        return found

    def near(self, at: np.ndarray, distance: int) -> np.ndarray:
        """Positions of the rarest term that have all other terms within `distance` words."""
        order = np.argsort(self.size(at), kind="stable")
        found = self.list(at[order[0]])
        for i in order[1:].tolist():
            has = self.list(at[i])
            to = np.searchsorted(has, found - distance)
            ok = to < len(has)
            ok[ok] = has[to[ok]] <= found[ok] + distance
            found = found[ok]
        return found

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, positions, "right") - 1


def phrases_of(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text"):
    """Blocks of (item ids, term hashes of all phrases end to end, phrase lengths); an item's words, `window` at a time, or all of
    them if there are fewer. Items without words have none."""
    ids, terms, sizes = [], [], []

    def block():
        return np.array(ids, dtype=object), np.concatenate(terms), np.array(sizes)

    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if row.t is None or row.i is None:
            continue
        data = np.frombuffer(row.t.encode(), np.uint8)
        h = Words(data, np.array([0, len(data)]), ALNUM).hashes if len(data) else np.empty(0, np.uint64)
        size = min(window, len(h))
        for k in range(len(h) - size + 1 if size else 0):
            ids.append(row.i)
            terms.append(h[k : k + size])
            sizes.append(size)
            if len(ids) == BLOCK:
                yield block()
                ids, terms, sizes = [], [], []
    if ids:
        yield block()


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<start:long,end:long>>, text_hash long"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit (words inside an occurrence of a window of a benchmark item), n_items and digest of the items with
    occurring windows, contaminated (n_hit > 0), the hit stretches as word positions, and text_hash (xxhash64 of the text).

    A benchmark without words contaminates nothing; a null item id takes no part.
    """
    spark = docs.sparkSession
    index = build_index(docs, window, id_col, text_col)
    blocks = phrases_of(benchmark, window, item_col, item_text_col)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        sent = spark.sparkContext.broadcast(first or (np.empty(0, object), np.empty(0, np.uint64), np.empty(0, np.int64)))  # BLOCK phrases at most
        return index.mapInArrow(lambda batches: (result(shard, hits_of(shard, sent.value)) for _, shard in shards(batches, window)), RESULT)
    # A larger benchmark goes block by block: one at a time is on the driver and on the executors, and the hits are stored.
    path = new_path(spark, "hits")
    for block in itertools.chain([first, second], blocks):
        sent = spark.sparkContext.broadcast(block)
        index.mapInArrow(lambda batches, sent=sent: (table_of(name, hits_of(shard, sent.value)) for name, shard in shards(batches, window)), HITS).write.mode("append").parquet(path)
        sent.unpersist()
    hits = spark.read.schema(HITS).parquet(path).groupBy("name").agg(F.collect_list(F.struct("doc", "start", "size", "item")).alias("found"))  # of one shard's documents
    met = index.join(hits, "name", "left").select(*[x.split()[0] for x in SHARD.split(", ")], "found")

    def collected(batches):
        for batch in batches:
            for (_, shard), found in zip(shards([batch], window), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                yield result(shard, [(x["doc"], x["start"], x["size"], x["item"]) for x in found or ()])

    return met.mapInArrow(collected, RESULT)


HITS = "name string, doc long, start long, size long, item string"
Hit = tuple[int, int, int, str]  # document of the shard, first word, words, item


def shards(batches, window: int):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), Shard(*[batch.column(j)[k].as_buffer() for j in range(1, 7)], window)


def hits_of(shard: Shard, block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[Hit]:
    """All occurrences of a block's phrases in a shard."""
    ids, terms, sizes = block
    if not len(sizes):
        return []
    at = shard.find(terms)
    first = np.cumsum(sizes) - sizes
    found = []
    for i in np.flatnonzero(np.minimum.reduceat(at, first) >= 0).tolist():
        starts = shard.exact(at[first[i] : first[i] + sizes[i]])
        found += [(d, s - int(shard.base[d]), int(sizes[i]), ids[i]) for d, s in zip(shard.document(starts).tolist(), starts.tolist(), strict=True)]
    return found


def table_of(name: str, found: list[Hit]) -> pa.RecordBatch:
    doc, start, size, item = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array([name] * len(doc), pa.string()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(item, pa.string())], ["name", "doc", "start", "size", "item"])


def result(shard: Shard, found: list[Hit]) -> pa.RecordBatch:
    stretches: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    for d, start, size, item in found:
        stretches[d].append((start, start + size))
        items[d].add(item)
    n = np.diff(shard.first).tolist()
    hits = [merged(stretches.get(d, [])) for d in range(len(n))]
    n_hit = [sum(e - s for s, e in x) for x in hits]
    digest = [hashlib.sha256(",".join(sorted(items[d])).encode()).hexdigest() if d in items else NONE for d in range(len(n))]
    return pa.RecordBatch.from_arrays(
        [pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NULL), pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(items.get(d, ())) for d in range(len(n))], pa.int64()), pa.array(digest), pa.array([x > 0 for x in n_hit]), pa.array([[{"start": s, "end": e} for s, e in x] for x in hits], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(shard.text_hashes)],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "text_hash"],
    )


def proximity(index: DataFrame, phrases: list[str], distance: int, window: int) -> DataFrame:
    """Documents in which all words of a phrase stand within `distance` words of its rarest one: phrase, doc_id, places (number)."""
    queries = []
    for p in phrases:
        data = np.frombuffer(p.encode(), np.uint8)
        queries.append(Words(data, np.array([0, len(data)]), ALNUM).hashes if len(data) else np.empty(0, np.uint64))

    def run(batches):
        for batch in batches:
            out = []
            for _, shard in shards([batch], window):
                for phrase, terms in zip(phrases, queries, strict=True):
                    at = shard.find(terms)
                    if not len(at) or at.min() < 0:
                        continue
                    d, s = np.unique(shard.document(shard.near(at, distance)), return_counts=True)
                    out += [{"phrase": phrase, "doc_id": int(shard.doc_ids[i]), "places": int(c)} for i, c in zip(d, s, strict=True)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("phrase", pa.string()), ("doc_id", pa.int64()), ("places", pa.int64())]))

    if distance >= window:
        raise ValueError("the index was built for nearer words")
    return index.mapInArrow(run, "phrase string, doc_id long, places long")


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(stretches):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
