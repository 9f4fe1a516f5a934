"""Token ids as flat binary files that can be memory-mapped.

A folder holds, for each partition p of the documents in ascending id order,

* p.bin: the ids of its documents, one after the other, each document closed by the end id; unsigned little-endian integers of the
  smallest width (2 or 4 bytes) that holds every id of the vocabulary;
* p.idx: (n + 1) little-endian unsigned 64-bit offsets, in ids from the start of the whole corpus, then the n document ids (signed
  64 bits).

The start of a partition in the corpus is the sum of the sizes of those before it, so offsets are global although all partitions are
written at the same time: first the .bin files, then, when the sizes are known, the .idx files.

A task writes to a name of its own and renames at the end, so that a task that is repeated or runs twice leaves whole files. The last
thing written is manifest.json, which lists the parts; then nothing else is left in the folder.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .piece_table import Table, runs, spaces
from .shared import kept, new_path, pieces, text_bytes

#: Bytes of text that are looked up at once; pieces that are encoded as one text.
BLOCK, JOINT = 2 << 20, 20_000
#: Bytes of text a partition should have.
PARTITION_BYTES = 16 << 20
#: Lists the parts of a folder: (partition, place of its first id in the corpus, documents). What stands for a null document id.
MANIFEST, NULL = "manifest.json", np.iinfo(np.int64).min


def opened(url: str) -> tuple[pafs.FileSystem, str]:
    if url.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", url)
    return pafs.FileSystem.from_uri(url)


def put(fs: pafs.FileSystem, mine: str, to: str) -> None:
    """Gives a whole file its name; where an earlier attempt of the task did so already, its file (of the same content) stays."""
    if fs.get_file_info(to).type == pafs.FileType.File and fs.get_file_info(to).size == fs.get_file_info(mine).size:
        fs.delete_file(mine)
    else:
        fs.move(mine, to)


def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def dtype_of(tokenizer: str) -> str:
    return "<u2" if tokenizer_of(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


class Coder(Table):
    """Raw ids of texts by the tokenizers library."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token, a letter each
        self.width[list(vocabulary.values())] = [len(w) for w in vocabulary]
        self.special = np.zeros(256, bool)  # first bytes of special tokens
        self.special[[t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]] = True
        super().__init__([self.dtype], BLOCK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, raw: bytes) -> list[np.ndarray]:
        return [np.array(self.encode([raw.decode()])[0], self.dtype)]

    def made(self, raw: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        # Pieces that begin with a space before a visible character and end in one have borders at both ends, so many are encoded as one text.
        begin, size, blank = at[:-1], np.diff(at), spaces(raw)
        n_special = np.append(0, np.cumsum(self.special[raw], dtype=np.int64))
        joint = (raw[begin] == 32) & (size > 1) & (n_special[at[1:]] == n_special[begin])
        joint &= ~blank[np.minimum(begin + 1, len(raw) - 1)] & ~blank[at[1:] - 1]
        order = np.append(np.flatnonzero(joint), np.flatnonzero(~joint))
        dealt = raw[runs(begin[order], size[order])]
        upto = np.append(0, np.cumsum(size[order]))
        ids, counts, n_joint = [], [], int(joint.sum())
        for i in range(0, n_joint, JOINT):
            j = min(i + JOINT, n_joint)
            found = np.array(self.encode([dealt[upto[i] : upto[j]].tobytes().decode()])[0])
            ends, wide = upto[i + 1 : j + 1] - upto[i], np.cumsum(self.width[found])
            to = np.searchsorted(wide, ends)
            if not np.array_equal(wide[np.minimum(to, len(wide) - 1)], ends):
                raise ValueError("a token crosses the border of two pieces")
            ids.append(found)
            counts.append(np.diff(to, prepend=-1))
        text = dealt.tobytes()
        alone = self.encode([text[upto[i] : upto[i + 1]].decode() for i in range(n_joint, len(size))])
        flat = np.concatenate([*ids, *[np.array(x, np.int64) for x in alone]]).astype(self.dtype)
        count = np.concatenate([*counts, np.array([len(x) for x in alone], np.int64)])
        place = np.empty(len(order), np.int64)  # back to the given order
        place[order] = np.arange(len(order))
        return [(flat[runs((np.cumsum(count) - count)[place], count[place])], count[place])]


def coder(path: str) -> Coder:
    return kept(("tokens", path), lambda: Coder(path))


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> list[tuple[int, int, int]]:
    """Writes the files; returns (partition, first id's place in the corpus, documents), one row per partition with documents.

    Null texts are empty: a document of the end id alone. Rows with a null document id come first. Rows of one id stand in the order of
    their texts (a null one first). An empty table writes only an empty manifest.
    """

    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        code = coder(tokenizer)
        fs, base = opened(folder)
        k = TaskContext.get().partitionId()
        ids, sizes, out, mine = [], [], None, f"{base}/{k}.bin.{uuid.uuid4().hex}"
        try:
            for batch in batches:
                ids.append(batch.column(0).fill_null(NULL).to_numpy().astype("<i8"))
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(mine)
                data, offsets = text_bytes(batch.column(1))
                for i, j in pieces(offsets, 2 * BLOCK):
                    [(found, upto)] = code.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    out.write(np.insert(found, upto[1:], end_id).tobytes())
                    sizes.append(np.diff(upto) + 1)
        finally:
            if out is not None:
                out.close()
        if out is None:
            return
        put(fs, mine, f"{base}/{k}.bin")
        sizes = np.concatenate(sizes)
        with fs.open_output_stream(f"{mine}.idx") as f:  # local offsets, until the sizes of all partitions are known
            f.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes())
            f.write(np.concatenate(ids).tobytes())
        put(fs, f"{mine}.idx", f"{base}/{k}.local")
        yield pa.RecordBatch.from_pylist([{"k": k, "n": len(sizes), "size": int(sizes.sum())}])

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = partitions or partitions_for(spark, docs)
    sizes = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text").mapInArrow(encode, "k long, n long, size long").collect()
    base, bases = 0, []
    for r in sorted(sizes, key=lambda r: r.k):  # one row per partition
        bases.append((r.k, base, r.n))
        base += r.size

    def place(batches):
        fs, at = opened(folder)
        for batch in batches:
            for k, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{at}/{k}.local") as f:
                    data = f.read()
                n = len(data) // 16
                mine = f"{at}/{k}.idx.{uuid.uuid4().hex}"
                with fs.open_output_stream(mine) as f:
                    f.write((np.frombuffer(data, "<u8", n + 1) + np.uint64(start)).tobytes())
                    f.write(data[8 * (n + 1) :])
                put(fs, mine, f"{at}/{k}.idx")
            yield batch.slice(0, 0)

    if bases:
        manifest(spark, bases).mapInArrow(place, "k long, base long, n long").count()
    fs, at = opened(folder)
    fs.create_dir(at, recursive=True)
    for info in fs.get_file_info(pafs.FileSelector(at)):  # what only served the writing, and what attempts that failed left
        if info.type == pafs.FileType.File and not re.fullmatch(r"[0-9]+\.(bin|idx)", info.base_name):
            fs.delete_file(info.path)
    with fs.open_output_stream(f"{at}/{MANIFEST}") as f:
        f.write(json.dumps({"dtype": dtype_of(tokenizer), "end_id": end_id, "parts": bases}).encode())
    return bases


def partitions_for(spark: SparkSession, docs: DataFrame) -> int:
    """By the size that Catalyst reads from the files; at least the number of cores."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(size // PARTITION_BYTES + 1, spark.sparkContext.defaultParallelism), 200_000))


def manifest(spark: SparkSession, bases: list[tuple[int, int, int]]) -> DataFrame:
    """One partition per file: a row of (partition, base, documents)."""
    return spark.createDataFrame(spark.sparkContext.parallelize(bases, len(bases)), "k long, base long, n long")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """From the files that the folder's manifest lists: doc_id, start (ids of all documents before it), n_tokens (with the end id),
    ids_crc32 (of the ids as unsigned 32-bit integers). Local files are memory-mapped. A folder whose writing didn't end has no
    manifest and is an error."""

    fs, at = opened(folder)
    with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
        listed = json.loads(f.read())
    bases, kind = [tuple(x) for x in listed["parts"]], listed["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not bases:
        return spark.createDataFrame([], schema)

    def read(batches):
        dtype = np.dtype(kind)
        fs, at = opened(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{at}/{k}.idx") as f:
                    index = f.read()
                n = len(index) // 16
                offsets = np.frombuffer(index, "<u8", n + 1).astype(np.int64)
                doc_ids = np.frombuffer(index, "<i8", n, 8 * (n + 1))
                if isinstance(fs, pafs.LocalFileSystem):
                    ids = np.memmap(f"{at}/{k}.bin", dtype, "r")
                    get = lambda a, b, ids=ids: ids[a:b]
                else:
                    f = fs.open_input_file(f"{at}/{k}.bin")
                    get = lambda a, b, f=f: np.frombuffer(f.read_at((b - a) * dtype.itemsize, a * dtype.itemsize), dtype)
                local = offsets - offsets[0]
                crc = [zlib.crc32(get(a, b).astype("<u4")) for a, b in zip(local[:-1].tolist(), local[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL), pa.array(offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest(spark, bases).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the corpus to `folder` (a new one in the shared folder unless given) and returns what the files hold."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    write_files(docs, folder, tokenizer, end_id)
    return read_files(docs.sparkSession, folder)
