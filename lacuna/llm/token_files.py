"""Token ids in Arrow stream files of fixed-size lists.

A shard holds consecutive documents in ascending doc_id order (null last, equal ids by
text). Its stream has batches of BATCH_ROWS rows; a row is one sequence of `length` ids
and one mask of as many bits, false where the last row is padded. All batches but the last
take as many bytes, so any sequence is at a place known beforehand: Sequences reads it from
a mapped local file without a copy, and by one ranged read from a store. A second stream beside it has
doc_id, start within the shard and n_tokens. A manifest table, written by Spark, names
the files of the task attempts that won; files of lost attempts are never read.

Cases: null and empty text give the end id alone; an empty table gives an empty manifest
and result; repeated rows are repeated; long texts fill as many sequences as they need;
columns beside doc_id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lacuna.llm.bpe import Codec, byte_letters
from lacuna.llm.common import partitions, shared_dir, staged

LENGTH, BATCH_ROWS = 1024, 256
#: Names that Spark's file systems have and Arrow's do not.
SCHEMES = (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://"), ("wasb://", "abfs://"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a URI as Spark writes it, and the path in it."""
    for theirs, ours in SCHEMES:
        if uri.startswith(theirs):
            uri = ours + uri[len(theirs) :]
            uri = uri.replace(".blob.core.", ".dfs.core.", 1) if ours.startswith("abfs") else uri
    return pafs.FileSystem.from_uri(uri)


class LibraryCodec(Codec):
    """The tokenizers library's ids: it encodes each distinct pre-token once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.letters = dict(enumerate(byte_letters()))

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters = self.model.tokenize, self.letters
        ids: list[int] = []
        ends: list[int] = []
        for w in words:
            ids += [t.id for t in tokenize(w.decode("latin-1").translate(letters))]
            ends.append(len(ids))
        return np.array(ids, np.int32), np.array(ends, np.int64)

    def learn(self) -> None:
        known = len(self.ends)
        if known < len(self.words):
            flat, ends = self.merged([w.encode() for w in list(self.words)[known:]])
            self.ends = np.concatenate([self.ends, ends + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat])


@lru_cache(maxsize=2)
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


class _Sequences:
    """Cuts a stream of ids into the rows of a shard's file."""

    def __init__(self, out, length: int, dtype: np.dtype):
        self.length, self.dtype, self.held, self.n = length, dtype, [], 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_stream(out, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n += len(ids)
        if self.n >= BATCH_ROWS * self.length:
            flat, size = np.concatenate(self.held), BATCH_ROWS * self.length
            whole = self.n // size * size
            for lo in range(0, whole, size):
                self.put(flat[lo : lo + size])
            self.held, self.n = [flat[whole:]], self.n - whole

    def put(self, flat: np.ndarray) -> None:
        rows = -(-len(flat) // self.length)
        mask = np.arange(rows * self.length) < len(flat)
        flat = np.concatenate([flat, np.zeros(rows * self.length - len(flat), self.dtype)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t.type) for x, t in zip((flat, mask), self.schema, strict=True)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n:
            self.put(np.concatenate(self.held))
        self.writer.close()


MANIFEST = "shard long, file string, n_docs long, n_ids long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write(docs: DataFrame, path: str, folder: str | None = None, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """Writes the shards to folder (a URI that all executors reach); returns the manifest."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task = library_codec(path), TaskContext.get()
        shard, out, total, starts, sizes, ids_of = task.partitionId(), None, 0, [], [], []
        dtype = np.dtype(np.uint16 if max(tok.size, end_id + 1) <= 1 << 16 else np.uint32)
        for batch in batches:
            if out is None and batch.num_rows:
                fs, base = filesystem(folder)
                fs.create_dir(base, recursive=True)
                name = f"shard-{shard:06d}-{task.taskAttemptId()}"
                out = fs.open_output_stream(f"{base}/{name}.ids.arrow")
                rows = _Sequences(out, length, dtype)
            ids_of += batch.column(0).to_pylist()
            for block in tok.blocks(x.as_py() for x in batch.column(1)):
                for words in block:
                    ids = np.append(tok.ids(words), np.int32(end_id))
                    starts.append(total)
                    sizes.append(len(ids))
                    total += len(ids)
                    rows.add(ids)
        if out is not None:
            rows.close()
            out.close()
            with fs.open_output_stream(f"{base}/{name}.docs.arrow") as f, pa.ipc.new_stream(f, DOCS) as w:
                w.write_table(pa.table([ids_of, starts, sizes], schema=DOCS), max_chunksize=65536)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{folder}/{name}"], "n_docs": [len(sizes)], "n_ids": [total]})

    return staged(dealt.mapInArrow(run, MANIFEST), "token-manifest")


class Sequences:
    """The sequences of a file, at random: ids and mask of each, views of the file's bytes where it is mapped."""

    def __init__(self, file: str):
        fs, base = filesystem(file)
        path = f"{base}.ids.arrow"
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.schema = pa.ipc.read_schema(self.source)
        self.length = self.schema.field("ids").type.list_size
        self.first, self.step, self.at, self.held = self.source.tell(), 0, -1, None

    def batch(self, b: int) -> pa.RecordBatch:
        """Batch b, by its place."""
        if b != self.at:
            if b and not self.step:
                self.batch(0)
            self.source.seek(self.first + b * self.step)
            message = pa.ipc.read_message(self.source)
            if not b:
                self.step = self.source.tell() - self.first
            self.at, self.held = b, pa.ipc.read_record_batch(message, self.schema)
        return self.held

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        b, row = divmod(i, BATCH_ROWS)
        ids, mask = (self.batch(b).column(c).values.slice(row * self.length, self.length) for c in (0, 1))
        if i < 0 or not len(ids):
            raise IndexError(i)
        return ids.to_numpy(zero_copy_only=True), mask

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from a place within the shard on; a view where they are in one batch."""
        size, parts = BATCH_ROWS * self.length, []
        while n > 0 or not parts:
            b, at = divmod(start, size)
            part = self.batch(b).column(0).values.slice(at, min(n, size - at)).to_numpy(zero_copy_only=True) if n else np.zeros(0, self.schema.field("ids").type.value_type.to_pandas_dtype())
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def documents(file: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, start within the shard and ids of each document, in the shard's order."""
    fs, base = filesystem(file)
    sequences = Sequences(file)
    with fs.open_input_stream(f"{base}.docs.arrow") as f:
        for index in pa.ipc.open_stream(f):
            for doc, start, size in zip(*(c.to_pylist() for c in index.columns), strict=True):
                yield doc, start, sequences.span(start, size)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start among all ids, n_tokens and ids_crc32 of each document, from the files."""
    order = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    spread = based.select("file", "base").repartition(partitions(manifest.sparkSession), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: list[list] = [[], [], [], []]
                for doc, start, ids in documents(file):
                    for column, x in zip(out, (doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
