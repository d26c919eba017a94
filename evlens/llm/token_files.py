"""Token ids as Arrow IPC files of fixed-size-list batches.

Each shard file holds the ids of a contiguous range of documents, in ascending document
order, cut into rows of ``width`` ids: column ``ids`` is a fixed-size list of unsigned
integers, ``mask`` a fixed-size list of booleans (false only on the padding of the last
row). Buffers aren't compressed, so a memory-mapped file gives any sequence or any
document as a view without a copy. The schema's metadata names the shard; the document
index (document, first id within the shard, number of ids) is a table beside the files.

Shards are written by the tasks under names that no other attempt uses; the index, which
Spark commits, names the files that count. A lost executor's half-written files are never
read. Files go to the shared folder through Arrow's file systems (file, hdfs, s3, gs).

Defined results: null or empty text -> the end id alone; documents with null ids come
first; equal ids are ordered by text; an empty table gives an empty index and no file.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .chunked import ChunkEncoder
from .common import pieces, stored

#: Rows of ids in one record batch of a file.
ROWS_PER_BATCH = 256

INDEX = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("path", T.StringType()), T.StructField("doc", T.LongType()),
    T.StructField("seq", T.LongType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType())])


@functools.lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> ChunkEncoder:
    return ChunkEncoder(Tokenizer.from_file(path), dtype)


def id_type(path: str) -> str:
    """Two bytes an id where the vocabulary allows it, else four."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


class ShardWriter:
    """Appends runs of ids; writes full record batches as they fill."""

    def __init__(self, uri: str, shard: int, width: int, dtype: str) -> None:
        self.width, self.total, self.dtype = width, 0, np.dtype(dtype)
        self.open, self.held = [], 0  # runs of the open batch, and their ids
        system, path = fs.FileSystem.from_uri(uri)
        value = pa.uint16() if np.dtype(dtype).itemsize == 2 else pa.uint32()
        self.schema = pa.schema([pa.field("ids", pa.list_(value, width)), pa.field("mask", pa.list_(pa.bool_(), width))],
                                metadata={"shard": str(shard), "width": str(width)})
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.sink = system.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def _emit(self, values: np.ndarray, valid: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(values), self.width)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(values)) < valid), self.width)
        self.writer.write_batch(pa.record_batch([ids, mask], schema=self.schema))

    def append(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.open.append(ids)
        self.held += len(ids)
        full = self.width * ROWS_PER_BATCH
        if self.held >= full:
            values = np.concatenate(self.open)
            whole = len(values) - len(values) % full
            for at in range(0, whole, full):
                self._emit(values[at:at + full], full)
            self.open, self.held = [values[whole:].copy()], len(values) - whole

    def close(self) -> None:
        if self.held:
            self._emit(np.pad(np.concatenate(self.open), (0, -self.held % self.width)), self.held)
        self.writer.close()
        self.sink.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, width: int = 2048,
                      id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write the shard files below ``folder`` and return the stored document index.

    Documents are dealt to shards by ranges of ``id_col``; ``seq`` is the order in the shard.
    """
    dtype = id_type(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, encoder = TaskContext.get().partitionId(), _encoder(tokenizer_path, dtype)
        writer, path, seq = None, f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.arrow", 0
        for batch in batches:
            for part in pieces(batch, 1, 2 << 20):
                writer = writer or ShardWriter(path, shard, width, dtype)
                ids, ends = encoder.encode_array(part.column(1))
                n = part.num_rows
                sizes = np.diff(ends, prepend=0) + 1
                starts = writer.total + np.cumsum(sizes) - sizes
                writer.append(np.insert(ids, ends, np.array(end_id, dtype=dtype)))  # an end id behind each text
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard)), pa.array([path] * n), part.column(0), pa.array(np.arange(seq, seq + n)),
                     pa.array(starts), pa.array(sizes)], names=INDEX.names)
                seq += n
        if writer:
            writer.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    count = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, F.col("doc").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("doc").asc_nulls_first(), "body")
    return stored(ordered.mapInArrow(run, INDEX), "token-index")


class ShardReader:
    """Random access to one file: sequences, masks and documents as views of the mapped file."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.width = int(self.file.schema.metadata[b"width"])
        self.per_batch = ROWS_PER_BATCH * self.width
        self._batch = functools.lru_cache(maxsize=2)(self.file.get_batch)

    def _flat(self, k: int, column: int = 0) -> pa.Array:
        return self._batch(k).column(column).flatten()

    def sequence(self, row: int) -> np.ndarray:
        start = row % ROWS_PER_BATCH * self.width
        return self._flat(row // ROWS_PER_BATCH).to_numpy()[start:start + self.width]

    def mask(self, row: int) -> np.ndarray:
        start = row % ROWS_PER_BATCH * self.width
        return self._flat(row // ROWS_PER_BATCH, 1).slice(start, self.width).to_numpy(zero_copy_only=False)

    def document(self, start: int, size: int) -> Iterator[np.ndarray]:
        """The ids [start, start + size) as one view for each record batch that they touch."""
        while size > 0:
            k, at = divmod(start, self.per_batch)
            part = self._flat(k).to_numpy()[at:at + size]
            yield part
            start, size = start + len(part), size - len(part)


def with_global_start(index: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before it. Sums run over shards (a row a shard)."""
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return index.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def read_token_files(index: DataFrame) -> DataFrame:
    """Every indexed document read back from its file: doc, start, n_tokens, ids_crc32.

    The checksum covers the ids as little-endian unsigned 32-bit integers.
    """
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc", "start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, ShardReader] = {}
        for batch in batches:
            sums, counts = [], []
            for path, start, size in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if path not in readers:
                    readers = {path: ShardReader(path)}
                crc = n = 0
                for view in readers[path].document(start, size):
                    crc, n = zlib.crc32(view.astype("<u4").tobytes(), crc), n + len(view)
                sums.append(crc)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                names=schema.names)

    placed = with_global_start(index).select("doc", "path", "local_start", "n_tokens", "start")
    return placed.mapInArrow(run, schema)

