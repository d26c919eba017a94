"""Small helpers that the operators share: scratch tables, row keys and vectorised text hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlens.session import ensure_checkpoint_dir, remove_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/evlens-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost
    executor costs nothing but a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def unstore(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned, once nothing that is still to run reads them."""
    for table in tables:
        remove_folder(table.sparkSession, table.stored_at)


def null_safe_hash(*cols: Column, seed: int = 0) -> Column:
    """64-bit hash in which a null differs from every value and positions count."""
    parts: list[Column] = [F.lit(seed)]
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def row_key(*cols: Column) -> list[Column]:
    """128-bit content key of a row, as columns a and b: rows that agree in ``cols`` share it, nulls included."""
    return [null_safe_hash(*cols, seed=1).alias("a"), null_safe_hash(*cols, seed=2).alias("b")]


def release() -> None:
    """Hand freed memory back to the system: a Python worker lives on after its task, for other stages too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of an Arrow batch of texts, where the session sets no bound of its own.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches() -> None:
    """Bound the session's Arrow batches: Spark's own 64 MB stand several times in the executor
    (written, doubled while growing, read, returned) and again in each Python worker."""
    spark = SparkSession.active()
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def tidy(run):
    """The mapInArrow function ``run``, with ``release`` at the end of each task and bounded batches."""
    bound_batches()

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()
    return tidied


def pieces(batch: pa.RecordBatch, text: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each (one row at least)."""
    col = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(col) > start:
        yield batch.slice(start)


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = base
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
    return out


class PowerTable:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.fwd = powers(_MULT, 1 << 16)
        self.inv = powers(_MULT_INV, 1 << 16)

    def need(self, n: int) -> None:
        if n > len(self.fwd):
            size = 1 << (n - 1).bit_length()
            self.fwd, self.inv = powers(_MULT, size), powers(_MULT_INV, size)


_POWERS = PowerTable()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums: entry i covers values[:i]."""
    _POWERS.need(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * _POWERS.fwd[: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end) from the running sums; equal content, equal hash."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _POWERS.inv[start] + (end - start).astype(np.uint64) * _BYTE[7])


def gram_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """``range_hash`` of every ``width`` consecutive entries."""
    n = len(sums) - width
    with np.errstate(over="ignore"):
        return mix((sums[width:] - sums[:n]) * _POWERS.inv[:n] + np.uint64(width) * _BYTE[7])


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


# The word separators of the contracts: space, and tab to carriage return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't separators."""
    flags = np.empty(len(raw) + 2, dtype=np.int8)
    flags[0] = flags[-1] = 0
    flags[1:-1] = ~_SPACE[raw]
    edge = np.diff(flags)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of each word of a UTF-8 text."""
    start, end = word_bounds(raw)
    if not len(start):
        return np.empty(0, dtype=np.uint64), start, end
    return range_hash(prefix_sums(byte_values(raw)), start, end), start, end


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values (empty if there are fewer)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    start = np.arange(n)
    return range_hash(prefix_sums(values), start, start + width)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)


#: Bits of the fixed-size key filter (8 MB), whatever the number of keys.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, column: str):
    """A fixed-size filter over 64-bit keys: the returned function tells of a long column whether
    its value may be among them. It only spares a join's other side needless shuffling; with
    very many keys it lets everything pass, and the exact join decides either way."""
    from pyspark.sql import types as T
    from pyspark.sql.functions import arrow_udf

    def pack(pdf):
        import pandas as pd
        part = np.zeros(1 << 16, dtype=np.uint8)
        part[pdf["bit"].to_numpy() & 0xFFFF] = 1
        return pd.DataFrame({"part": pdf["part"][:1], "bits": [np.packbits(part).tobytes()]})

    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    bits = keys.select(bit.alias("bit")).distinct().withColumn("part", F.shiftright("bit", 16))
    table = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
    for row in bits.groupBy("part").applyInPandas(pack, "part long, bits binary").collect():  # 8 MB at most
        table[row["part"] << 13:(row["part"] + 1) << 13] = np.frombuffer(row["bits"], dtype=np.uint8)
    held = keys.sparkSession.sparkContext.broadcast(table)

    @arrow_udf(T.BooleanType())
    def may_hold(values: pa.Array) -> pa.Array:
        at = values.to_numpy(zero_copy_only=False) % FILTER_BITS
        return pa.array((held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return may_hold
