"""Hard negatives by exact integer scores, computed with Four-Russians tables.

Candidates are packed once: the B bit planes of a vector's integer components (two's
complement, the highest plane counts negative) become one byte for each plane and group of
eight dimensions. For a block of anchors, a table holds for every group the 256 sums of
subsets of its eight anchor components. A plane's share of the inner product is the sum of
one lookup a group, and the planes are joined by shift and add: full exact scores without a
multiplication.

Anchors are taken in blocks of about ``BLOCK`` rows (distinct rows dealt by hash, the sizes are
checked), whose vectors are broadcast; every block goes over all packed candidates twice, once
for the anchors' positives, once for the negatives in the range that the positives give. A
task keeps only the best few of each list and hands them on, so what is shuffled is the
number of lists times the number of tasks. Results are written block by block to the shared
folder; a lost executor costs its tasks of the block at hand.

Defined results: a row without an id, label or vector, or with a null or non-finite component,
takes no part; a shorter vector counts as padded with zeros, an empty one scores 0 everywhere;
anchors alike in id, label and vector are one anchor; every other row with the anchor's id is
no "other row"; repeated candidates take a place each; equal scores are ordered by id; a
positive with a negative score has no negatives (its range is empty); an empty table gives an
empty table. Components too large for exact 64-bit sums raise ``ValueError``. Further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path, stored

#: Anchors of one pass over the candidates, and of one set of tables in a worker's cache.
BLOCK, TABLE_ANCHORS = 2048, 128
#: Candidates scored at a time.
ROWS = 1024

PACKED = "id long, label long, planes binary"
FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("slot", "score", "id")])
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

#: Row k holds the bits of byte k, highest first: the first dimension of a group is the highest bit.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def quantise(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, or null if a component is null or not finite."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * F.lit(scale))))


def pack_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Bytes (row, plane, group) of integers (row, dimension); the number of dimensions is a multiple of eight."""
    bits = values[:, None, :] >> np.arange(planes, dtype=np.int64)[None, :, None] & 1
    return np.packbits(bits.astype(np.uint8), axis=2)


class SubsetTables:
    """The subset sums of a few anchors, and the scores of packed candidates against them."""

    def __init__(self, anchors: np.ndarray, planes: int) -> None:
        groups = anchors.shape[1] // 8
        bound = int(np.abs(anchors).max(initial=0)) * anchors.shape[1] << planes
        self.dtype = np.int32 if bound < 1 << 31 else np.int64
        self.table = np.ascontiguousarray(
            np.einsum("sd,agd->gsa", BITS, anchors.reshape(len(anchors), groups, 8)).astype(self.dtype))

    def scores(self, packed: np.ndarray) -> np.ndarray:
        """(candidates, anchors) inner products, from the highest plane down."""
        rows, planes, groups = packed.shape
        acc = np.zeros((rows, self.table.shape[2]), dtype=self.dtype)
        found = np.empty_like(acc)
        for b in range(planes - 1, -1, -1):
            np.left_shift(acc, 1, out=acc)
            for g in range(groups):
                np.take(self.table[g], packed[:, b, g], axis=0, out=found, mode="clip")
                (np.subtract if b == planes - 1 else np.add)(acc, found, out=acc)
        return acc


class BestOf:
    """The ``k`` best (score, then least id) of each list, over all that was offered."""

    def __init__(self, lists: int, k: int) -> None:
        self.k, self.least = k, np.full(lists, np.iinfo(np.int64).min)
        self.slot = self.score = self.id = np.empty(0, dtype=np.int64)

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = rank == self.k - 1
        self.least[slot[full]] = score[full]

    def offer_matrix(self, lists: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Offer the entries (candidate, column) that fit; column c belongs to list ``lists[c]``.

        Where many fit, a column's own k-th best goes first as a bound (entries equal to it stay).
        """
        fits &= scores >= self.least[lists]
        if np.count_nonzero(fits) > 4 * self.k * len(lists):
            part = np.where(fits, scores, np.iinfo(scores.dtype).min)
            fits &= scores >= np.partition(part, len(part) - self.k, axis=0)[len(part) - self.k]
        row, col = np.nonzero(fits)
        self.offer(lists[col], scores[row, col].astype(np.int64), ids[row])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.slot, self.score, self.id)], names=FOUND.names)


def packed_candidates(rows: DataFrame, dims: int, planes: int) -> DataFrame:
    """(id, label, planes) of rows (id, label, q)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                planed = pack_planes(dense(part.column(2), dims), planes)
                data = pa.array([x.tobytes() for x in planed], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), data], names=["id", "label", "planes"])

    return rows.select("id", "label", "q").mapInArrow(run, PACKED)


def dense(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows of ``dims`` numbers, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), dtype=np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def scored(packed: DataFrame, anchors: np.ndarray, labels: np.ndarray, planes: int, k: int, lists_of) -> DataFrame:
    """The best ``k`` entries of each list, of every task: (slot, score, id).

    ``lists_of(lo, hi, scores, same)`` gives for the anchors [lo, hi) pairs (list numbers, their
    columns of the scores, which entries fit).
    """
    spark = packed.sparkSession
    held = spark.sparkContext.broadcast((anchors, labels))
    groups, lists = anchors.shape[1] // 8, lists_of.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, labelled = held.value
        cuts = range(0, len(vectors), TABLE_ANCHORS)
        tables = [SubsetTables(vectors[lo:lo + TABLE_ANCHORS], planes) for lo in cuts]
        best = BestOf(lists, k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column(0).to_numpy()
                own = part.column(1).to_numpy()
                planed = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint8)
                planed = planed.reshape(len(ids), planes, groups)
                for lo, table in zip(cuts, tables):
                    hi = min(lo + TABLE_ANCHORS, len(vectors))
                    scores = table.scores(planed)
                    same = own[:, None] == labelled[None, lo:hi]
                    for slots, cols, fits in lists_of(lo, hi, scores, same, ids):
                        best.offer_matrix(slots, scores[:, cols], fits, ids)
        yield best.batch()

    return packed.mapInArrow(run, FOUND)


class PositiveLists:
    """One list an anchor: rows of its label with another id."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.size = ids, len(ids)

    def __call__(self, lo, hi, scores, same, ids):
        yield np.arange(lo, hi), np.arange(hi - lo), same & (ids[:, None] != self.ids[None, lo:hi])


class NegativeLists:
    """One list a positive: rows of another label whose score lies within the positive's range."""

    def __init__(self, anchor: np.ndarray, score: np.ndarray, low: int, high: int) -> None:
        self.order = np.argsort(anchor, kind="stable")
        self.anchor, self.size = anchor[self.order], len(anchor)
        score = score[self.order]
        self.least, self.most = -(-low * score // 100), high * score // 100

    def __call__(self, lo, hi, scores, same, ids):
        start, end = np.searchsorted(self.anchor, (lo, hi))
        of = self.anchor[start:end]
        turn = np.arange(start, end) - np.searchsorted(self.anchor, of)  # first, second, ... positive of its anchor
        for r in range(turn.max(initial=-1) + 1):
            at = np.flatnonzero(turn == r) + start
            cols = self.anchor[at] - lo
            part = scores[:, cols]
            yield self.order[at], cols, ~same[:, cols] & (part >= self.least[at]) & (part <= self.most[at])


def top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each list over all tasks, with ``rank`` from 1."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, block: int = BLOCK, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "q") -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of the same label: the best
    ``negatives`` rows of other labels with low*p <= 100*n <= high*p for the scores p and n.

    ``rows`` has integer vectors (``quantise``); ``is_anchor`` is a condition on its columns.
    """
    spark = rows.sparkSession
    part = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                       F.col(vector_col).cast("array<long>").alias("q"), is_anchor.alias("is_anchor"))
    part = part.filter("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL AND NOT exists(q, x -> x IS NULL)")
    part = stored(part, "vectors")
    longest, least, most, count = part.agg(
        F.max(F.size("q")), F.min(F.array_min("q")), F.max(F.array_max("q")),
        F.count_if("is_anchor")).first()
    if not count:
        return spark.createDataFrame([], RESULT)
    dims, least, most = max(8, -(-longest // 8) * 8), least or 0, most or 0
    planes = max(int(least).bit_length(), int(most).bit_length()) + 1
    if planes * 2 + int(dims).bit_length() > 62:
        raise ValueError(f"components from {least} to {most} are too large for exact 64-bit scores")
    packed = stored(packed_candidates(part, dims, planes), "planes")
    n = -(-count // block)
    anchors = stored(part.filter("is_anchor").select("id", "label", "q").distinct().withColumn(
        "block", F.pmod(F.xxhash64("id", "label", "q"), F.lit(n))), "anchors")
    target = scratch_path(spark, "hard-negatives")
    for b in range(n):  # each block is a pass over all candidates; what comes here is a block
        mine = anchors.filter(F.col("block") == b).orderBy("id", "label", "q").limit(4 * block + 1).toArrow()
        if mine.num_rows > 4 * block:
            raise ValueError(f"an anchor block holds more than {4 * block} rows")
        if mine.num_rows:
            _block(packed, mine, dims, planes, positives, negatives, low, high).write.mode("append").parquet(target)
    return spark.read.schema(RESULT).parquet(target)


def _block(packed: DataFrame, mine: pa.Table, dims: int, planes: int, positives: int, negatives: int, low: int,
           high: int) -> DataFrame:
    spark = packed.sparkSession
    ids, labels = (mine.column(i).to_numpy() for i in (0, 1))
    vectors = dense(mine.column(2).combine_chunks(), dims)
    best = top(scored(packed, vectors, labels, planes, positives, PositiveLists(ids)), positives).orderBy(
        "slot", "rank").select("slot", "score", "id").toArrow()  # at most ``positives`` a row of the block
    if not best.num_rows:
        return spark.createDataFrame([], RESULT)
    slot, score, other = (c.to_numpy() for c in best.columns)
    negative = top(scored(packed, vectors, labels, planes, negatives, NegativeLists(slot, score, low, high)), negatives)
    chosen = spark.createDataFrame(pa.table({
        "slot": np.arange(len(slot)), "anchor_id": ids[slot], "positive_id": other, "positive_score": score}))
    return negative.join(F.broadcast(chosen), "slot").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
