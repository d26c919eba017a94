"""Benchmark decontamination: n-gram seeds, the rarest first, then Smith-Waterman alignment.

Every n-gram of an item is a seed, however often it stands in the documents: no result depends
on frequencies. A seed in a document opens a window around the place where the item would lie;
windows that overlap are joined, and the local alignment of window and item (linear gaps) gives
the score: 1 for a whole exact copy, less for edited, paraphrased or partial ones.

The document frequency of every benchmark n-gram, counted over all documents, only orders the
work: windows with the rarest seed are aligned first, and one is left out where even all words
that it shares with the item would score below ``least`` or below the best alignment so far.

Words are runs of letters and digits, ASCII letters lowered, so punctuation and case don't
hide a copy. The benchmark is handled in blocks of at most ``BLOCK_WORDS`` words, each sent
to the tasks as arrays, one pass over the documents a block: what is broadcast is bounded
and nothing of the documents is shuffled but counts.

Defined results: null or empty documents and items match nothing; an item shorter than the
seed width is its own seed; repeated documents, items and ids each give their own rows;
null ids pass through; a benchmark or table without rows gives no rows. Texts are searched
whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, prefix_sums, range_hash, tidy, window_hashes

WIDTH, BLOCK_WORDS = 3, 500_000
#: Scores of the alignment: equal words, different words, a gap.
MATCH, MISMATCH, GAP = 2, -1, -1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IN_WORD = np.zeros(256, dtype=bool)
for _span in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100)):
    _IN_WORD[list(_span)] = True


def words(text: str | None) -> np.ndarray:
    """64-bit hash of each word."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    flags = np.zeros(len(raw) + 2, dtype=np.int8)
    flags[1:-1] = _IN_WORD[raw]
    edge = np.diff(flags)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    return range_hash(prefix_sums(byte_values(_LOWER[raw])), start, end)


def ngrams(hashes: np.ndarray, width: int) -> np.ndarray:
    return window_hashes(hashes, min(width, len(hashes))) if len(hashes) else hashes


class Items:
    """A block of benchmark items: their words, and every n-gram with the places it stands at."""

    def __init__(self, rows: list[tuple], width: int = WIDTH) -> None:
        self.ids = [r[0] for r in rows]
        self.words = [words(r[1]) for r in rows]
        self.width = width
        grams = [ngrams(w, width) for w in self.words]
        self.gram = np.concatenate([np.empty(0, np.uint64), *grams])
        self.item = np.repeat(np.arange(len(rows)), [len(g) for g in grams]).astype(np.int64)
        self.at = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]])
        # Only items that are shorter than the width have n-grams of another width.
        self.widths = sorted({min(width, len(w)) for w in self.words if len(w)})
        self.distinct = np.unique(self.gram)
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.at = (x[order] for x in (self.gram, self.item, self.at))
        self.frequency = np.zeros(len(self.gram), dtype=np.int64)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.end = np.cumsum(self.size)
        self.vocabulary, self.code = np.unique(np.concatenate([np.empty(0, np.uint64), *self.words]), return_inverse=True)

    def rank(self, frequency: np.ndarray) -> "Items":
        """Note how frequent each seed is, for the order of work."""
        self.frequency = frequency[np.searchsorted(self.distinct, self.gram)]
        return self

    def shared(self, which: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each item of ``which``, how large a part of its words stands anywhere in the document."""
        there = np.isin(self.vocabulary, doc)
        size, end = self.size[which], self.end[which]
        return np.add.reduceat(there[self.code[spread(end - size, end)]].astype(np.int64), np.cumsum(size) - size) / size


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [low, high), one range after the other."""
    n = high - low
    return np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())


def document_frequency(docs: DataFrame, text_col: str, items: Items) -> np.ndarray:
    """In how many documents each of the items' distinct n-grams stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(items.distinct), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                w = words(text.as_py())
                for width in items.widths:
                    grams = np.unique(window_hashes(w, width))
                    at = np.searchsorted(items.distinct, grams)
                    at[at == len(items.distinct)] = 0
                    seen[at[items.distinct[at] == grams]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["k", "n"])

    out = np.zeros(len(items.distinct), dtype=np.int64)
    if len(out):
        sums = docs.select(text_col).mapInArrow(tidy(run), "k long, n long").filter("n > 0").groupBy("k").agg(
            F.sum("n").alias("n")).toPandas()  # at most one row an n-gram of the block
        out[sums["k"]] = sums["n"]
    return out


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score as a share of the item's own, and the window's words [start, end)."""
    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        row = np.zeros(len(b) + 1, dtype=np.int64)
        step = GAP * np.arange(len(b) + 1)
        top = (0, 0, 0)
        for i, word in enumerate(a):
            new = np.maximum(0, row + GAP)
            new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == word, MATCH, MISMATCH))
            row = np.maximum.accumulate(new - step) + step  # gaps along the row
            j = int(row.argmax())
            if row[j] > top[0]:
                top = (int(row[j]), i + 1, j)
        return top

    score, i, end = best(item, window)
    if not score:
        return 0.0, 0, 0
    _, _, back = best(item[:i][::-1], window[:end][::-1])
    return score / (MATCH * len(item)), end - back, end


def common_words(item: np.ndarray, part: np.ndarray) -> float:
    """Words that item and part have in common, repeats counted, as a share of the item: no alignment scores more."""
    known, count = np.unique(item, return_counts=True)
    at = np.searchsorted(known, part)
    at[at == len(known)] = 0
    return np.minimum(count, np.bincount(at[known[at] == part], minlength=len(known))).sum() / len(item)


def insertions(size: int, least: float) -> int:
    """The most words that may stand between the words of an item whose alignment reaches ``least``."""
    return max(0, math.floor(MATCH * size * (1 - least) / -GAP + 1e-9))


def find(doc: np.ndarray, items: Items, least: float) -> list[tuple[int, float, int, int]]:
    """(item, score, start, end) of the best alignment of each item that reaches ``least``, the first of equal ones."""
    hits = []
    for width in items.widths:
        grams = window_hashes(doc, width)
        low, high = np.searchsorted(items.gram, grams, "left"), np.searchsorted(items.gram, grams, "right")
        k = spread(low, high)
        hits.append(np.stack([items.item[k], np.repeat(np.arange(len(grams)), high - low), items.at[k], items.frequency[k]])[
            :, np.minimum(items.width, items.size[items.item[k]]) == width])
    hits = np.concatenate(hits, axis=1) if hits else np.empty((4, 0), dtype=np.int64)
    found = np.unique(hits[0])
    if not len(found):
        return []
    hits = hits[:, np.isin(hits[0], found[items.shared(found, doc) >= least])]
    windows: dict[int, list[list[int]]] = {}
    for item, d, at, often in hits[:, np.lexsort(hits[2::-1])].T.tolist():
        size, more = len(items.words[item]), insertions(len(items.words[item]), least)
        start, end = max(0, d - at - more), min(len(doc), d - at + size + more + 1)
        spans = windows.setdefault(item, [])
        if spans and start <= spans[-1][1]:
            spans[-1][0], spans[-1][1], spans[-1][2] = min(start, spans[-1][0]), max(end, spans[-1][1]), min(often, spans[-1][2])
        else:
            spans.append([start, end, often])
    out = []
    for item, spans in windows.items():
        best = (0.0, 0, 0)
        for start, end, _ in sorted(spans, key=lambda x: x[2]):
            # A joined span may be long (an item copied over and over): aligned in overlapping parts.
            size = len(items.words[item])
            longest = size + insertions(size, least)
            for cut in range(start, end, 16 * size):
                part = doc[cut:min(end, cut + 16 * size + longest)]
                most = common_words(items.words[item], part)
                if most < least or most < best[0] or most == best[0] and cut >= best[1]:
                    continue
                score, a, b = align(items.words[item], part)
                if score >= least and (score > best[0] or score == best[0] and cut + a < best[1]):
                    best = (score, cut + a, cut + b)
        if best[2]:
            out.append((item, *best))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """id_col, item_id, score, first_word, end_word: the best alignment of each document and item
    that reaches ``least``. Word positions count from 0."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("item", benchmark.schema[item_id].dataType),
                           T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()),
                           T.StructField("end_word", T.LongType())])
    names = {"doc": id_col, "item": item_id}

    def run_with(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(k, *hit) for k, text in enumerate(batch.column(1)) for hit in find(words(text.as_py()), items, least)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                     pa.array([items.ids[r[1]] for r in rows], pa.from_numpy_dtype(np.int64) if isinstance(schema[1].dataType, T.LongType) else None),
                     *(pa.array([r[k] for r in rows], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))],
                    names=schema.names)
        return run

    rows = docs.select(F.col(id_col), F.col(text_col))
    bodies = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    total = bodies.agg(F.sum(F.octet_length("t"))).first()[0] or 0  # more bytes than twice the words
    blocks = max(1, -(-total // (2 * BLOCK_WORDS)))
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        pdf = bodies.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        items = Items([(r["i"], r["t"]) for r in pdf], width)
        if len(items.distinct):
            items.rank(document_frequency(rows, text_col, items))
            out = out.unionByName(rows.mapInArrow(tidy(run_with(items)), schema))
    return out.withColumnsRenamed(names)
