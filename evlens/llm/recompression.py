"""Long word sequences that repeat anywhere in a corpus, found by recompression.

Each document's words are parsed in rounds that depend on content alone: runs of one symbol
become a symbol, then pairs whose first symbol is "left" and whose second is "right" by a
bit of their names become a symbol. A symbol's name is a hash of its parts, so equal
stretches get equal names wherever they stand. With each symbol goes its context, the words
that its formation depended on: if a window holds a symbol's context, every equal window
holds the same symbol at the same place.

1. Symbols of level ``HIGH`` are named over the whole corpus by Spark; where a window holds
   none, those of level ``LOW``. A window that holds a symbol which stands only once can't
   repeat. What is left are candidates.
2. Candidates are verified: their 128-bit window hashes are grouped over the corpus.
3. Words covered by a window that occurs more than once are removed.

Both groupings keep only counts and, of what stands once, its place, combined before the
shuffle: a passage that a third of all documents share stays one row a task. Text is
shuffled only for the documents that have candidates (a fixed-size key filter drops most
others before the join).

Defined results: null texts have no words; texts shorter than a window lose nothing; equal
rows are documents of their own and remove each other's windows; ids may be null or repeat;
an empty table gives an empty table. Texts of any length are parsed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_filter, mix, pieces, row_key, stored, window_hashes, word_hashes

WIDTH, LOW, HIGH = 35, 5, 7
_K = np.uint64(0x9E3779B97F4A7C15)


class Symbols:
    """Symbols in text order: name, word span [start, end) and context [left, right)."""

    def __init__(self, name, left, right, wall):
        self.name, self.left, self.right, self.wall = name, left, right, wall

    @classmethod
    def words(cls, hashes: np.ndarray, wall: np.ndarray) -> Symbols:
        at = np.arange(len(hashes))
        return cls(hashes, at, at + 1, wall)

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Left context of the symbol before, right context of the one behind; outside at the ends."""
        return (np.concatenate([[-1], self.left[:-1]]),
                np.concatenate([self.right[1:], [self.right[-1] + 1]]))

    def runs(self) -> Symbols:
        """Every maximal run becomes one symbol; that it ended there depends on both neighbours."""
        first = np.empty(len(self.name), dtype=bool)
        first[0] = True
        np.not_equal(self.name[1:], self.name[:-1], out=first[1:])
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(first)) - 1
        count = (last - at + 1).astype(np.uint64)
        before, behind = self._neighbours()
        with np.errstate(over="ignore"):
            name = np.where(count > 1, mix(self.name[at] * _K + count), self.name[at])
        return Symbols(name, before[at], behind[last], self.wall[at])

    def pairs(self, level: int) -> Symbols:
        """Left symbols join a right symbol behind them; a symbol left alone depends on the
        neighbour that it could have joined."""
        with np.errstate(over="ignore"):
            bit = (mix(self.name + np.uint64(level) * _K) >> np.uint64(17)) & np.uint64(1) == 1
            is_left, is_right = ~bit & ~self.wall, bit & ~self.wall
            head = np.zeros(len(bit), dtype=bool)
            head[:-1] = is_left[:-1] & is_right[1:]
            tail = np.concatenate([[False], head[:-1]])
            before, behind = self._neighbours()
            alone = ~head & ~tail
            left = np.where(alone & is_right, before, self.left)
            right = np.where(head | (alone & is_left), behind, self.right)
            at = np.flatnonzero(head)
            name = self.name.copy()
            name[at] = mix(self.name[at] * _K + mix(self.name[at + 1]))
        keep = ~tail
        return Symbols(name[keep], left[keep], right[keep], self.wall[keep])


class Parsed:
    """The symbols of a slice of documents that decide about their windows."""

    def __init__(self, texts: list[bytes], width: int = WIDTH, low: int = LOW, high: int = HIGH) -> None:
        self.width = width
        hashes = [word_hashes(np.frombuffer(t, dtype=np.uint8))[0] for t in texts]
        self.counts = np.array([len(h) for h in hashes], dtype=np.int64)
        self.first = np.cumsum(self.counts + 1) - self.counts  # a wall stands before each document
        wall = np.zeros(int((self.counts + 1).sum()), dtype=bool)
        wall[self.first - 1] = True
        joined = np.zeros(len(wall), dtype=np.uint64)
        joined[~wall] = np.concatenate(hashes) if hashes else []
        joined[wall] = mix(np.arange(len(texts), dtype=np.uint64) * _K + np.uint64(1))
        self.hashes, self.wall = hashes, wall
        # Windows start where no wall stands within their width.
        walls = np.concatenate([[0], np.cumsum(wall)])
        n = max(0, len(wall) - width + 1)
        self.valid = walls[width:width + n] - walls[:n] == 0
        symbols = Symbols.words(joined, wall)
        for level in range(1, high + 1):
            if level == 1:
                symbols = symbols.runs()
            symbols = symbols.pairs(level)
            if level == low:
                low_ones = self._usable(symbols)
        high_ones = self._usable(symbols)
        self.bare = self.valid & (self._cover(*high_ones[1:]) == 0)  # windows without a high symbol
        bare_before = np.concatenate([[0], np.cumsum(self.bare)])
        name, lo, hi = low_ones
        needed = bare_before[hi + 1] > bare_before[lo]
        low_ones = tuple(x[needed] for x in low_ones)
        kind = np.concatenate([np.ones(len(high_ones[0]), bool), np.zeros(len(low_ones[0]), bool)])
        name, lo, hi = (np.concatenate(p) for p in zip(high_ones, low_ones))
        doc = np.searchsorted(self.first, lo, side="right") - 1
        order = np.argsort(doc, kind="stable")
        self.name, self.lo, self.hi, self.high, self.doc = (x[order] for x in (name, lo, hi, kind, doc))

    def _usable(self, s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Name, first and last start of the windows that hold the symbol's context."""
        lo, hi = np.maximum(s.right - self.width, 0), np.minimum(s.left, len(self.valid) - 1)
        good = ~s.wall & (s.left >= 0) & (lo <= hi)
        name, lo, hi, left = s.name[good], lo[good], hi[good], s.left[good]
        starts = np.concatenate([[0], np.cumsum(self.valid)])
        good = starts[hi + 1] > starts[lo]
        # Starts before the document's first word aren't valid; keep the span inside it.
        doc = np.searchsorted(self.first, left[good], side="right") - 1
        lo, hi = np.maximum(lo[good], self.first[doc]), np.minimum(hi[good], self.first[doc] + self.counts[doc] - self.width)
        inside = lo <= hi
        return name[good][inside], lo[inside], hi[inside]

    def _cover(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of the spans of starts [lo, hi] hold each window start."""
        n = len(self.valid)
        return np.cumsum(np.bincount(lo, minlength=n + 1)[:n + 1] - np.bincount(hi + 1, minlength=n + 1)[:n + 1])[:n]


def candidate_starts(n_words: int, lo: np.ndarray, hi: np.ndarray, high: np.ndarray, single: np.ndarray, bare: np.ndarray,
                     width: int) -> np.ndarray:
    """Which windows of one document hold no symbol that stands only once."""
    n = n_words - width + 1
    out = np.ones(max(n, 0), dtype=bool)
    for kind in (True, False):
        mine = single[high[single] == kind]
        held = np.cumsum(np.bincount(lo[mine], minlength=n + 1) - np.bincount(hi[mine] + 1, minlength=n + 1))[:n] > 0
        out &= ~held | (bare if kind else ~bare)
    return out


def parse(docs: DataFrame, id_col: str, text_col: str, width: int, low: int, high: int) -> DataFrame:
    """One row a document: its key, words, digest of all words, symbol names and their windows."""
    schema = ("id " + docs.schema[id_col].dataType.simpleString() + ", a long, b long, n_words long, sha string, "
              "names array<long>, lo binary, hi binary, high binary, bare binary")
    cols = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 3, 1 << 20):
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(3)]
                p = Parsed(texts, width, low, high)
                cut = np.searchsorted(p.doc, np.arange(len(texts) + 1))
                spans = [slice(a, b) for a, b in zip(cut, cut[1:])]
                firsts = p.first.tolist()
                sizes = np.maximum(p.counts - width + 1, 0).tolist()
                offsets = pa.array(cut.astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array(p.counts),
                    pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]),
                    pa.ListArray.from_arrays(offsets, pa.array(p.name.view(np.int64))),
                    pa.array([(p.lo[s] - f).astype("<i4").tobytes() for s, f in zip(spans, firsts)], pa.binary()),
                    pa.array([(p.hi[s] - p.lo[s]).astype("u1").tobytes() for s in spans], pa.binary()),
                    pa.array([np.packbits(p.high[s]).tobytes() for s in spans], pa.binary()),
                    pa.array([np.packbits(p.bare[f:f + n]).tobytes() for f, n in zip(firsts, sizes)], pa.binary())], names=cols)

    key = row_key(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), *key, F.col(text_col).alias("body")).mapInArrow(run, schema)


def candidates(parsed: DataFrame, width: int) -> DataFrame:
    """(row, a, b, starts): packed flags of the windows of each document that may repeat."""
    places = parsed.select("row", F.posexplode("names").alias("pos", "name"))
    once = places.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("pos").alias("pos")).filter("n = 1")
    single = once.groupBy("row").agg(F.collect_list("pos").alias("single"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (n, lo, hi, high, bare, single) in enumerate(zip(*(c.to_pylist() for c in batch.columns[3:9]))):
                lo = np.frombuffer(lo, dtype="<i4").astype(np.int64)
                hi = lo + np.frombuffer(hi, dtype="u1")
                flags = candidate_starts(
                    n, lo, hi, np.unpackbits(np.frombuffer(high, np.uint8))[:len(lo)].astype(bool),
                    np.array(single or [], dtype=np.int64), np.unpackbits(np.frombuffer(bare, np.uint8))[:n - width + 1].astype(bool), width)
                if flags.any():
                    out.append((k, np.packbits(flags).tobytes()))
            take = pa.array([k for k, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)), pa.array([f for _, f in out], pa.binary())],
                                             names=["row", "a", "b", "starts"])

    rows = parsed.filter(F.col("n_words") >= width).select("row", "a", "b", "n_words", "lo", "hi", "high", "bare")
    return rows.join(single, "row", "left").mapInArrow(run, "row long, a long, b long, starts binary")


def _with_text(docs: DataFrame, table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The table's rows with their documents' text, joined by the documents' content key."""
    may_hold = key_filter(table.select("a").distinct(), "a")
    key = row_key(F.col(id_col), F.col(text_col))
    texts = docs.select(*key, F.col(text_col).alias("body")).filter(may_hold("a"))
    return table.join(texts.dropDuplicates(["a", "b"]), ["a", "b"])


def repeated(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(row, a, b, starts): the candidates whose window really occurs more than once."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, 1 << 20):
                cols: list[list] = [[], [], [], []]
                for row, starts, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    words = word_hashes(np.frombuffer(text.as_buffer(), dtype=np.uint8))[0]
                    n = len(words) - width + 1
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(starts, np.uint8))[:n])
                    with np.errstate(over="ignore"):
                        other = mix(words + _K)
                    for c, x in zip(cols, (window_hashes(words, width)[at], window_hashes(other, width)[at], np.full(len(at), row), at)):
                        c.append(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["h", "g", "row", "pos"])

    windows = _with_text(docs, found, id_col, text_col).select("row", "starts", "body").mapInArrow(
        hashes, "h long, g long, row long, pos long")
    once = windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("pos").alias("pos")).filter("n = 1")
    single = once.groupBy("row").agg(F.collect_list("pos").alias("single"))

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts, single in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                flags = np.unpackbits(np.frombuffer(starts, np.uint8))
                flags[single or []] = 0
                out.append(np.packbits(flags).tobytes() if flags.any() else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["row", "a", "b", "starts"])

    return found.join(single, "row", "left").mapInArrow(clear, found.schema).filter("starts is not null")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, low: int = LOW,
                   high: int = HIGH) -> DataFrame:
    """id_col, n_words, n_removed, kept (the words left, joined by one space; null if all are) and kept_sha256."""
    parsed = stored(parse(docs, id_col, text_col, width, low, high).withColumn("row", F.monotonically_increasing_id()), "parsed")
    found = stored(candidates(parsed, width), "candidates")
    again = stored(repeated(docs, found, id_col, text_col, width), "repeated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                all_words = text.as_buffer().to_pybytes().split()
                flags = np.unpackbits(np.frombuffer(starts, np.uint8))[:len(all_words) - width + 1].astype(np.int64)
                change = np.zeros(len(all_words) + 1, dtype=np.int64)
                change[:len(flags)] += flags
                change[width:width + len(flags)] -= flags
                gone = np.cumsum(change)[:-1] > 0
                kept = b" ".join([all_words[i] for i in np.flatnonzero(~gone)])
                out.append((int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
            removed, kept, sha = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())],
                                             names=["row", "removed", "kept", "kept_sha"])

    changed = _with_text(docs, again, id_col, text_col).select("row", "starts", "body").mapInArrow(
        cut, T.StructType([T.StructField("row", T.LongType()), T.StructField("removed", T.LongType()),
                           T.StructField("kept", T.StringType()), T.StructField("kept_sha", T.StringType())]))
    return parsed.select("row", "id", "n_words", "sha").join(changed, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("removed", F.lit(0)).alias("n_removed"), "kept",
        F.coalesce("kept_sha", "sha").alias("kept_sha256"))
