"""Bytes that repeat an earlier 100-byte string, by a difference cover of sampled suffixes.

The suffixes that start at a cover position (position in the text modulo ``PERIOD`` in
``COVER``, a perfect difference set) are enough to compare any two: whatever two places i and
j, some shift below PERIOD brings both onto the cover. So only sampled suffixes are grouped, by
hashes of their first bytes and of their surroundings; equality is all that is asked, so nothing
is sorted or ranked. All of it runs on what is left after two exact screens:

1. Equal texts count once; a later copy of 100 bytes or more loses every byte.
2. Each 100-byte window's least hashed ``GRAM``-gram is named over the corpus; a window whose
   name stands in one place only can't repeat.
3. Of the windows left, the suffixes on the cover are bucketed by their first
   width - PERIOD + 1 bytes. Buckets with a single suffix are done; within the others the
   suffixes are told apart by the bytes around them that any window over them can reach. A suffix that isn't the first with its surroundings repeats them:
   all its windows go. If a bucket has one kind of surroundings only, its first suffix's
   windows have no partner there.
4. What is then undecided are windows at the edges of repeats. Those over one suffix are taken in
   four ranges of starts; the bytes that all windows of a range share are named over the corpus,
   and a range whose name stands once is done. The rest is settled by whole 128-bit hashes.

Every grouping keeps counts and least places only, combined before the shuffle, so a
passage in a third of all texts is one row a task and no bucket is collected. Text moves
only for the documents that still have open windows.

Defined results: null counts as empty; order is by id (nulls first), then start; rows that
share id and text get one result; of texts that share an id the 64-bit text key decides
the order; an empty table gives an empty table; texts of any length are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, gram_hashes, key_filter, mix, pieces, prefix_sums, range_hash, row_key, stored, unstore

WIDTH, GRAM = 100, 48
# A perfect difference set modulo 57.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
_ON_COVER = np.isin(np.arange(PERIOD), COVER)
_SLICE = 1 << 18
_BYTE_VALUES = (byte_values(np.arange(256)), mix(byte_values(np.arange(256))))
BUCKET_BITS = 48
_REST = np.uint64((1 << 64 - BUCKET_BITS) - 1)
# The starts of the windows over a suffix, as ranges of their distance before it.
NEAREST, FARTHEST = np.array([0, 14, 28, 42]), np.array([13, 27, 41, PERIOD - 1])
RANGES = len(NEAREST)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(raw: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, name, first and last window start) of each least gram, over joined texts."""
    empty = np.empty(0, dtype=np.int64)
    if len(raw) < width:
        return empty, empty.astype(np.uint64), empty, empty
    names = gram_hashes(prefix_sums(byte_values(raw)), gram)
    low = np.uint64(0xFFFFFFFF)
    least = (sliding_min((names & ~low) | np.arange(len(names), dtype=np.uint64), width - gram + 1) & low).astype(np.int64)
    windows = np.maximum(sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(len(doc)) + np.repeat(firsts - (np.cumsum(windows) - windows), windows)
    least = least[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    base = firsts[doc[head]]
    return doc[head], names[least[head]], start[head] - base, start[tail[:len(head)]] - base


def _places(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct names and where each stands, -1 if in several places."""
    distinct, at, count = np.unique(names, return_index=True, return_counts=True)
    return distinct, np.where(count > 1, -1, at).astype(np.int32)


def parse(docs: DataFrame, id_col: str, text_col: str, width: int, gram: int) -> DataFrame:
    """One row a document: text key, bytes, digest, and its windows' names."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("names", T.ArrayType(T.LongType())),
        T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("lo", T.BinaryType()), T.StructField("span", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 3, _SLICE):
                texts = [t.as_buffer().to_pybytes() for t in part.column(3)]
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                firsts = np.cumsum(sizes) - sizes
                # An empty text starts where the next one does: the last of equal starts owns the bytes.
                doc, name, lo, hi = anchors(np.frombuffer(b"".join(texts), dtype=np.uint8), firsts, sizes, width, gram)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                spans = [slice(x, y) for x, y in zip(cut, cut[1:])]
                once = [_places(name[s]) for s in spans]
                yield pa.RecordBatch.from_arrays([
                    *(part.column(i) for i in range(3)), pa.array(sizes), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.array([n.view(np.int64) for n, _ in once], pa.list_(pa.int64())),
                    pa.array([at for _, at in once], pa.list_(pa.int32())),
                    pa.array([lo[s].astype("<i4").tobytes() for s in spans], pa.binary()),
                    pa.array([(hi[s] - lo[s]).astype("u1").tobytes() for s in spans], pa.binary())], names=schema.names)

    return _keyed(docs, id_col, text_col).mapInArrow(run, schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), *row_key(body), body.alias("body"))


def _flags(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, dtype=np.uint8))


def _pack(flags: np.ndarray) -> bytes | None:
    return np.packbits(flags).tobytes() if flags.any() else None


def _spread(at: np.ndarray, reach: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie within [at, at + reach] of any given place."""
    stop = np.minimum(at + reach, n - 1) + 1
    return np.cumsum(np.bincount(np.maximum(at, 0), minlength=n + 1)[:n + 1] - np.bincount(stop, minlength=n + 1)[:n + 1])[:n] > 0


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's list of numbers (null: empty)."""
    values, cut = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[x:y] if ok else values[:0] for x, y, ok in zip(cut, cut[1:], column.is_valid().to_pylist())]


def open_windows(parsed: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(first_id, a, b, n, open): packed flags of the windows whose name stands in several places."""
    places = parsed.select("a", F.explode(F.arrays_zip("names", "places")).alias("x")).select("a", "x.names", "x.places")
    once = places.groupBy("names").agg(F.min("a").alias("a"), F.max("a").alias("z"), F.min("places").alias("pos"))
    single = once.filter("a = z and pos >= 0").groupBy("a").agg(F.collect_list("pos").alias("single"))
    schema = T.StructType([*texts.select("first_id", "a", "b", "n").schema.fields, T.StructField("open", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, lo, span, single in zip(*(batch.column(i).to_pylist() for i in range(3, 6)), _lists(batch.column(6))):
                lo = np.frombuffer(lo, dtype="<i4").astype(np.int64)
                many = np.ones(len(lo), dtype=bool)
                many[single] = False
                out.append(_pack(_spread(lo[many], np.frombuffer(span, dtype="u1")[many], n - width + 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=schema.names)

    rows = texts.filter(F.col("n") >= width).join(single, "a", "left").select("first_id", "a", "b", "n", "lo", "span", "single")
    return rows.mapInArrow(run, schema).filter("open is not null")


def _with_text(docs: DataFrame, table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    may_hold = key_filter(table.select("a").distinct(), "a")
    texts = _keyed(docs, id_col, text_col).select("a", "b", "body").filter(may_hold("a")).dropDuplicates(["a", "b"])
    return table.join(texts, ["a", "b"])


def samples(flags: np.ndarray, n: int, width: int) -> np.ndarray:
    """Cover positions that lie within a period of an open window's start."""
    reach = _spread(np.flatnonzero(flags), PERIOD - 1, n)
    on = np.resize(_ON_COVER, n)
    on[max(0, n - (width - PERIOD + 1) + 1):] = False
    return np.flatnonzero(reach & on)


def _rows_of(texts: DataFrame, flags: str, rows, hashes: list[str], *more: str) -> DataFrame:
    """What ``rows`` makes of each text: hashes and positions, with the text's id and key. It takes
    the running sums of one hash family for one hash, of two for two. ``more``
    are columns of position lists that ``rows`` takes besides (null: none)."""
    families = min(len(hashes), 2)
    schema = T.StructType([*(T.StructField(h, T.LongType()) for h in hashes), T.StructField("first_id", texts.schema["first_id"].dataType),
                           T.StructField("a", T.LongType()), T.StructField("pos", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 3, _SLICE):
                found = []
                lists = [_lists(part.column(4 + k)) for k in range(len(more))]
                for packed, text, *places in zip(part.column(2).to_pylist(), part.column(3), *lists):
                    raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                    sums = [prefix_sums(v[raw]) for v in _BYTE_VALUES[:families]]
                    found.append(rows(_flags(packed), len(raw), *sums, *places))
                row = pa.array(np.repeat(np.arange(len(found)), [len(f[-1]) for f in found]))
                cols = [np.concatenate(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c.view(np.int64)) for c in cols[:-1]), part.column(0).take(row), part.column(1).take(row), pa.array(cols[-1])],
                    names=schema.names)

    return texts.select("first_id", "a", flags, "body", *more).mapInArrow(run, schema)


def lonely(open_texts: DataFrame, width: int) -> DataFrame:
    """(a, lone): the places of each text's sampled suffixes that are alone in their bucket."""
    def rows(flags: np.ndarray, n: int, one: np.ndarray) -> tuple:
        p = samples(flags[:n - width + 1], n, width)
        names, at = _places(range_hash(one, p, p + width - PERIOD + 1))
        return names, np.where(at < 0, -1, p[at]).astype(np.int64)

    once = _rows_of(open_texts, "open", rows, ["name"]).groupBy("name").agg(
        F.count(F.lit(1)).alias("m"), F.min("a").alias("a"), F.min("pos").alias("pos")).filter("m = 1 and pos >= 0")
    return once.groupBy("a").agg(F.collect_list("pos").alias("lone"))


def sampled_suffixes(open_texts: DataFrame, width: int) -> DataFrame:
    """(g, h, first_id, a, pos): 128-bit name and place of each sampled suffix whose bucket has
    others, of those that a text repeats itself the first. The upper BUCKET_BITS of g are the
    bucket's, all other bits the surroundings': two buckets that share their bits are taken for
    one, which leaves more windows to the whole hashes and changes no result."""
    def rows(flags: np.ndarray, n: int, one: np.ndarray, two: np.ndarray, lone: np.ndarray) -> tuple:
        p = np.setdiff1d(samples(flags[:n - width + 1], n, width), lone, assume_unique=True)
        low, high = np.maximum(p - PERIOD + 1, 0), np.minimum(p + width, n)
        with np.errstate(over="ignore"):  # where the text ends inside the reach, its ends are part of the surroundings
            shape = mix(((p - low) * 256 + (high - p)).astype(np.uint64))
            g, h = range_hash(one, low, high) ^ shape, range_hash(two, low, high) + shape
        g = (range_hash(one, p, p + width - PERIOD + 1) & ~_REST) | (g & _REST)
        order = np.argsort(g, kind="stable")  # places ascend; h only tells neighbours of one g apart
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(g[order].view(np.int64)) != 0) | (np.diff(h[order].view(np.int64)) != 0)
        keep = order[new]
        return g[keep], h[keep], p[keep]

    return _rows_of(open_texts, "open", rows, ["g", "h"], "lone")


def ranges_of(flags: np.ndarray, loud: np.ndarray) -> np.ndarray:
    """Codes (place * RANGES + range) of the ranges of starts that hold a flagged window."""
    code = (loud.astype(np.int64)[:, None] * RANGES + np.arange(RANGES)).ravel()
    first, last = starts_of(code, len(flags))
    total = np.concatenate(([0], np.cumsum(flags)))
    some = first <= last
    some[some] = total[last[some] + 1] > total[first[some]]
    return code[some]


def starts_of(code: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of m window starts in each range."""
    p, k = np.divmod(code, RANGES)
    return np.maximum(p - FARTHEST[k], 0), np.minimum(p - NEAREST[k], m - 1)


def settled_ranges(texts: DataFrame, width: int) -> DataFrame:
    """(a, single): codes of the ranges whose windows share bytes that stand nowhere else."""
    def rows(flags: np.ndarray, n: int, one: np.ndarray, loud: np.ndarray) -> tuple:
        code = ranges_of(flags[:n - width + 1], loud)
        p, k = np.divmod(code, RANGES)
        names, at = _places(range_hash(one, p - NEAREST[k], p + width - FARTHEST[k]) ^ mix(k.astype(np.uint64) + np.uint64(1)))
        return names, np.where(at < 0, -1, code[at]).astype(np.int64)

    once = _rows_of(texts, "undecided", rows, ["name"], "loud").groupBy("name").agg(
        F.count(F.lit(1)).alias("m"), F.min("a").alias("a"), F.min("pos").alias("pos")).filter("m = 1 and pos >= 0")
    return once.groupBy("a").agg(F.collect_list("pos").alias("single"))


def narrow(state: DataFrame, singles: DataFrame, width: int) -> DataFrame:
    """``state`` without the undecided windows of settled ranges."""
    names = ["a", "b", "first_id", "n", "removed", "undecided"]
    schema = T.StructType([state.schema[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, packed, loud, single in zip(*(batch.column(i).to_pylist() for i in (3, 5)), *(_lists(batch.column(i)) for i in (6, 7))):
                m = n - width + 1
                if packed is not None:
                    flags = _flags(packed)[:m].astype(bool)
                    open_ranges = np.setdiff1d(ranges_of(flags, loud), single, assume_unique=True)
                    packed = _pack(flags & _between(*starts_of(open_ranges, m), m))
                out.append(packed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=names)

    return state.join(singles, "a", "left").select(*names, "loud", "single").mapInArrow(run, schema)


def whole_windows(texts: DataFrame, width: int) -> DataFrame:
    """(g, h, first_id, a, pos): 128-bit hash and place of each undecided window."""
    def rows(flags: np.ndarray, n: int, one: np.ndarray, two: np.ndarray) -> tuple:
        at = np.flatnonzero(flags[:n - width + 1])
        return range_hash(one, at, at + width), range_hash(two, at, at + width), at

    return _rows_of(texts, "undecided", rows, ["g", "h"])


def _first(rows: DataFrame, *key: str) -> DataFrame:
    """The least place (by id, then text key, then position) of each key."""
    return rows.groupBy(*key).agg(F.min(F.struct("first_id", "a", "pos")).alias("place"))


def decide(found: DataFrame, firsts: DataFrame, calm: DataFrame, width: int) -> DataFrame:
    """``found`` (its last column the lone places) with removed and undecided, packed flags of windows,
    and loud, the places whose windows are undecided."""
    schema = T.StructType([*found.schema.fields, T.StructField("removed", T.BinaryType()), T.StructField("undecided", T.BinaryType()),
                           T.StructField("loud", T.ArrayType(T.IntegerType()))])
    at = [found.columns.index(c) for c in ("n", "open")]
    k = len(found.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, left, at_edges = [], [], []
            lists = [_lists(batch.column(i)) for i in (k - 1, k, k + 1)]
            for n, flags, lone, first, quiet in zip(*(batch.column(i).to_pylist() for i in at), *lists):
                flags = _flags(flags)[:n - width + 1].astype(bool)
                p = np.setdiff1d(samples(flags, n, width), lone, assume_unique=True)
                mine = np.isin(p, first)
                again = p[~mine]
                loud = p[mine & ~np.isin(p, quiet)]
                m = len(flags)
                # Windows over a sample start up to PERIOD - 1 before it.
                removed = flags & _spread_back(again, m)
                gone.append(_pack(removed))
                left.append(_pack(flags & ~removed & _spread_back(loud, m)))
                at_edges.append(None if left[-1] is None else loud.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(gone, pa.binary()), pa.array(left, pa.binary()),
                                              pa.array(at_edges, pa.list_(pa.int32()))], names=schema.names)

    lists = firsts.groupBy("a").agg(F.collect_list("pos").alias("first")).join(
        calm.groupBy("a").agg(F.collect_list("pos").alias("quiet")), "a", "left")
    return found.join(lists, "a", "left").select(*found.columns, "first", "quiet").mapInArrow(run, schema)


def _spread_back(p: np.ndarray, m: int) -> np.ndarray:
    """Which of m window starts lie within [p - PERIOD + 1, p] of a sample."""
    return _between(np.maximum(p - PERIOD + 1, 0), np.minimum(p, m - 1), m)


def _between(lo: np.ndarray, hi: np.ndarray, m: int) -> np.ndarray:
    """Which of m window starts lie in any [lo, hi]."""
    good = lo <= hi
    return np.cumsum(np.bincount(lo[good], minlength=m + 1)[:m + 1] - np.bincount(hi[good] + 1, minlength=m + 1)[:m + 1])[:m] > 0


def _least_id() -> Column:
    """The first id in the order of results: null if any is."""
    return F.when(~F.max(F.col("id").isNull()), F.min("id"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (the bytes left; null if all are) and kept_sha256."""
    parsed = stored(parse(docs, id_col, text_col, width, gram), "parsed")
    heads = stored(parsed.select("id", "a", "b", "n", "sha"), "heads")
    texts = parsed.groupBy("a", "b").agg(_least_id().alias("first_id"), F.first("n").alias("n"), F.first("lo").alias("lo"),
                                         F.first("span").alias("span"))
    opened = stored(open_windows(parsed, texts, width), "open")
    unstore(parsed)
    found = stored(opened.join(lonely(_with_text(docs, opened, id_col, text_col), width), "a", "left").select(*opened.columns, "lone"), "lone")
    unstore(opened)
    suffixes = sampled_suffixes(_with_text(docs, found, id_col, text_col), width)
    bucket = F.shiftrightunsigned("g", 64 - BUCKET_BITS).alias("name")
    kinds = stored(_first(suffixes, "g", "h").select(bucket, "place.a", "place.pos"), "kinds")
    alone = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("m"), F.min("a").alias("a"), F.min("pos").alias("pos")).filter("m = 1")
    state = stored(decide(found, kinds.select("a", "pos"), alone.select("a", "pos"), width), "state")
    unstore(found, kinds)

    edges = _with_text(docs, state.filter("undecided is not null").select("first_id", "a", "b", "undecided", "loud"), id_col, text_col)
    wide, state = state, stored(narrow(state, settled_ranges(edges, width), width), "narrowed")
    unstore(wide)
    left = state.filter("undecided is not null")
    windows = whole_windows(_with_text(docs, left.select("first_id", "a", "b", "undecided"), id_col, text_col), width)
    kept = _first(windows, "g", "h").select("place.a", "place.pos").groupBy("a").agg(F.collect_list("pos").alias("kept"))
    settled = state.join(kept, "a", "left").select(*state.columns, "kept")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, removed, undecided, first in zip(*(batch.column(i).to_pylist() for i in range(3, 6)), _lists(batch.column(6))):
                m = n - width + 1
                flags = np.zeros(m, dtype=np.uint8)
                if undecided is not None:
                    flags |= _flags(undecided)[:m]
                    flags[first] = 0
                if removed is not None:
                    flags |= _flags(removed)[:m]
                out.append(_pack(flags))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["a", "b", "first_id", "starts"])

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                           T.StructField("first_id", docs.schema[id_col].dataType), T.StructField("starts", T.BinaryType())])
    repeats = stored(settled.mapInArrow(merge, schema).filter("starts is not null"), "repeats")
    unstore(state)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts, text in zip(batch.column(2).to_pylist(), batch.column(3)):
                raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                gone = _spread(np.flatnonzero(_flags(starts)[:len(raw) - width + 1]), width - 1, len(raw))
                rest = raw[~gone].tobytes()
                out.append((int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), rest, hashlib.sha256(rest).hexdigest()))
            removed, spans, rest, sha = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                                              pa.array(rest, pa.binary()), pa.array(sha, pa.string())],
                                             names=["a", "b", "removed", "spans", "kept", "kept_sha"])

    changed = _with_text(docs, repeats.select("a", "b", "starts"), id_col, text_col).select("a", "b", "starts", "body").mapInArrow(
        cut, "a long, b long, removed long, spans long, kept binary, kept_sha string")
    first = heads.groupBy("a", "b").agg(_least_id().alias("first_id"))
    rows = heads.join(first, ["a", "b"]).join(changed, ["a", "b"], "left")
    copy = ~F.col("id").eqNullSafe(F.col("first_id")) & (F.col("n") >= width)

    def pick(all_gone: Column, some: str, none: Column) -> Column:
        return F.when(copy, all_gone).otherwise(F.coalesce(some, none))

    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"), pick(F.col("n"), "removed", F.lit(0)).alias("n_removed"),
        pick(F.lit(1), "spans", F.lit(0)).cast("long").alias("n_spans"), F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha", F.col("sha")).alias("kept_sha256"))
