"""Importance resampling of documents by hashed n-gram models.

Two bag-of-n-gram models over ``BUCKETS`` hash buckets, one of the target text (documents
labelled good) and one of the raw text (all documents), give each document the log weight
log p_target(text) - log p_raw(text) over all its n-grams, scaled to ``PASSAGE`` n-grams if it
has more, so that length alone neither saves nor sinks a document. Gumbel top-k then samples
without replacement in proportion to the weights: the k documents with the largest log
weight + Gumbel noise are kept. By default k is the number of documents whose log weight is
above the model's margin: all but those that the target model clearly explains worse. The
margin comes from labelled documents that a second model hasn't seen (every fifth): the
``TAIL`` quantile of their weights under it, less ``SLACK``. That estimates the same number on a
small and on a large table.

Tokens are runs of letters and digits (all non-ASCII bytes count as letters) and runs of
other visible characters; n-grams are single tokens and pairs of neighbours. The raw model
counts all documents; the target model is fitted on at most ``fit_rows`` labelled
documents, chosen by a hash of their ids, whose ids alone are broadcast.

Defined results: null and empty texts have weight 0; the noise of a row comes from its id
and a seed, so repeated rows are kept or dropped together, ties at the k-th place are all
kept; null ids share their noise and have no label; without any good label all weights are
0; an empty table gives an empty table. A text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import bound_batches, byte_values, mix, null_safe_hash, pieces, prefix_sums, range_hash, release, stored, tidy

BUCKETS, PASSAGE, SMOOTH = 1 << 16, 100, 10.0
HELD_OUT, TAIL, SLACK = 5, 0.01, 5.0


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket, and the log weight below which a document is rejected."""

    ratio: np.ndarray
    margin: float

# 0: separators (blanks and control characters), 1: letters and digits, 2: other characters.
_KIND = np.full(256, 2, dtype=np.int8)
_KIND[:0x21] = _KIND[0x7F] = 0
_KIND[0x80:] = 1
for _span in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B)):
    _KIND[list(_span)] = 1


def ngram_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of a slice of texts."""
    texts = texts.cast(pa.large_string())
    encoded = [t.as_buffer() if t.is_valid else b"" for t in texts]
    sizes = np.array([len(x) for x in encoded], dtype=np.int64)
    raw = np.frombuffer(b"".join(encoded), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    kind = _KIND[raw]
    change = np.empty(len(raw), dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    ends = np.cumsum(sizes)
    firsts = (ends - sizes)[sizes > 0]
    change[firsts] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(raw))
    visible = kind[start] != 0
    start, end = start[visible], end[visible]
    row = np.searchsorted(ends, start, side="right")
    one = range_hash(prefix_sums(byte_values(raw)), start, end)
    with np.errstate(over="ignore"):
        two = mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])[row[:-1] == row[1:]]
    mod = np.uint64(buckets)
    return (np.concatenate([row, row[:-1][row[:-1] == row[1:]]]),
            np.concatenate([one % mod, two % mod]).astype(np.int64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: Column | None = None,
        fit_rows: int = 20_000, buckets: int = BUCKETS) -> Model:
    """The log ratio of each bucket, target over raw. Both models are smoothed by ``SMOOTH`` counts
    on the target's scale, so a bucket of which the target could hardly have an n-gram says nothing."""
    good = F.col("quality") == 1 if good is None else good
    chosen = labels.filter(good & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_ev_id")).distinct().orderBy(
        F.xxhash64("_ev_id"), "_ev_id").limit(fit_rows)
    chosen = stored(chosen.withColumn("_ev_fold", F.when(F.pmod(F.xxhash64("_ev_id", F.lit(1)), F.lit(HELD_OUT)) == 0, 2).otherwise(1)), "target")
    rows = docs.select(F.col(id_col).alias("_ev_id"), F.col(text_col).alias("_ev_text")).join(
        F.broadcast(chosen), "_ev_id", "left").select("_ev_text", F.coalesce("_ev_fold", F.lit(0)).alias("_ev_fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, held = (np.zeros(buckets, dtype=np.int64) for _ in range(3))
        for batch in batches:
            for part in pieces(batch, 0, 1 << 20):
                row, bucket = ngram_buckets(part.column(0), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                fold = part.column(1).to_numpy()[row]
                target += np.bincount(bucket[fold == 1], minlength=buckets)
                held += np.bincount(bucket[fold == 2], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(buckets), raw, target, held)],
                                         names=["bucket", "raw", "target", "held"])

    sums = rows.mapInArrow(tidy(count), "bucket long, raw long, target long, held long").groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in ("raw", "target", "held")]).toPandas()  # one row a bucket
    raw, target, held = (np.zeros(buckets) for _ in range(3))
    for out, name in ((raw, "raw"), (target, "target"), (held, "held")):
        out[sums["bucket"]] = sums[name]

    def ratio(counts: np.ndarray) -> np.ndarray:
        return np.log(counts + SMOOTH) - np.log(raw * (counts.sum() / max(1, raw.sum())) + SMOOTH)

    if not (target + held).sum():
        return Model(np.zeros(buckets), SLACK)
    weights = rows.filter("_ev_fold = 2").select(log_weight(F.col("_ev_text"), Model(ratio(target), 0.0)).alias("w"))
    least = weights.agg(F.percentile("w", F.lit(TAIL))).first()[0]
    return Model(ratio(target + held), SLACK - min(0.0, least or 0.0))


def log_weight(text: Column, model: Model) -> Column:
    """The weight of each text under a fitted model."""
    ratio = model.ratio
    bound_batches()

    @arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        out = [np.empty(0)]
        for part in pieces(pa.record_batch([texts], names=["t"]), 0, 1 << 20):
            row, bucket = ngram_buckets(part.column(0), len(ratio))
            total = np.bincount(row, weights=ratio[bucket], minlength=part.num_rows)
            out.append(total / np.maximum(1, np.bincount(row, minlength=part.num_rows) / PASSAGE))
        total = pa.array(np.concatenate(out))
        release()
        return total

    return score(text)


def gumbel(id_col: Column, seed: int = 0) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    u = (F.shiftrightunsigned(null_safe_hash(id_col, seed=seed), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


@arrow_udf(T.LongType())
def _sortable(key: pa.Array) -> pa.Array:
    """64-bit integers in the order of the doubles."""
    bits = (key.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
    return pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """Exact k-th largest value of a double column: four counts by 16 bits each, never a sort."""
    rows = keys.select(_sortable(F.col(column)).alias("bits")).filter("bits is not null")
    for shift in (48, 32, 16, 0):
        part = F.shiftright("bits", shift)
        counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("part", ascending=False)
        total = counts["n"].cumsum()
        reached = counts[total >= k]
        if not len(reached):
            return None
        value = int(reached["part"].iloc[0])
        k -= int(total[reached.index[0]] - reached["n"].iloc[0])
        rows = rows.filter(part == value)
    bits = np.array([value], dtype=np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def with_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """``docs`` with log_weight and gumbel_key."""
    return docs.withColumn("log_weight", log_weight(F.col(text_col), model)).withColumn(
        "gumbel_key", F.col("log_weight") + gumbel(F.col(id_col), seed))


def decide(rows: DataFrame, model: Model, keep: int | None = None, scores: DataFrame | None = None) -> DataFrame:
    """``rows`` (with log_weight and gumbel_key) and kept: whether the key is among the k largest.

    ``scores`` are the stored scores of the same rows, by default ``rows`` itself.
    """
    scores = rows if scores is None else scores
    keep = scores.filter(F.col("log_weight") > -model.margin).count() if keep is None else keep
    least = kth_largest(scores, "gumbel_key", keep) if keep > 0 else None
    kept = F.lit(keep > 0) if least is None else F.col("gumbel_key") >= F.lit(least)
    return rows.withColumn("kept", kept)


def resample(docs: DataFrame, model: Model, keep: int | None = None, id_col: str = "doc_id", text_col: str = "text",
             seed: int = 0) -> DataFrame:
    """All rows and columns of ``docs`` with log_weight, gumbel_key and kept.

    Scores are stored once to find the threshold; the rows themselves are scored again as
    they pass, so no text is shuffled.
    """
    scored = with_scores(docs, model, id_col, text_col, seed)
    return decide(scored, model, keep, stored(scored.select("log_weight", "gumbel_key"), "weights"))
