"""Exact deduplication of an incoming batch against an immutable snapshot.

A snapshot keeps one bucket row for each digest and, for each shard of the digest space,
one static binary-fuse filter over its digests (about nine bits a digest). Incoming
digests, grouped among themselves first, are screened by their shard's filter; only the
positives join the snapshot's buckets. Rows whose digest occurs more than once anywhere are
then compared byte by byte (grouped by digest and text, with map-side combining).

Hot groups: digests are counted before any shuffle of rows, and the two joins that carry
rows are salted ``SALT`` ways, so a text that fills a third of the table spreads.

Defined results: null text counts as empty; null ids compare below all others, and a group
of null ids only has a null keep_id and keeps its rows; rows that repeat id and text are
all kept if theirs is the largest id. Digest collisions are told apart by the texts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Digests in one filter shard, and the ways that rows of one digest spread.
KEYS_PER_SHARD, SALT = 200_000, 32
SEEDS = 100


def _positions(keys: np.ndarray, seed: int, seg: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three slots in neighbouring segments, and the fingerprint, of each key."""
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, mult in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(mult)
        h ^= h >> np.uint64(33)
    mask = np.uint64(seg - 1)
    first = ((h >> np.uint64(32)) * np.uint64(count * seg)) >> np.uint64(32)
    second = (first + np.uint64(seg)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * seg)) ^ (h & mask)
    slots = np.stack([first, second, third], axis=1).astype(np.int64)
    return slots, (h ^ (h >> np.uint64(40))).astype(np.uint8), h


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, table) of a binary-fuse filter over 64-bit keys."""
    keys = np.unique(keys)
    n = len(keys)
    seg = 4 if n < 2 else min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = 2.0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    count = max(1, -(-int(n * factor) // seg) - 2)
    for seed in range(1, SEEDS):
        slots, prints, _ = _positions(keys, seed, seg, count)
        size = (count + 2) * seg
        degree = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)  # sum of the keys at a slot: the key itself once it is alone
        for k in range(3):
            np.add.at(owner, slots[:, k], np.arange(n))
        rounds = []
        single = np.flatnonzero(degree == 1)
        while len(single):
            peeled, where = np.unique(owner[single], return_index=True)
            rounds.append((peeled, single[where]))
            touched = slots[peeled].ravel()
            np.subtract.at(degree, touched, 1)
            np.subtract.at(owner, touched, np.repeat(peeled, 3))
            touched = np.unique(touched)
            single = touched[degree[touched] == 1]
        if sum(len(p) for p, _ in rounds) == n:
            table = np.zeros(size, dtype=np.uint8)
            for peeled, at in reversed(rounds):
                own = slots[peeled]
                table[at] = 0
                table[at] = prints[peeled] ^ table[own[:, 0]] ^ table[own[:, 1]] ^ table[own[:, 2]]
            return seed, seg, count, table.tobytes()
        if seed % 4 == 0:
            count += max(1, count // 8)
    raise RuntimeError("no seed gives a binary-fuse filter")


def may_contain(keys: np.ndarray, seed: int, seg: int, count: int, table: bytes) -> np.ndarray:
    """False only for keys that the filter was not built over."""
    slots, prints, _ = _positions(keys, seed, seg, count)
    t = np.frombuffer(table, dtype=np.uint8)
    return (t[slots[:, 0]] ^ t[slots[:, 1]] ^ t[slots[:, 2]]) == prints


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[:8] for d in digests), dtype="<u8")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def buckets(digested: DataFrame) -> DataFrame:
    """One row a digest: how many rows, and the largest id."""
    return digested.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))


def build_filters(bucket_rows: DataFrame, shards: int) -> DataFrame:
    """One binary-fuse filter for each shard of a stored bucket table."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, seg, count, table = build_filter(_keys(pdf["digest"]))
        return pd.DataFrame({"shard": pdf["shard"][:1], "seed": [seed], "seg": [seg], "segs": [count], "table": [table]})

    return bucket_rows.select(_shard(shards).alias("shard"), "digest").groupBy("shard").applyInPandas(
        build, "shard int, seed int, seg int, segs int, table binary")


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The bucket rows of the batch that pass their shard's filter."""
    def test(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["digest", "n", "keep"]]
        if not len(own) or not len(pdf):
            return out[:0]
        f = own.iloc[0]
        return out[may_contain(_keys(pdf["digest"]), int(f.seed), int(f.seg), int(f.segs), f.table)]

    left = incoming.withColumn("shard", _shard(shards)).groupBy("shard")
    return left.cogroup(filters.groupBy("shard")).applyInPandas(test, incoming.select("digest", "n", "keep").schema)


def _salted(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Join rows to a table that has one row a digest; the rows of one digest go to SALT places."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", salt).join(spread, ["digest", "salt"], how).drop("salt")


def exact_dedup(snapshot: DataFrame, incoming: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest=sha256) -> DataFrame:
    """One row for each row of both: id_col, keep_id, group_size, kept, digest, incoming.

    Of equal texts the largest id stays; ``digest`` maps the text column to a binary column
    of eight bytes or more.
    """
    def texts(df: DataFrame, new: bool) -> DataFrame:
        body = F.coalesce(F.col(text_col), F.lit(""))
        return df.select(F.col(id_col).alias("id"), digest(body).alias("digest"), F.lit(new).alias("incoming"), body.alias("body"))

    both = texts(snapshot, False).unionByName(texts(incoming, True))
    digested = stored(both.drop("body"), "digests")
    old = stored(buckets(digested.filter(~F.col("incoming"))), "buckets")
    new = stored(buckets(digested.filter("incoming")), "batch")
    shards = max(1, -(-max(old.count(), new.count()) // KEYS_PER_SHARD))
    positives = screen(new, build_filters(old, shards), shards)
    held = old.select("digest", F.col("n").alias("n_old"), F.col("keep").alias("keep_old"))
    hits = stored(positives.join(held, "digest").select(
        "digest", (F.col("n") + F.col("n_old")).alias("n"), F.greatest("keep", "keep_old").alias("keep")), "hits")
    alone = old.unionByName(new).filter("n > 1").join(hits, "digest", "left_anti")
    several = hits.unionByName(alone).select("digest")

    # Byte check: rows of one digest and one text are one group.
    groups = stored(_salted(both, several, "inner").groupBy("digest", "body").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")), "groups")
    variants = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("variants"), F.max("n").alias("n"), F.max("keep").alias("keep"))
    plain = variants.filter("variants = 1").drop("variants")
    clashing = variants.filter("variants > 1").select("digest")
    found = _salted(digested, plain, "left")
    if not clashing.isEmpty():
        exact = _salted(both, clashing, "inner").join(groups, ["digest", "body"]).drop("body")
        found = found.join(clashing, "digest", "left_anti").unionByName(exact)
    many = F.col("n") > 1
    keep = F.when(many, F.col("keep")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(~many, F.lit(True)).alias("alone"), "digest", "incoming").select(
        id_col, "keep_id", "group_size", (F.col("alone") | F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"),
        "digest", "incoming")
