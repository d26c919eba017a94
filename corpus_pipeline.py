"""The corpus pipeline: five training-data operators as stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
All but the last return the columns of ``documents``, whichever it has besides ``COLUMNS``.

Defined results: every stage decides row by row, ``doc_id`` is no key. Null ids, shared ids and
repeated rows are rows like others: the quality stage keeps or drops repeated rows together, of
near-duplicates one row stays whatever the ids, and a leak takes the rows with its own text
only. An empty table gives an empty table.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlens.llm import byte_bpe, decontaminate, jaccard_forest, line_dedup, resampling
from evlens.llm.common import read_table, row_key, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = "_ev_key"


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but the used ones renamed, so that added ones can't replace
    them, and the columns that give the former names and order again."""
    names = {c: f"_ev_col{k}" for k, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def content(docs: DataFrame) -> list[Column]:
    """The columns that tell rows apart: all but maps and variants, which Spark can't hash."""
    return [docs[f"`{f.name}`"] for f in docs.schema if not re.search(r"\bmap<|\bvariant\b", f.dataType.simpleString())]


def without(docs: DataFrame, key: list[Column], gone: DataFrame) -> DataFrame:
    """The rows whose 128-bit key (never null) isn't among the columns a and b of ``gone``."""
    return docs.join(gone, (key[0] == gone["a"]) & (key[1] == gone["b"]), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; the good labels are the target."""
    model = resampling.fit(docs, read_table(spark, sf_dir, "labels"))
    rows, columns = aside(docs, "doc_id", "text")
    return resampling.resample(rows, model).filter("kept").select(columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines."""
    rows, columns = aside(docs, "source", "text", "n_chars")
    cleaned = line_dedup.drop_boilerplate(rows, ratio=0.1)
    return cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(
        F.col("n_chars"))).select(columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the least id, nulls last, and of equal
    ids the one with the least content key; of rows alike in all columns one stays. Rows without
    words are near-duplicates of none and all stay."""
    key = row_key(*content(docs))
    keyed = docs.select("text", F.struct(F.col("doc_id").isNull(), "doc_id", *key).alias(KEY))
    classes = stored(jaccard_forest.near_duplicates(keyed, id_col=KEY, words=5, threshold=0.8), "classes")
    own = classes.filter("n_links > 0").select(
        f"{KEY}.a", f"{KEY}.b", (F.col(f"{KEY}.a") != F.col("class_id.a")) | (F.col(f"{KEY}.b") != F.col("class_id.b")))
    # Keys of later rows, and those of several rows alike of which one stays (by themselves: they are few, if any).
    fate = stored(own.toDF("a", "b", "later").groupBy("a", "b", "later").agg(F.count(F.lit(1)).alias("n")).filter(
        "later or n > 1").select("a", "b", "later"), "fate")
    alike = stored(fate.filter("not later"), "alike")
    kept = without(docs, key, fate)
    if alike.isEmpty():
        return kept
    one = docs.select("*", *(k.alias(f"_ev_{c}") for c, k in zip("ab", key))).join(
        alike, (F.col("_ev_a") == alike["a"]) & (F.col("_ev_b") == alike["b"]), "left_semi").dropDuplicates(["_ev_a", "_ev_b"])
    return kept.unionByName(one.drop("_ev_a", "_ev_b"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark item."""
    key = row_key(F.col("text"))
    keyed = docs.select("text", F.struct(*key).alias(KEY))
    leaks = stored(decontaminate.contaminated(keyed, read_table(spark, sf_dir, "benchmark"), id_col=KEY), "leaks")
    return without(docs, row_key(docs["text"]), leaks.select(f"{KEY}.a", f"{KEY}.b").distinct())


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text that is left, and the digest of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, with_offsets=False, with_decoded=True)
    return coded.select(
        "doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("byte-level BPE", encoding)]

#: Sampling, min-hashing, alignment and byte-pair merges have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``, each on the stored result of the one before."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
