"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, decontaminate, exact_dedup, filter_audit, hard_negatives, jaccard_forest, license_scan, line_dedup,
               prefix_counts, recompression, resampling, suffix_dedup, token_files)
from .common import read_table, scratch_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that more than a tenth of its source's documents contain."""
    return line_dedup.drop_boilerplate(read_table(spark, sf_dir, "documents"), ratio=0.1).select(
        "doc_id", "source", "text", "n_lines", "n_dropped")


ORACLES["op1_line_dedup"] = """
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
each AS (SELECT DISTINCT r, source, line FROM (SELECT r, source, trim(unnest(lines)) AS line FROM split) WHERE line <> ''),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source HAVING count(*) >= 3),
bad AS (
  SELECT e.source, list(line) AS lines FROM (SELECT source, line, count(*) AS n FROM each GROUP BY ALL) e
  JOIN totals t ON e.source IS NOT DISTINCT FROM t.source WHERE n > 1 AND n > total * 0.1 GROUP BY e.source),
kept AS (
  SELECT s.*, CASE WHEN b.lines IS NULL THEN s.lines
    ELSE list_filter(s.lines, lambda x: NOT list_contains(b.lines, trim(x))) END AS left_lines
  FROM split s LEFT JOIN bad b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, array_to_string(left_lines, chr(10)) AS text, coalesce(len(lines), 0) AS n_lines,
       coalesce(len(lines) - len(left_lines), 0) AS n_dropped FROM kept
"""


@query
def op2_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class (least id) and its number of links at 0.8 on five words."""
    return jaccard_forest.near_duplicates(read_table(spark, sf_dir, "documents"), words=5, threshold=0.8)


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text by the ranks of byte_bpe_multi_50k, decode the ids again; digests of both and
    of the tokens' character offsets."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode_documents(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN,
                                      with_decoded=True)
    return coded.select(
        "doc_id", "n_tokens",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("char_start", "char_end").alias("offsets_hash"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that also start anywhere else."""
    return recompression.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every text's ids to fixed-size-list Arrow files, read them back; place and checksum."""
    index = token_files.write_token_files(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "tokens"))
    return token_files.read_token_files(index).withColumnRenamed("doc", "doc_id")


@query
def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log weight, noisy key and decision under the model of the good labels."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = resampling.fit(docs, labels)
    scores = stored(resampling.with_scores(docs, model).select("doc_id", "log_weight", "gumbel_key"), "weights")
    return resampling.decide(scores, model)


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item whose alignment reaches half of the item's own score."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper half of the id range as a new batch against the lower half as the snapshot."""
    docs = read_table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    late = F.coalesce(F.col("doc_id") > F.lit(((low or 0) + (high or 0)) // 2), F.lit(False))
    found = exact_dedup.exact_dedup(docs.filter(~late), docs.filter(late))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op9_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op10_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text from its prefix table, and whether they pass 2048."""
    tables = prefix_counts.prefix_tables(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return prefix_counts.answer(tables, 2048).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "chars_within")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 100th vector and its five best rows of the same label: the ten best of other labels
    between 0.3 and 0.9 of that score; every seventh label is shifted by one first."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), hard_negatives.quantise(F.col("embedding"), 256.0).alias("q"))
    return hard_negatives.hard_negatives(rows, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), positives=5,
                                         negatives=10, low=30, high=90)


ORACLES["op11_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.q, c.q)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM e WHERE vec_id % 100 = 0) a JOIN e c ON c.vec_id <> a.vec_id),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the five filters removes in every source, order of the filters and step."""
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT doc_id, part,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS failed
  FROM d),
c AS (
  SELECT part, failed, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS f,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS before
  FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN failed & (f | coalesce(before, 0)::INT) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN failed & f <> 0 AND failed & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failed & f <> 0 AND failed & coalesce(before, 0)::INT <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN good AND failed & f <> 0 AND failed & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN toxic AND failed & f <> 0 AND failed & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license notices, exact and with a few edits: base places, labels, score, spans."""
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))
