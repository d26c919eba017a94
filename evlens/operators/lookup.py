"""Look rows up in a table too large to broadcast, though a few keys hold most rows.

Rows of one key meet in one partition of a shuffled join. Here a key that holds more than
one row in ``share`` is dealt over as many pieces as keep each at about that many rows, and its
table rows are copied once a piece. Such keys are fewer than ``share`` whatever the input, so
their list is broadcast; the pieces of all of them are at most twice as many. All other
keys, and the table's rows for them, go through the same join undealt.

Defined results: those of a left join. A null key matches nothing (its rows are dealt over
``share`` pieces); several table rows of a key give several rows; repeated rows stay
repeated; an empty table gives nulls, empty rows an empty frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

SHARE = 1000


def hot_keys(rows: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """(key, pieces) of the keys with more than one row in ``share``: fewer than ``share`` rows."""
    counts = stored(rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot_key")).agg(
        F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0  # one scalar
    return counts.filter(F.col("_n") * share > total).select(
        "_hot_key", F.ceil(F.col("_n") * share / F.lit(max(1, total))).cast("int").alias("_pieces"))


def spread_lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, spread: Column,
                  share: int = SHARE) -> DataFrame:
    """``rows`` left-joined to ``table`` on ``key`` = ``table_key``, all columns of both.

    ``spread`` is a long that tells the rows of one key apart (a row id off the input scan): it
    deals them, and has to come out the same when a lost partition is computed again.
    """
    hot = hot_keys(rows, key, share)
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    pieces = F.when(F.col(key).isNull(), F.lit(share)).otherwise(F.coalesce("_pieces", F.lit(1)))
    left = left.withColumn("_piece", F.pmod(F.xxhash64(spread), pieces.cast("long"))).drop("_hot_key", "_pieces")
    right = table.join(F.broadcast(hot), F.col(table_key) == F.col("_hot_key"), "left")
    right = right.withColumn("_table_piece", F.explode(F.sequence(
        F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)).cast("long") - 1))).drop("_hot_key", "_pieces")
    return left.join(right, (F.col(key) == F.col(table_key)) & (F.col("_piece") == F.col("_table_piece")), "left").drop(
        "_piece", "_table_piece")
