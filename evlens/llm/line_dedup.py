"""Boilerplate lines by site-relative frequency, in DataFrame operations only.

A line is boilerplate on a host if more than ``ratio`` of the host's pages contain it. Lines
are compared without surrounding spaces; blank lines are never counted or dropped. A host's
boilerplate can't exceed its average number of lines a page divided by ``ratio``, so the
list of a host is small whatever its size; it is joined to the pages by host, salted
``SALT`` ways, so that a host with a third of all pages spreads. The list is written first,
so the planner knows its size: a small one is broadcast, a large one is shuffled.

Defined results: null hosts are one host; a null text stays null and has 0 lines, but its
page counts; a page counts once for a line it repeats; an empty text is one blank line; a
page without any line left has the empty text; repeated rows are pages of their own; hosts
with fewer than ``min_pages`` pages keep all lines; an empty table gives an empty table.
Columns named like the two added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SALT = 16


def _hash(line: Column) -> Column:
    """128 bits of a line without its surrounding spaces."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(1), F.trim(line)).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """One row a host that has boilerplate: _ev_host, _ev_bad (hashes of its lines)."""
    each = pages.select(F.col(host).alias("_ev_host"), F.explode(F.array_distinct(F.transform(
        _lines(F.col(text)), lambda x: F.trim(x)))).alias("line")).filter("line <> ''")
    per_line = each.select("_ev_host", _hash(F.col("line")).alias("key")).groupBy("_ev_host", "key").agg(
        F.count(F.lit(1)).alias("n"))
    totals = pages.groupBy(F.col(host).alias("_ev_h")).agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= min_pages)
    common = per_line.filter("n > 1").join(totals, F.col("_ev_host").eqNullSafe(F.col("_ev_h"))).filter(
        F.col("n") > F.col("total") * F.lit(float(ratio)))
    return common.groupBy("_ev_host").agg(F.collect_list("key").alias("_ev_bad"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 3,
                     lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """All rows and columns, the text without its host's boilerplate, and two counts of lines."""
    bad = stored(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    spread = bad.select(F.col("_ev_host").alias("_ev_h"), "_ev_bad", F.explode(
        F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_ev_s"))
    salted = pages.withColumn("_ev_salt", F.pmod(F.xxhash64(text), F.lit(SALT)).cast("int"))
    joined = salted.join(spread, F.col(host).eqNullSafe(F.col("_ev_h")) & (F.col("_ev_salt") == F.col("_ev_s")), "left")
    lines = _lines(F.col(text))

    def kept(line: Column) -> Column:
        return ~F.exists(F.col("_ev_bad"), lambda x: x == _hash(line))

    left = F.when(F.col("_ev_bad").isNull(), lines).otherwise(F.filter(lines, kept))
    counted = joined.withColumn("_ev_left", left).withColumn("_ev_n", F.coalesce(F.size(lines), F.lit(0))).withColumn(
        "_ev_n", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col("_ev_n")))
    out = counted.withColumn(
        dropped_col, F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col("_ev_n") - F.size("_ev_left")).cast("long")).withColumn(
        lines_col, F.col("_ev_n").cast("long")).withColumn(text, F.array_join("_ev_left", "\n"))
    return out.drop("_ev_h", "_ev_bad", "_ev_s", "_ev_salt", "_ev_left", "_ev_n")
