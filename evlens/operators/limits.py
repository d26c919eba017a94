"""Rate-limit analytics L1-L6 over request logs.

The reference enforces these live with counters; here they are computed after
the fact over a request log, exactly reproducing each counter's decisions.

Anchored counter (L1-L4): a per-key counter starts at the first request, lives
``ttl`` seconds, counts every request that reaches it (rejected ones too), and
the request is over the limit when its count exceeds the limit. A request at
exactly ``start + ttl`` still belongs to the old window (the counter expires
only after its deadline).

Sliding log (L5): a request is admitted when fewer than ``limit`` *admitted*
requests of the same key lie in ``(t - window, t]``; rejected requests are not
logged.

Plan: each key's requests are split into islands at gaps longer than the
window (a new island always starts a fresh counter, so islands are independent
and run in parallel). Islands that fit in one window, or cannot exceed the
limit, are ranked with a window function inside the JVM. Only islands that span
several windows (anchored), or segments between quiet windows that may pass the limit
(sliding), are folded sequentially by ``mapInPandas`` over partitions hash-partitioned by key
and sorted by (key, island, time): every Arrow batch folds all of its groups in
one vectorised pass (one Python step per counter window, ``searchsorted`` for
the rest), and only the open counter crosses from one batch to the next, so a
long island never has to fit in memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import keep, stored

# The reference's limits (requests, window seconds).
KEY_HOUR_DEFAULT = 10000          # L1 per API key per hour when the key sets none
KEY_HOUR_TTL = 3600
COLLECT_LIMIT, COLLECT_TTL = 2000, 60         # L2 event collection, per key header or IP
ANALYTICS_LIMIT, ANALYTICS_TTL = 120, 60      # L3 report reads, per user or IP
AUTH_LIMIT, GENERAL_LIMIT, AUTH_TTL = 10, 100, 15 * 60   # L4
SLIDING_LIMIT, SLIDING_STATS_LIMIT, SLIDING_WINDOW = 100, 50, 60   # L5

_US = 1_000_000


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _bucket(c: Column, width_us: int) -> Column:
    """Exact floor(c / width) for microsecond longs (integer arithmetic, negatives included)."""
    w = F.lit(int(width_us))
    return ((c - F.pmod(c, w)) / w).cast("long")


def _limit_col(limit) -> Column:
    return limit if isinstance(limit, Column) else F.lit(int(limit))


def _islands(df: DataFrame, keys: list[str], ts: str, gap_us: int, tiebreak: list[str],
             strict_gap: bool) -> DataFrame:
    """Tag rows with ``_us``, an island number per key, and island size/span."""
    w = Window.partitionBy(*keys).orderBy("_us", *tiebreak)
    gap = F.col("_us") - F.lag("_us").over(w)
    new = gap.isNull() | ((gap > gap_us) if strict_gap else (gap >= gap_us))
    d = (df.withColumn("_us", _micros(F.col(ts)))
           .withColumn("_island", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    wi = Window.partitionBy(*keys, "_island")
    return d.withColumns({"_isl_n": F.sum("_w").over(wi), "_isl_span": F.max("_us").over(wi) - F.min("_us").over(wi),
                          "_isl_start": F.min("_us").over(wi)})


def anchored_windows(t: np.ndarray, w: np.ndarray, ttl_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Window start and running count of each sorted arrival time (weights ``w``).

    ``nxt[j]`` is the first row after ``t[j] + ttl``; the window starts are the
    chain 0, nxt[0], nxt[nxt[0]], ... (one step per window), everything else
    is vectorised.
    """
    n = len(t)
    nxt = np.searchsorted(t, t + ttl_us, side="right").tolist()
    is_start = np.zeros(n, dtype=bool)
    j = 0
    while j < n:
        is_start[j] = True
        j = nxt[j]
    win = np.cumsum(is_start) - 1
    first = np.flatnonzero(is_start)
    csum = np.cumsum(w)
    before = np.concatenate(([0], csum))[first]   # weight before each window's first row
    return t[first][win], csum - before[win]


def _group_ids(pdf: pd.DataFrame, cols: list[str]) -> np.ndarray:
    """Ids of contiguous runs of equal ``cols`` values (rows arrive sorted by them)."""
    change = np.zeros(len(pdf), dtype=bool)
    if len(pdf):
        change[0] = True
    for c in cols:
        v = pdf[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change) - 1


def _fold_anchored(ttl_us: int, group_cols: list[str]):
    """mapInPandas body: rows sorted by (group, time); only (group, start, count) is
    carried from one Arrow batch to the next, so memory is bounded by the batch."""
    def fold(batches):
        carry = None  # (group key tuple, window start, count)
        for pdf in batches:
            if pdf.empty:
                continue
            t = pdf["_us"].to_numpy(dtype=np.int64)
            w = pdf["_w"].to_numpy(dtype=np.int64)
            g = _group_ids(pdf, group_cols)
            first_key = tuple(pdf[c].iat[0] for c in group_cols)
            seeded = carry is not None and carry[0] == first_key
            if seeded:  # continue the open window of the previous batch
                t = np.concatenate(([carry[1]], t))
                w = np.concatenate(([carry[2]], w))
                g = np.concatenate(([0], g))
            # Lay the groups out on one axis, each after the previous one's end + ttl.
            tmin = np.minimum.reduceat(t, np.flatnonzero(np.r_[True, g[1:] != g[:-1]]))[g]
            rel = t - tmin
            gap = int(rel.max()) + ttl_us + 1
            starts_rel, counts = anchored_windows(g.astype(np.int64) * gap + rel, w, ttl_us)
            starts = starts_rel - g.astype(np.int64) * gap + tmin
            if seeded:
                starts, counts = starts[1:], counts[1:]
            carry = (tuple(pdf[c].iat[-1] for c in group_cols), int(starts[-1]), int(counts[-1]))
            yield pdf.assign(_wstart=starts, _wcount=counts)
    return fold


# Keys with more requests than this are counted without any per-key task; the result is the same.
# A task's windows hold a key's rows in memory, so the bound is one of memory.
HOT_KEY_ROWS = 500_000


def anchored_counter(df: DataFrame, keys: list[str], ts: str, ttl_seconds: int, limit,
                     tiebreak: list[str] | None = None, breach_only: bool = False,
                     seed: DataFrame | None = None, hot_rows: int | None = HOT_KEY_ROWS,
                     hot_where: Column | None = None) -> DataFrame:
    """L1-L4: add ``window_start``, ``window_count`` and ``limit_exceeded`` to every row;
    with ``breach_only`` only ``limit_exceeded``, which needs fewer folds.

    Keys with more than ``hot_rows`` requests go to ``anchored_counter_parallel`` (no step
    that puts one key in one task), the rest are folded per island; both give the same rows
    and columns. The hot keys stay a frame: nothing of them is read back but whether there
    are any. ``hot_rows=None`` folds every key; ``hot_where`` limits the hot-key count to
    rows that can share a key.
    """
    def narrow(out: DataFrame) -> DataFrame:
        return out.drop("window_start", "window_count") if breach_only else out

    if hot_rows is not None:
        cand = df if hot_where is None else df.filter(hot_where)
        hot = keep(cand.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*keys))
        if not hot.isEmpty():
            hot_seed, cold_seed = (None if seed is None else seed.join(hot, keys, how) for how in ("left_semi", "left_anti"))
            a = anchored_counter_parallel(df.join(hot, keys, "left_semi"), keys, ts, ttl_seconds, limit, tiebreak, hot_seed)
            b = _anchored_fold(df.join(hot, keys, "left_anti"), keys, ts, ttl_seconds, limit, tiebreak, breach_only, cold_seed)
            return narrow(b.unionByName(a.select(*b.columns)))
    return narrow(_anchored_fold(df, keys, ts, ttl_seconds, limit, tiebreak, breach_only, seed))


def _anchored_fold(df: DataFrame, keys: list[str], ts: str, ttl_seconds: int, limit,
                   tiebreak: list[str] | None = None, breach_only: bool = False,
                   seed: DataFrame | None = None) -> DataFrame:
    """L1-L4 by islands and folds: add ``window_start``, ``window_count`` and
    ``limit_exceeded`` to every row.

    ``limit`` is an int or a Column (e.g. a per-key limit). With ``breach_only``
    islands that cannot exceed the limit are not folded and their
    ``window_count`` is left NULL (``limit_exceeded`` stays exact).
    ``seed`` carries open counters in from earlier data (keys, ``window_start``,
    ``seed_count``): each becomes a weighted row at its window start, ordered
    before real rows of the same instant, and is dropped from the output.
    """
    tiebreak = ["_seedlast", *(tiebreak or [])]
    ttl_us = int(ttl_seconds) * _US
    lim = _limit_col(limit)
    base = df.withColumns({"_w": F.lit(1).cast("long"), "_seedlast": F.lit(1)})
    if seed is not None:
        s = seed.select(*keys, F.col("window_start").cast(df.schema[ts].dataType).alias(ts),
                        F.col("seed_count").cast("long").alias("_w"), F.lit(0).alias("_seedlast"))
        base = base.unionByName(s, allowMissingColumns=True)
    d = _islands(base, keys, ts, ttl_us, tiebreak, strict_gap=True)
    multi = F.col("_isl_span") > ttl_us
    wi = Window.partitionBy(*keys, "_island")
    # Decided per island (every row of an island, seed included, takes the same branch).
    over_limit = F.max(((F.col("_isl_n") > lim) & (F.col("_seedlast") == 1)).cast("int")).over(wi) == 1
    d = d.withColumn("_fold", multi & over_limit if breach_only else multi)
    # Both branches below read the island frame: keep it so the input is computed once.
    d = keep(d)
    needs_fold = F.col("_fold")
    running = F.sum("_w").over(wi.orderBy("_us", *tiebreak).rowsBetween(Window.unboundedPreceding, 0))
    simple = d.filter(~needs_fold).withColumns({"_wstart": F.when(~multi, F.col("_isl_start")),
                                                 "_wcount": F.when(~multi, running)})
    to_fold = d.filter(needs_fold)
    schema = T.StructType(to_fold.schema.fields + [T.StructField("_wstart", T.LongType()),
                                                   T.StructField("_wcount", T.LongType())])
    folded = (to_fold.repartition(*keys).sortWithinPartitions(*keys, "_island", "_us", *tiebreak)
                     .mapInPandas(_fold_anchored(ttl_us, [*keys, "_island"]), schema))
    out = simple.unionByName(folded).filter(F.col("_seedlast") == 1)
    ts_type = df.schema[ts].dataType.simpleString()
    exceeded = F.when(F.col("_wcount").isNotNull(), F.col("_wcount") > lim).otherwise(F.lit(False))
    return (out.withColumns({"window_start": F.timestamp_micros("_wstart").cast(ts_type),
                             "window_count": F.col("_wcount"), "limit_exceeded": exceeded})
               .drop("_us", "_island", "_isl_n", "_isl_span", "_isl_start", "_wstart", "_wcount", "_w", "_seedlast",
                     "_fold"))


def open_counters(counted: DataFrame, keys: list[str], ts: str, ttl_seconds: int, as_of=None) -> DataFrame:
    """The counters still open after ``counted`` (output of ``anchored_counter``): per key
    the last window and its count, as a ``seed`` for the next batch. With ``as_of``,
    windows already expired at that instant are dropped."""
    w = Window.partitionBy(*keys).orderBy(F.desc("window_start"), F.desc("window_count"))
    last = (counted.filter(F.col("window_count").isNotNull())
                   .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
                   .select(*keys, "window_start", F.col("window_count").alias("seed_count")))
    if as_of is not None:
        last = last.filter(F.col("window_start") + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
                           >= F.lit(as_of).cast(counted.schema["window_start"].dataType))
    return last


def limit_headers(df: DataFrame, ts: str, limit, window_seconds: int) -> DataFrame:
    """``remaining = max(0, limit - count)`` and ``reset_at = request time + window``."""
    return (df.withColumn("remaining", F.greatest(F.lit(0).cast("long"), _limit_col(limit) - F.col("window_count")))
              .withColumn("reset_at", F.col(ts) + F.expr(f"INTERVAL {int(window_seconds)} SECONDS")))


def running_total(df: DataFrame, group: list[str], order: list[str], weight: str, out: str) -> DataFrame:
    """Running sum of ``weight`` in each group, by ``order``, in two levels: no group is one task.

    Rows are dealt to ranges of (group, order) and stored with their range's number; sums run
    inside (group, range), and each range adds the totals of the group's earlier ranges (a
    row a range). Rows alike in group and order share a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    d = stored(d, "ranges")  # the ranges are sampled: they must not be dealt anew
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*group, "_part").agg(F.sum(weight).alias("_t"))
    offsets = totals.select(*[F.col(c).alias(f"_o{k}") for k, c in enumerate([*group, "_part"])],
                            F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    d = d.withColumn(out, F.sum(weight).over(inside))
    on = [F.col(c).eqNullSafe(F.col(f"_o{k}")) for k, c in enumerate([*group, "_part"])]
    names = [c for c in d.columns if c not in ("_part", out)]
    return d.join(offsets, on, "left").select(*names, (F.col(out) + F.col("_before")).alias(out))


def aligned_counter(df: DataFrame, keys: list[str], ts: str, window_seconds: int, limit,
                    tiebreak: list[str] | None = None, hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """Clock-aligned fixed windows (L4 option): rank within (key, floor(t / window)).

    Windows with more than ``hot_rows`` requests of one key are counted in two levels."""
    w_us = int(window_seconds) * _US
    bucket = _bucket(_micros(F.col(ts)), w_us)
    d = df.withColumn("_b", bucket)
    group, order = [*keys, "_b"], [ts, *(tiebreak or [])]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    ts_type = df.schema[ts].dataType.simpleString()

    def counted(rows: DataFrame) -> DataFrame:
        return rows.withColumn("window_count", rank)

    if hot_rows is not None:
        hot = keep(d.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(
            *[F.col(c).alias(f"_h{k}") for k, c in enumerate(group)]))
        if hot.isEmpty():
            d = counted(d)
        else:
            on = [F.col(c).eqNullSafe(F.col(f"_h{k}")) for k, c in enumerate(group)]
            busy = running_total(d.join(hot, on, "left_semi").withColumn("_w", F.lit(1).cast("long")), group, order, "_w", "window_count")
            d = counted(d.join(hot, on, "left_anti")).unionByName(busy.drop("_w"))
    else:
        d = counted(d)
    return (d
             .withColumn("window_start", F.timestamp_micros(F.col("_b") * w_us).cast(ts_type))
             .withColumn("limit_exceeded", F.col("window_count") > _limit_col(limit))
             .drop("_b"))


# --- L1 - L4 presets --------------------------------------------------------------

def key_hour_limit(df: DataFrame, key: str = "key_id", ts: str = "received_at", limit="rate_limit_per_hour",
                   ttl_seconds: int = KEY_HOUR_TTL, tiebreak=None, breach_only: bool = False) -> DataFrame:
    """L1: per API key, default 10000 per hour when the key's own limit is NULL or 0."""
    lim = limit if not isinstance(limit, str) else F.coalesce(F.nullif(F.col(limit), F.lit(0)),
                                                                F.lit(KEY_HOUR_DEFAULT))
    return anchored_counter(df, [key], ts, ttl_seconds, lim, tiebreak, breach_only)


def collect_limit(df: DataFrame, ts: str = "received_at", limit: int = COLLECT_LIMIT,
                  ttl_seconds: int = COLLECT_TTL, tiebreak=None) -> DataFrame:
    """L2: per API-key header, else (no or an empty header) client IP."""
    d = df.withColumn("_limit_key", F.coalesce(F.nullif(F.col("api_key"), F.lit("")), F.col("client_ip")))
    return anchored_counter(d, ["_limit_key"], ts, ttl_seconds, limit, tiebreak).drop("_limit_key")


def analytics_limit(df: DataFrame, ts: str = "received_at", limit: int = ANALYTICS_LIMIT,
                    ttl_seconds: int = ANALYTICS_TTL, tiebreak=None) -> DataFrame:
    """L3: per signed-in user ('user:<id>'), else client IP ('ip:<ip>')."""
    key = F.when(F.col("user_id").isNotNull(), F.concat(F.lit("user:"), F.col("user_id").cast("string"))) \
           .otherwise(F.concat(F.lit("ip:"), F.col("client_ip")))
    d = df.withColumn("_limit_key", key)
    return anchored_counter(d, ["_limit_key"], ts, ttl_seconds, limit, tiebreak).drop("_limit_key")


def auth_limit(df: DataFrame, ts: str = "received_at", limit: int = AUTH_LIMIT,
               ttl_seconds: int = AUTH_TTL, tiebreak=None) -> DataFrame:
    """L4: per client IP on the auth endpoints (10 per 15 minutes)."""
    return anchored_counter(df, ["client_ip"], ts, ttl_seconds, limit, tiebreak)


def general_limit(df: DataFrame, ts: str = "received_at", limit: int = GENERAL_LIMIT,
                  ttl_seconds: int = AUTH_TTL, tiebreak=None) -> DataFrame:
    """L4: per client IP on all other endpoints (100 per 15 minutes)."""
    return auth_limit(df, ts, limit, ttl_seconds, tiebreak)


# --- L5 sliding log ---------------------------------------------------------------
#
# Time is cut into buckets of one window. Where two successive buckets together hold fewer than
# ``limit`` requests, every request of the second is admitted whatever came before, so the log
# at its end is known: the requests of that bucket. A key's buckets fall into segments at these
# places, and every segment is folded by itself, with the bucket before it as its log. Only a
# key that keeps to its limit without a break has a long segment; its fold reads batch by
# batch and carries the last ``limit`` admissions.

def admitted_times(t: np.ndarray, log: np.ndarray, window_us: int, limit: int) -> np.ndarray:
    """Which of the sorted arrival times are admitted after the admissions ``log`` (sorted, the
    last ``limit`` at most).

    The i-th admission is the first arrival after the one before it that is no less than a
    window later than admission i - limit; ``limit`` of them are found at a time.
    """
    every = np.concatenate((log, t))
    n, m = len(every), len(log)
    first_free = np.searchsorted(every, every + window_us, side="left")
    done = np.arange(m)
    if m < limit:  # the log isn't full: the next arrivals pass
        done = np.arange(min(limit, n))
    parts = [done]
    while len(done) == limit and done[-1] < n - 1:
        step = np.arange(limit)
        after = np.maximum.accumulate(np.maximum(first_free[done] - step, done[-1] + 1)) + step
        after = after[after < n]
        if not len(after):
            break
        parts.append(after)
        done = np.concatenate((done, after))[-limit:]
    out = np.zeros(n, dtype=bool)
    out[np.concatenate(parts)] = True
    return out[m:]


def _fold_sliding(window_us: int, limit: int, group_cols: list[str]):
    """mapInPandas body for the sliding log: rows sorted by (group, time), a group's seed rows
    (known admissions) first; the last ``limit`` admissions are carried between batches."""
    def fold(batches):
        key, log = None, np.empty(0, dtype=np.int64)
        for pdf in batches:
            if pdf.empty:
                continue
            t, seed = pdf["_us"].to_numpy(dtype=np.int64), pdf["_seed"].to_numpy(dtype=bool)
            g = _group_ids(pdf, group_cols)
            cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            admitted = np.empty(len(pdf), dtype=bool)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = tuple(pdf[c].iat[lo] for c in group_cols)
                if own != key:
                    key, log = own, np.empty(0, dtype=np.int64)
                known = lo + int(seed[lo:hi].sum())
                log = np.concatenate((log, t[lo:known]))[-limit:]
                admitted[lo:known] = True
                admitted[known:hi] = admitted_times(t[known:hi], log, window_us, limit)
                log = np.concatenate((log, t[known:hi][admitted[known:hi]]))[-limit:]
            yield pdf.assign(_admitted=admitted)
    return fold


def sliding_segments(df: DataFrame, keys: list[str], window_us: int, limit: int) -> DataFrame:
    """One row a key and non-empty bucket: the segment it belongs to (``_seg``, its first bucket),
    whether the segment needs a fold, and whether the next segment takes the bucket as its log."""
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b")

    def earlier(buckets: int) -> Column:
        """Requests in the bucket so many places before this one (0 if there are none)."""
        return sum((F.when(F.lag("_b", k).over(w) == F.col("_b") - buckets, F.lag("_n", k).over(w)).otherwise(F.lit(0))
                    for k in range(1, buckets + 1)), F.lit(0))

    d = counts.withColumns({"_n1": F.coalesce(earlier(1), F.lit(0)), "_n2": F.coalesce(earlier(2), F.lit(0))})
    d = d.withColumn("_start", (F.col("_n1") + F.col("_n2") < limit) | F.lag("_b").over(w).isNull())
    d = d.withColumn("_seg", F.max(F.when(F.col("_start"), F.col("_b"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ws = Window.partitionBy(*keys, "_seg")
    d = d.withColumn("_fold", F.max((F.col("_n1") + F.col("_n") > limit).cast("int")).over(ws) == 1)
    follows = (F.lead("_b").over(w) == F.col("_b") + 1) & F.lead("_start").over(w) & F.lead("_fold").over(w)
    return d.select(*keys, "_b", "_seg", "_fold", F.coalesce(follows, F.lit(False)).alias("_seeds_next"))


def sliding_log_limit(df: DataFrame, keys: list[str], ts: str, window_seconds: int = SLIDING_WINDOW,
                      limit: int = SLIDING_LIMIT, tiebreak: list[str] | None = None) -> DataFrame:
    """Add ``admitted``. Keys are cut into segments wherever two windows are quiet; only segments
    that may pass the limit are folded, each in its own group. Rows without a time are admitted."""
    tiebreak, limit = list(tiebreak or []), int(limit)
    w_us = int(window_seconds) * _US
    d = df.withColumn("_us", _micros(F.col(ts))).withColumn("_b", _bucket(F.col("_us"), w_us))
    seg = keep(sliding_segments(d.filter(F.col("_us").isNotNull()), keys, w_us, limit))
    names, of = d.columns, {c: f"_of{k}" for k, c in enumerate([*keys, "_b"])}
    d = d.join(seg.withColumnsRenamed(of), [F.col(c).eqNullSafe(F.col(o)) for c, o in of.items()], "left")
    d = d.select(*names, "_seg", "_fold", "_seeds_next").withColumn("_seed", F.lit(False))
    needs_fold = F.coalesce("_fold", F.lit(False))
    simple = d.filter(~needs_fold).withColumn("_admitted", F.lit(True))
    # The log a segment starts with: the rows of the bucket before it, all admitted and fewer than the limit.
    logs = d.filter("_seeds_next").withColumns({"_seg": F.col("_b") + 1, "_seed": F.lit(True)})
    to_fold = d.filter(needs_fold).unionByName(logs)
    schema = T.StructType(to_fold.schema.fields + [T.StructField("_admitted", T.BooleanType())])
    folded = (to_fold.repartition(*keys, "_seg").sortWithinPartitions(*keys, "_seg", F.desc("_seed"), "_us", *tiebreak)
                     .mapInPandas(_fold_sliding(w_us, limit, [*keys, "_seg"]), schema)).filter("NOT _seed")
    return (simple.unionByName(folded).withColumnRenamed("_admitted", "admitted")
                  .drop("_us", "_b", "_seg", "_fold", "_seeds_next", "_seed"))


def report_limit(df: DataFrame, ts: str = "received_at", limit: int = SLIDING_LIMIT,
                 window_seconds: int = SLIDING_WINDOW, tiebreak=None) -> DataFrame:
    """L5 on the reports: the sliding log of the signed-in user, else of the client IP (100 a minute)."""
    user = F.nullif(F.col("user_id").cast("string"), F.lit(""))
    d = df.withColumn("_limit_key", F.coalesce(F.concat(F.lit("user:"), user), F.concat(F.lit("ip:"), F.col("client_ip"))))
    return sliding_log_limit(d, ["_limit_key"], ts, window_seconds, limit, tiebreak).drop("_limit_key")


def stats_report_limit(df: DataFrame, ts: str = "received_at", limit: int = SLIDING_STATS_LIMIT,
                       window_seconds: int = SLIDING_WINDOW, tiebreak=None) -> DataFrame:
    """L5 on the user statistics: as ``report_limit``, 50 a minute."""
    return report_limit(df, ts, limit, window_seconds, tiebreak)


# --- anchored counter without a per-key sequential step ---------------------------
#
# The windows are a greedy cover of each key's arrival times: a window starts at
# the first time not covered by the previous one. With nxt(u) = first arrival
# strictly after u + ttl, the window starts of a key are the chain
# first -> nxt(first) -> nxt(nxt(first)) -> ... Every step below is grouped by
# (key, ttl-bucket) or by (key, window), never by the key alone:
#   1. nxt for every distinct arrival time: an as-of lookup inside the bucket the
#      probe u + ttl falls in, else the first arrival of the next non-empty bucket
#      (a per-key table of bucket minima, one row per bucket).
#   2. the chain by pointer doubling: each round doubles the known prefix of every
#      key's chain and squares the pointer table (O(log #windows) rounds).
#   3. each row's window: at most one window starts per bucket, so a row belongs
#      to its own bucket's start (when at or after it) or else to the previous
#      bucket's; the count is a running sum inside (key, window start), in two
#      levels, so that one busy window isn't one task either.

def _next_arrival(times: DataFrame, keys: list[str], ttl_us: int) -> DataFrame:
    """(keys, _us, _nxt): the first distinct arrival strictly after _us + ttl (NULL if none)."""
    d = times.withColumn("_b", _bucket(F.col("_us"), ttl_us))
    probes = d.select(*keys, (F.col("_us") + ttl_us).alias("_t"), F.col("_us").alias("_src"),
                      _bucket(F.col("_us") + ttl_us, ttl_us).alias("_b"), F.lit(1).alias("_kind"))
    points = d.select(*keys, F.col("_us").alias("_t"), F.lit(None).cast("long").alias("_src"), "_b",
                      F.lit(0).alias("_kind"))
    # From the latest back: probes sort before points at equal time, so a probe only sees strictly
    # later points. (A frame that ends at the current row is one pass; one that ends at
    # the last row is evaluated anew for every row.)
    w = (Window.partitionBy(*keys, "_b").orderBy(F.desc("_t"), F.desc("_kind"))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (points.unionByName(probes)
                   .withColumn("_hit", F.last(F.when(F.col("_kind") == 0, F.col("_t")), ignorenulls=True).over(w))
                   .filter(F.col("_kind") == 1))
    # Probes with nothing later in their bucket: first arrival of a later bucket.
    mins = d.groupBy(*keys, "_b").agg(F.min("_us").alias("_m")).withColumn("_kind", F.lit(0))
    miss = found.filter(F.col("_hit").isNull()).select(*keys, "_b").distinct().withColumn("_kind", F.lit(1))
    wb = (Window.partitionBy(*keys).orderBy(F.desc("_b"), F.desc("_kind"))
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = (mins.unionByName(miss, allowMissingColumns=True)
                 .withColumn("_later", F.last(F.when(F.col("_kind") == 0, F.col("_m")), ignorenulls=True).over(wb))
                 .filter(F.col("_kind") == 1).select(*keys, "_b", "_later"))
    return (found.join(later, [*keys, "_b"], "left")
                 .select(*keys, F.col("_src").alias("_us"), F.coalesce("_hit", "_later").alias("_nxt")))


def _chain(nxt: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _us) of every window start: the nxt-chain from each key's first arrival.

    Round k holds the first 2^k chain nodes of every key and the 2^k-step
    pointers; following those pointers from the known nodes yields the next 2^k
    nodes, and composing the pointers with themselves gives the 2^(k+1)-step
    ones; a pointer past the end of its chain is dropped, so the table shrinks
    every round. It joins itself, so each round's tables are
    checkpointed to the shared checkpoint folder (lineage cut, survives executor
    loss); there are O(log #windows) rounds.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(nxt.sparkSession)
    nxt = nxt.checkpoint(eager=True)
    pointer = nxt.filter(F.col("_nxt").isNotNull()).select(*keys, F.col("_us").alias("_u"), F.col("_nxt").alias("_v"))
    known = nxt.groupBy(*keys).agg(F.min("_us").alias("_u")).checkpoint(eager=True)
    while True:
        ahead = (known.join(pointer, [*keys, "_u"])
                      .select(*keys, F.col("_v").alias("_u")).checkpoint(eager=True))
        if ahead.isEmpty():
            return known.withColumnRenamed("_u", "_us")
        known = known.unionByName(ahead).checkpoint(eager=True)
        a, b = pointer.alias("a"), pointer.alias("b")
        cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a._v") == F.col("b._u")]
        pointer = (a.join(b, cond)
                    .select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a._u").alias("_u"),
                            F.col("b._v").alias("_v"))
                    .checkpoint(eager=True))


def anchored_counter_parallel(df: DataFrame, keys: list[str], ts: str, ttl_seconds: int, limit,
                              tiebreak: list[str] | None = None, seed: DataFrame | None = None) -> DataFrame:
    """L1-L4 like ``anchored_counter`` (same columns, same values) with no step that
    groups by the key alone: for keys too hot for one task."""
    tiebreak = ["_seedlast", *(tiebreak or [])]
    ttl_us = int(ttl_seconds) * _US
    lim = _limit_col(limit)
    base = df.withColumns({"_w": F.lit(1).cast("long"), "_seedlast": F.lit(1)})
    if seed is not None:
        s = seed.select(*keys, F.col("window_start").cast(df.schema[ts].dataType).alias(ts),
                        F.col("seed_count").cast("long").alias("_w"), F.lit(0).alias("_seedlast"))
        base = base.unionByName(s, allowMissingColumns=True)
    d = base.withColumn("_us", _micros(F.col(ts)))
    starts = _chain(_next_arrival(d.select(*keys, "_us").distinct(), keys, ttl_us), keys)
    starts = starts.select(*keys, F.col("_us").alias("_s"), _bucket(F.col("_us"), ttl_us).alias("_sb"))
    rows = d.withColumn("_rb", _bucket(F.col("_us"), ttl_us))
    own = starts.select(*keys, F.col("_sb").alias("_rb"), F.col("_s").alias("_own"))
    prev = starts.select(*keys, (F.col("_sb") + 1).alias("_rb"), F.col("_s").alias("_prev"))
    rows = rows.join(own, [*keys, "_rb"], "left").join(prev, [*keys, "_rb"], "left")
    rows = rows.withColumn("_wstart", F.when(F.col("_own").isNotNull() & (F.col("_own") <= F.col("_us")),
                                             F.col("_own")).otherwise(F.col("_prev")))
    ts_type = df.schema[ts].dataType.simpleString()
    return (running_total(rows, [*keys, "_wstart"], ["_us", *tiebreak], "_w", "window_count")
                .filter(F.col("_seedlast") == 1)
                .withColumns({"window_start": F.timestamp_micros("_wstart").cast(ts_type),
                              "limit_exceeded": F.col("window_count") > lim})
                .drop("_us", "_rb", "_own", "_prev", "_wstart", "_w", "_seedlast"))
