"""Event reports Q1-Q8: summaries, per-user statistics, top events, time series,
device breakdown and the daily rollup.

All are single aggregation plans over the (pruned, filtered) event scan. Counts
are LongType; every distinct count ignores NULLs, like SQL's COUNT(DISTINCT).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import event_filter, filter_apps

DEVICES = ("mobile", "desktop", "tablet")


def _distinct(col: str, approx: bool):
    return F.approx_count_distinct(col) if approx else F.count_distinct(F.col(col))


def _check_limit(limit) -> int:
    limit = 10 if limit is None else int(limit)
    if limit < 1:
        raise ValueError("limit must be >= 1")
    return limit


# Q1 ------------------------------------------------------------------------

def event_summary(ev: DataFrame, app_ids=None, event_name=None, start=None, end=None,
                  approx: bool = False) -> DataFrame:
    """Per event name: count, distinct users, per-device counts, distinct sessions.

    Groups by event name only, so apps merge. Devices outside mobile/desktop/tablet
    (or NULL) count in ``count`` only. Two distinct counts make Catalyst expand
    each row into one copy per distinct column and pre-aggregate on
    (event_name, user/session) before the shuffle, so a hot event name never
    sends its raw rows to one reducer.
    """
    df = event_filter(ev.select("app_id", "event_name", "user_id", "session_id", "device", "timestamp",
                                *(["event_date"] if "event_date" in ev.columns else [])),
                      app_ids, event_name, start, end)
    return (df.groupBy("event_name")
              .agg(F.count(F.lit(1)).alias("count"),
                   _distinct("user_id", approx).alias("unique_users"),
                   *[F.count_if(F.col("device") == d).alias(f"{d}_count") for d in DEVICES],
                   _distinct("session_id", approx).alias("unique_sessions"))
              .orderBy(F.desc("count"), F.asc("event_name")))


def event_summary_api(q1: DataFrame) -> DataFrame:
    """The reply shape {event, count, uniqueUsers, uniqueSessions, deviceData{...}}."""
    return q1.select(
        F.col("event_name").alias("event"),
        F.col("count"),
        F.col("unique_users").alias("uniqueUsers"),
        F.col("unique_sessions").alias("uniqueSessions"),
        F.struct(*[F.col(f"{d}_count").alias(d) for d in DEVICES]).alias("deviceData"))


# Q2 / Q2a / Q2b --------------------------------------------------------------

def _user_aggs():
    return [F.count(F.lit(1)).alias("total_events"),
            F.max("browser").alias("browser"),
            F.max("os").alias("os"),
            F.max("device").alias("device"),
            F.max("ip_address").alias("ip_address"),
            F.min("timestamp").alias("first_event"),
            F.max("timestamp").alias("last_event")]


def user_stats(ev: DataFrame, app_id, user_id) -> DataFrame:
    """Q2 for one (app, user): each MAX is taken per column independently.

    No row when the user has no events in the app.
    """
    df = ev.filter((F.col("app_id") == F.lit(app_id)) & (F.col("user_id") == F.lit(str(user_id))))
    return df.groupBy("user_id").agg(*_user_aggs())


def user_stats_all(ev: DataFrame, app_ids=None) -> DataFrame:
    """Q2 in bulk: one row per (app, non-NULL user); map-side partial aggregation."""
    df = filter_apps(ev, app_ids).filter(F.col("user_id").isNotNull())
    return df.groupBy("app_id", "user_id").agg(*_user_aggs())


def recent_events(ev: DataFrame, n: int = 10, app_id=None, user_id=None, app_ids=None) -> DataFrame:
    """The ``n`` newest events per (app, user) as rows with ``recent_rank`` 1..n.

    For one user this is a global top-n (TakeOrderedAndProject). In bulk it is a
    ranked window whose limit Catalyst pushes below the shuffle
    (WindowGroupLimit), so even a user holding a third of all rows contributes at
    most ``n`` rows per input partition to the exchange.
    """
    n = _check_limit(n)
    cols = ["app_id", "user_id", "event_name", "timestamp", "url", "id"]
    if app_id is not None:
        one = ev.filter((F.col("app_id") == F.lit(app_id)) & (F.col("user_id") == F.lit(str(user_id))))
        w = Window.partitionBy("app_id", "user_id").orderBy(F.desc("timestamp"), F.desc("id"))
        top = one.select(*cols).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
        return top.withColumn("recent_rank", F.row_number().over(w)).drop("id")
    df = filter_apps(ev, app_ids).filter(F.col("user_id").isNotNull()).select(*cols)
    w = Window.partitionBy("app_id", "user_id").orderBy(F.desc("timestamp"), F.desc("id"))
    return (df.withColumn("recent_rank", F.row_number().over(w))
              .filter(F.col("recent_rank") <= n)
              .drop("id"))


def user_stats_api(ev: DataFrame, app_ids=None, n: int = 10) -> DataFrame:
    """Q2 rows with nested ``deviceDetails`` and the <= n newest events as an array.

    The array is built from Q2a's already-limited rows, so each group collects at
    most ``n`` elements.
    """
    stats = user_stats_all(ev, app_ids)
    recent = (recent_events(ev, n, app_ids=app_ids)
              .groupBy("app_id", "user_id")
              .agg(F.sort_array(F.collect_list(F.struct("recent_rank", "event_name", "timestamp", "url")))
                   .alias("_recent")))
    return (stats.join(recent, ["app_id", "user_id"], "left")
                 .select("app_id", F.col("user_id").alias("userId"),
                         F.col("total_events").alias("totalEvents"),
                         F.col("first_event").alias("firstEvent"),
                         F.col("last_event").alias("lastEvent"),
                         F.struct("browser", "os", "device", F.col("ip_address").alias("ipAddress"))
                          .alias("deviceDetails"),
                         F.transform("_recent", lambda r: F.struct(
                             r["event_name"].alias("event_name"), r["timestamp"].alias("timestamp"),
                             r["url"].alias("url"))).alias("recentEvents")))


# Q3 / Q4 / Q5 ----------------------------------------------------------------

def top_events_raw(ev: DataFrame, app_ids=None, start=None, end=None, limit=10,
                   approx: bool = False) -> DataFrame:
    """Q3: count and distinct users per event name, top ``limit`` by count (name breaks ties)."""
    limit = _check_limit(limit)
    df = event_filter(ev, app_ids, None, start, end)
    return (df.groupBy("event_name")
              .agg(F.count(F.lit(1)).alias("count"), _distinct("user_id", approx).alias("unique_users"))
              .orderBy(F.desc("count"), F.asc("event_name"))
              .limit(limit))


def _since(rollup: DataFrame, as_of, days: int = 30):
    """The rollup days that the rolling report covers (all without ``as_of``)."""
    if as_of is None:
        return F.lit(True)
    return F.col("date") >= F.date_sub(F.to_date(F.lit(as_of).cast("timestamp_ntz")), days)


def top_events_rollup(rollup: DataFrame, app_ids=None, as_of=None, limit=10, days: int = 30,
                      users_estimate: bool = False) -> DataFrame:
    """Q4: the same from the daily rollup over ``date >= as_of_date - days``.

    ``unique_users`` is the sum of per-(app, day) distinct users, i.e. user-days,
    exactly as the rollup-backed report defines it; it is not a distinct count.
    With ``users_estimate`` (rollup built with ``with_sketch=True``) the per-day
    HLL sketches are merged into ``users_estimate``, an estimate of the distinct
    users over the whole range.
    """
    limit = _check_limit(limit)
    df = filter_apps(rollup, app_ids)
    df = df.filter(_since(rollup, as_of, days))
    aggs = [F.sum("event_count").cast("long").alias("count"), F.sum("unique_users").cast("long").alias("unique_users")]
    if users_estimate:
        aggs.append(F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("users_estimate"))
    return (df.groupBy("event_name").agg(*aggs)
              .orderBy(F.desc("count"), F.asc("event_name"))
              .limit(limit))


def top_events(ev: DataFrame, rollup: DataFrame | None = None, app_ids=None, start=None, end=None,
               as_of=None, limit=10) -> DataFrame:
    """Q5: rollup answer when no dates are given and the rollup has rows, else the base table.

    The only driver-side action is ``isEmpty()`` on the filtered rollup rows. A caller without
    a rollup passes None; a rollup that can't be read is an error.
    """
    if start is None and end is None and rollup is not None:
        if not filter_apps(rollup, app_ids).filter(_since(rollup, as_of)).isEmpty():
            return top_events_rollup(rollup, app_ids, as_of, limit)
    return top_events_raw(ev, app_ids, start, end, limit)


# Q6 / Q7 -------------------------------------------------------------------

def events_over_time(ev: DataFrame, app_ids=None, event_name=None, start=None, end=None,
                     interval: str = "day", approx: bool = False) -> DataFrame:
    """Q6: count and distinct users per period string, ascending.

    Only ``interval == 'hour'`` is hourly; every other value is daily. Rows are
    grouped by the truncated timestamp (a fixed-width key) and formatted after
    the aggregation. Periods without events are absent (no gap filling).
    """
    df = event_filter(ev, app_ids, event_name, start, end)
    if interval == "hour":
        bucket, fmt = F.date_trunc("hour", F.col("timestamp")), "yyyy-MM-dd HH:00:00"
    else:
        bucket, fmt = F.to_date("timestamp"), "yyyy-MM-dd"
    return (df.groupBy(bucket.alias("_bucket"))
              .agg(F.count(F.lit(1)).alias("count"), _distinct("user_id", approx).alias("unique_users"))
              .select(F.date_format("_bucket", fmt).alias("period"), "count", "unique_users")
              .orderBy("period"))


def device_distribution(ev: DataFrame, app_ids=None, start=None, end=None, approx: bool = False) -> DataFrame:
    """Q7: count and distinct users per non-NULL device, count descending."""
    df = event_filter(ev, app_ids, None, start, end).filter(F.col("device").isNotNull())
    return (df.groupBy("device")
              .agg(F.count(F.lit(1)).alias("count"), _distinct("user_id", approx).alias("unique_users"))
              .orderBy(F.desc("count"), F.asc("device")))


# Q8 ------------------------------------------------------------------------

ROLLUP_COLUMNS = ("app_id", "date", "event_name", "event_count", "unique_sessions", "unique_users",
                  "unique_devices", "unique_countries")


def daily_summary(ev: DataFrame, with_sketch: bool = False) -> DataFrame:
    """Q8: per (app, day, event name) the event count and four exact distinct counts.

    ``with_sketch`` adds ``users_sketch``, an HLL sketch of the day's users, so
    distinct users over several days can be estimated from the rollup alone.
    """
    day = F.col("event_date") if "event_date" in ev.columns else F.to_date("timestamp")
    aggs = [F.count(F.lit(1)).alias("event_count"),
            F.count_distinct("session_id").alias("unique_sessions"),
            F.count_distinct("user_id").alias("unique_users"),
            F.count_distinct("device").alias("unique_devices"),
            F.count_distinct("country").alias("unique_countries")]
    if with_sketch:
        aggs.append(F.hll_sketch_agg("user_id").alias("users_sketch"))
    out = ev.groupBy("app_id", day.alias("date"), "event_name").agg(*aggs)
    return out.select(*ROLLUP_COLUMNS, *(["users_sketch"] if with_sketch else []))
