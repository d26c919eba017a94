"""The registered queries over the fixture views, each paired with its oracle SQL.

Every query reads the fixture views of one scale-factor folder (derived by
Spark from the test tables), so its work grows with the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import limits as L
from ..operators import reports as R
from ..operators import reqlog as RL
from ..operators import security as S
from ..operators import tenants as T
from ..operators import upkeep as M
from ..session import ensure_checkpoint_dir
from ..sources import tables as TB
from ..sources.fixtures import AS_OF, Fixture, oracle_with
from ..streaming import collect as SC
from ..streaming import live as SL
from .admission_sql import admission_oracle
from .registry import REGISTRY, register

EV = "analytics_events"

# Filter-contract parameters of the "filtered" variants.
F_APPS = [1, 3, 5, 7]
F_EVENT = "click"
F_START = "2024-01-05"
F_END = "2024-01-20 12:00:00"

_Q1_SELECT = """
SELECT event_name, count(*) AS count, count(DISTINCT user_id) AS unique_users,
       count(*) FILTER (WHERE device = 'mobile') AS mobile_count,
       count(*) FILTER (WHERE device = 'desktop') AS desktop_count,
       count(*) FILTER (WHERE device = 'tablet') AS tablet_count,
       count(DISTINCT session_id) AS unique_sessions
FROM analytics_events {where}
GROUP BY event_name"""

_WHERE_F = (f"WHERE app_id IN ({', '.join(map(str, F_APPS))}) AND event_name = '{F_EVENT}' "
            f"AND \"timestamp\" >= TIMESTAMP '{F_START}' AND \"timestamp\" <= TIMESTAMP '{F_END}'")
_WHERE_T = (f"WHERE app_id IN ({', '.join(map(str, F_APPS))}) "
            f"AND \"timestamp\" >= TIMESTAMP '{F_START}' AND \"timestamp\" <= TIMESTAMP '{F_END}'")


# --- Q1 ---------------------------------------------------------------------

@register("q1_event_summary", oracle_with(_Q1_SELECT.format(where=""), EV))
def q1_event_summary(spark, sf_dir):
    """Q1 event summary over all apps and all time."""
    return R.event_summary(Fixture(spark, sf_dir).analytics_events)


@register("q1_event_summary_filtered", oracle_with(_Q1_SELECT.format(where=_WHERE_F), EV))
def q1_event_summary_filtered(spark, sf_dir):
    """Q1 with the full filter contract: app list, event name, inclusive time range."""
    return R.event_summary(Fixture(spark, sf_dir).analytics_events, F_APPS, F_EVENT, F_START, F_END)


@register("q1b_event_summary_api", oracle_with("""
SELECT event_name AS event, count, unique_users AS "uniqueUsers", unique_sessions AS "uniqueSessions",
       mobile_count AS mobile, desktop_count AS desktop, tablet_count AS tablet
FROM (""" + _Q1_SELECT.format(where="") + ") q", EV))
def q1b_event_summary_api(spark, sf_dir):
    """The reply shape of Q1, its nested device counts taken out again to compare them."""
    api = R.event_summary_api(R.event_summary(Fixture(spark, sf_dir).analytics_events))
    return api.select("event", "count", "uniqueUsers", "uniqueSessions", "deviceData.*")


# --- Q2 / Q2a ---------------------------------------------------------------

_Q2_AGGS = """count(*) AS total_events, max(browser) AS browser, max(os) AS os, max(device) AS device,
       max(ip_address) AS ip_address, min("timestamp") AS first_event, max("timestamp") AS last_event"""


@register("q2_user_stats", oracle_with(f"""
SELECT user_id, {_Q2_AGGS}
FROM analytics_events WHERE app_id = 3 AND user_id = '7' GROUP BY user_id""", EV))
def q2_user_stats(spark, sf_dir):
    """Q2 for one (app, user) pair: independent per-column MAX, first/last event."""
    return R.user_stats(Fixture(spark, sf_dir).analytics_events, 3, "7")


@register("q2_user_stats_all", oracle_with(f"""
SELECT app_id, user_id, {_Q2_AGGS}
FROM analytics_events WHERE user_id IS NOT NULL GROUP BY app_id, user_id""", EV))
def q2_user_stats_all(spark, sf_dir):
    """Q2 in bulk: one row per (app, user) over the whole table."""
    return R.user_stats_all(Fixture(spark, sf_dir).analytics_events)


@register("q2b_user_stats_api", oracle_with(f"""
SELECT s.app_id, s.user_id AS "userId", total_events AS "totalEvents", first_event AS "firstEvent", last_event AS "lastEvent",
       browser, os, device, ip_address AS "ipAddress", n_recent, newest
FROM (SELECT app_id, user_id, {_Q2_AGGS} FROM analytics_events WHERE user_id IS NOT NULL GROUP BY app_id, user_id) s
JOIN (SELECT app_id, user_id, CAST(count(*) AS INTEGER) AS n_recent,
             string_agg(event_name || '@' || strftime("timestamp", '%Y-%m-%d %H:%M:%S'), ',' ORDER BY rank) AS newest
      FROM (SELECT *, row_number() OVER (PARTITION BY app_id, user_id ORDER BY "timestamp" DESC, id DESC) AS rank
            FROM analytics_events WHERE user_id IS NOT NULL) r
      WHERE rank <= 10 GROUP BY app_id, user_id) t ON s.app_id = t.app_id AND s.user_id = t.user_id""", EV))
def q2b_user_stats_api(spark, sf_dir):
    """The reply shape of every user, its nested details and newest events flattened to compare them."""
    api = R.user_stats_api(Fixture(spark, sf_dir).analytics_events)
    newest = F.transform("recentEvents", lambda r: F.concat_ws("@", r["event_name"], F.date_format(r["timestamp"], "yyyy-MM-dd HH:mm:ss")))
    return api.select("app_id", "userId", "totalEvents", "firstEvent", "lastEvent", "deviceDetails.*",
                      F.size("recentEvents").alias("n_recent"), F.array_join(newest, ",").alias("newest"))


@register("q2a_recent_events", oracle_with("""
SELECT app_id, user_id, event_name, "timestamp", url, recent_rank FROM (
  SELECT app_id, user_id, event_name, "timestamp", url,
         CAST(row_number() OVER (PARTITION BY app_id, user_id ORDER BY "timestamp" DESC, id DESC) AS INTEGER) AS recent_rank
  FROM analytics_events WHERE user_id IS NOT NULL) t
WHERE recent_rank <= 10""", EV))
def q2a_recent_events(spark, sf_dir):
    """The ten newest events of every (app, user), ranked."""
    return R.recent_events(Fixture(spark, sf_dir).analytics_events, 10)


@register("q2a_recent_events_one_user", oracle_with("""
SELECT app_id, user_id, event_name, "timestamp", url,
       CAST(row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS INTEGER) AS recent_rank
FROM analytics_events WHERE app_id = 3 AND user_id = '7'
ORDER BY "timestamp" DESC, id DESC LIMIT 10""", EV))
def q2a_recent_events_one_user(spark, sf_dir):
    """Q2a for one (app, user): global top-10 by time."""
    return R.recent_events(Fixture(spark, sf_dir).analytics_events, 10, app_id=3, user_id="7")


# --- Q3 / Q4 / Q5 -----------------------------------------------------------

@register("q3_top_events_raw", oracle_with(f"""
SELECT event_name, count(*) AS count, count(DISTINCT user_id) AS unique_users
FROM analytics_events {_WHERE_T}
GROUP BY event_name ORDER BY count DESC, event_name LIMIT 3""", EV))
def q3_top_events_raw(spark, sf_dir):
    """Q3 top-3 events from the base table with an app list and dates."""
    return R.top_events_raw(Fixture(spark, sf_dir).analytics_events, F_APPS, F_START, F_END, 3)


_ROLLUP_SQL = """
daily AS (
  SELECT app_id, CAST("timestamp" AS DATE) AS date, event_name, count(*) AS event_count,
         count(DISTINCT session_id) AS unique_sessions, count(DISTINCT user_id) AS unique_users,
         count(DISTINCT device) AS unique_devices, count(DISTINCT country) AS unique_countries
  FROM analytics_events GROUP BY 1, 2, 3)"""


@register("q4_top_events_rollup", oracle_with(f"""
SELECT event_name, CAST(sum(event_count) AS BIGINT) AS count, CAST(sum(unique_users) AS BIGINT) AS unique_users
FROM daily WHERE date >= DATE '{AS_OF[:10]}' - INTERVAL 30 DAY
GROUP BY event_name ORDER BY count DESC, event_name LIMIT 10""", EV, more=_ROLLUP_SQL))
def q4_top_events_rollup(spark, sf_dir):
    """Q4 top events from the daily rollup (user-days summed) over the last 30 days."""
    ev = Fixture(spark, sf_dir).analytics_events
    return R.top_events_rollup(R.daily_summary(ev), None, AS_OF, 10)


@register("q5_top_events_dispatch", oracle_with(f"""
SELECT event_name, CAST(sum(event_count) AS BIGINT) AS count, CAST(sum(unique_users) AS BIGINT) AS unique_users
FROM daily WHERE date >= DATE '{AS_OF[:10]}' - INTERVAL 30 DAY
GROUP BY event_name ORDER BY count DESC, event_name LIMIT 10""", EV, more=_ROLLUP_SQL))
def q5_top_events_dispatch(spark, sf_dir):
    """Q5 without dates: answered from the (non-empty) rollup."""
    ev = Fixture(spark, sf_dir).analytics_events
    return R.top_events(ev, R.daily_summary(ev), None, None, None, AS_OF, 10)


@register("q5_top_events_dispatch_dated", oracle_with(f"""
SELECT event_name, count(*) AS count, count(DISTINCT user_id) AS unique_users
FROM analytics_events {_WHERE_T}
GROUP BY event_name ORDER BY count DESC, event_name LIMIT 10""", EV))
def q5_top_events_dispatch_dated(spark, sf_dir):
    """Q5 with dates: answered from the base table."""
    ev = Fixture(spark, sf_dir).analytics_events
    return R.top_events(ev, R.daily_summary(ev), F_APPS, F_START, F_END, AS_OF, 10)


# --- Q6 / Q7 / Q8 -----------------------------------------------------------

@register("q6_events_over_time_day", oracle_with("""
SELECT strftime("timestamp", '%Y-%m-%d') AS period, count(*) AS count, count(DISTINCT user_id) AS unique_users
FROM analytics_events GROUP BY 1 ORDER BY 1""", EV))
def q6_events_over_time_day(spark, sf_dir):
    """Q6 daily series over all apps."""
    return R.events_over_time(Fixture(spark, sf_dir).analytics_events, interval="day")


@register("q6_events_over_time_hour", oracle_with(f"""
SELECT strftime("timestamp", '%Y-%m-%d %H:00:00') AS period, count(*) AS count,
       count(DISTINCT user_id) AS unique_users
FROM analytics_events {_WHERE_F} GROUP BY 1 ORDER BY 1""", EV))
def q6_events_over_time_hour(spark, sf_dir):
    """Q6 hourly series with the full filter contract."""
    return R.events_over_time(Fixture(spark, sf_dir).analytics_events, F_APPS, F_EVENT, F_START, F_END,
                              interval="hour")


@register("q7_device_distribution", oracle_with("""
SELECT device, count(*) AS count, count(DISTINCT user_id) AS unique_users
FROM analytics_events WHERE device IS NOT NULL GROUP BY device""", EV))
def q7_device_distribution(spark, sf_dir):
    """Q7 device breakdown over all apps."""
    return R.device_distribution(Fixture(spark, sf_dir).analytics_events)


@register("q8_daily_summary", oracle_with(f"""
SELECT * FROM daily""", EV, more=_ROLLUP_SQL))
def q8_daily_summary(spark, sf_dir):
    """Q8 daily rollup: per (app, day, event) count and four exact distinct counts."""
    return R.daily_summary(Fixture(spark, sf_dir).analytics_events)


# --- Q9 - Q19: tenants, keys, users ----------------------------------------


_AS_OF_TS = f"TIMESTAMP '{AS_OF}'"
# One scalar subquery for each figure of an app.
def _events_since(days: int, app: str = "= a.id") -> str:
    return (f"(SELECT count(*) FROM analytics_events e WHERE e.app_id {app} "
            f"AND e.\"timestamp\" > {_AS_OF_TS} - INTERVAL {days} DAY)")


_ACTIVE_KEYS = "(SELECT count(*) FROM api_keys k WHERE k.app_id = a.id AND k.is_active)"
# The reference counts a key once for each event row that it is joined to (once without events).
_ACTIVE_KEY_ROWS = ("(SELECT count(*) FROM api_keys k LEFT JOIN analytics_events e ON e.app_id = k.app_id "
                    "WHERE k.app_id = a.id AND k.is_active)")


@register("q9_app_with_stats", oracle_with(f"""
SELECT a.*, {_ACTIVE_KEYS} AS active_api_keys, {_events_since(30)} AS events_last_30_days FROM apps a""",
    "apps", "api_keys", EV))
def q9_app_with_stats(spark, sf_dir):
    """Q9 for every app: distinct active keys and distinct events of the last 30 days."""
    fx = Fixture(spark, sf_dir)
    return T.app_with_stats(fx.apps, fx.api_keys, fx.analytics_events, AS_OF)


_Q10_SQL = f"""
SELECT a.*, {{keys}} AS active_api_keys, {_events_since(7)} AS events_last_7_days,
       (SELECT max(e."timestamp") FROM analytics_events e WHERE e.app_id = a.id) AS last_event_at FROM apps a"""


@register("q10_owner_apps", oracle_with(_Q10_SQL.format(keys=_ACTIVE_KEY_ROWS), "apps", "api_keys", EV))
def q10_owner_apps(spark, sf_dir):
    """Q10 for every owner, faithful fan-out key count (active keys x max(event rows, 1))."""
    fx = Fixture(spark, sf_dir)
    return T.owner_apps(fx.apps, fx.api_keys, fx.analytics_events, AS_OF)


@register("q10_owner_apps_exact", oracle_with(_Q10_SQL.format(keys=_ACTIVE_KEYS), "apps", "api_keys", EV))
def q10_owner_apps_exact(spark, sf_dir):
    """Q10 for every owner with the exact distinct active-key count."""
    fx = Fixture(spark, sf_dir)
    return T.owner_apps(fx.apps, fx.api_keys, fx.analytics_events, AS_OF, exact_keys=True)


_OWN = "IN (SELECT id FROM apps WHERE user_id = u.id)"
_Q11_FIGURES = f"""(SELECT count(*) FROM apps a WHERE a.user_id = u.id) AS total_apps,
       (SELECT count(*) FROM api_keys k WHERE k.app_id {_OWN} AND k.is_active) AS total_active_keys,
       {_events_since(7, _OWN)} AS events_last_7_days, {_events_since(30, _OWN)} AS events_last_30_days"""


@register("q11_dashboard_stats", oracle_with(f"""
SELECT u.id AS user_id, {_Q11_FIGURES} FROM users u""", "users", "apps", "api_keys", EV))
def q11_dashboard_stats(spark, sf_dir):
    """Q11 for every user: apps, distinct active keys, distinct events in 7 and 30 days."""
    fx = Fixture(spark, sf_dir)
    return T.dashboard_stats(fx.users, fx.apps, fx.api_keys, fx.analytics_events, AS_OF)


@register("q11_dashboard_stats_one_user", oracle_with(f"""
SELECT {_Q11_FIGURES} FROM (SELECT 3 AS id) u""", "users", "apps", "api_keys", EV))
def q11_dashboard_stats_one_user(spark, sf_dir):
    """Q11 for one user: always exactly one row."""
    fx = Fixture(spark, sf_dir)
    return T.dashboard_stats(fx.users, fx.apps, fx.api_keys, fx.analytics_events, AS_OF, user_id=3)


@register("q11_dashboard_stats_unknown_user", oracle_with(f"""
SELECT {_Q11_FIGURES} FROM (SELECT 100000 AS id) u""", "users", "apps", "api_keys", EV))
def q11_dashboard_stats_unknown_user(spark, sf_dir):
    """Q11 for an id with no user row: one row of zeros."""
    fx = Fixture(spark, sf_dir)
    return T.dashboard_stats(fx.users, fx.apps, fx.api_keys, fx.analytics_events, AS_OF, user_id=100000)


@register("q11b_dashboard", oracle_with("""
SELECT s.*, q10.id AS app_id, q10.app_name, q10.app_url, q10.description, q10.created_at,
       q10.active_api_keys, q10.events_last_7_days AS app_events_last_7_days, q10.last_event_at
FROM s LEFT JOIN q10 ON q10.user_id = s.user_id""", "users", "apps", "api_keys", EV,
    more=f"s AS (SELECT u.id AS user_id, {_Q11_FIGURES} FROM users u),\nq10 AS ({_Q10_SQL.format(keys=_ACTIVE_KEY_ROWS)})"))
def q11b_dashboard(spark, sf_dir):
    """Q11b for every user, flat: dashboard numbers joined to each of the user's Q10 rows."""
    fx = Fixture(spark, sf_dir)
    return T.dashboard(fx.users, fx.apps, fx.api_keys, fx.analytics_events, AS_OF)


# The same reports from the app-day rollup: only the days that the rolling bounds cut are read raw.

_APP_DAYS: dict = {}


def _app_days(spark, sf_dir):
    """The stored event table and the app-day rollup of it (once per session and folder)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    ev_path, _ = _stored_tables(spark, sf_dir)
    if key not in _APP_DAYS:
        _APP_DAYS[key] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-app-days/{uuid.uuid4().hex}"
        T.app_days(spark.read.parquet(ev_path)).write.parquet(_APP_DAYS[key])
    return spark.read.parquet(ev_path), spark.read.parquet(_APP_DAYS[key])


@register("q9_app_with_stats_rollup", oracle_with(f"""
SELECT a.*, {_ACTIVE_KEYS} AS active_api_keys, {_events_since(30)} AS events_last_30_days FROM apps a""",
    "apps", "api_keys", EV))
def q9_app_with_stats_rollup(spark, sf_dir):
    """Q9 for every app from the app-day rollup and the one cut day."""
    fx, (ev, days) = Fixture(spark, sf_dir), _app_days(spark, sf_dir)
    return T.app_with_stats(fx.apps, fx.api_keys, ev, AS_OF, rollup=days)


@register("q10_owner_apps_rollup", oracle_with(_Q10_SQL.format(keys=_ACTIVE_KEY_ROWS), "apps", "api_keys", EV))
def q10_owner_apps_rollup(spark, sf_dir):
    """Q10 for every owner from the app-day rollup and the one cut day."""
    fx, (ev, days) = Fixture(spark, sf_dir), _app_days(spark, sf_dir)
    return T.owner_apps(fx.apps, fx.api_keys, ev, AS_OF, rollup=days)


@register("q11b_dashboard_rollup", oracle_with("""
SELECT s.*, q10.id AS app_id, q10.app_name, q10.app_url, q10.description, q10.created_at,
       q10.active_api_keys, q10.events_last_7_days AS app_events_last_7_days, q10.last_event_at
FROM s LEFT JOIN q10 ON q10.user_id = s.user_id""", "users", "apps", "api_keys", EV,
    more=f"s AS (SELECT u.id AS user_id, {_Q11_FIGURES} FROM users u),\nq10 AS ({_Q10_SQL.format(keys=_ACTIVE_KEY_ROWS)})"))
def q11b_dashboard_rollup(spark, sf_dir):
    """Q11b for every user from the app-day rollup and the two cut days."""
    fx, (ev, days) = Fixture(spark, sf_dir), _app_days(spark, sf_dir)
    return T.dashboard(fx.users, fx.apps, fx.api_keys, ev, AS_OF, rollup=days)


@register("q12_apps_with_keys", oracle_with("""
SELECT q10.*, ak.id AS key_id, ak.key_prefix AS key_key_prefix, ak.name AS key_name,
       ak.is_active AS key_is_active, ak.expires_at AS key_expires_at,
       CAST(NULL AS TIMESTAMP) AS key_last_used_at, ak.created_at AS key_created_at,
       ak.can_write AS key_can_write, ak.rate_limit_per_hour AS key_rate_limit_per_hour
FROM q10 LEFT JOIN api_keys ak ON ak.app_id = q10.id""", "apps", "api_keys", EV,
    more=f"q10 AS ({_Q10_SQL.format(keys=_ACTIVE_KEY_ROWS)})"))
def q12_apps_with_keys(spark, sf_dir):
    """Q12 for every owner, flat: each Q10 row with each of its keys (no hash, no IP list)."""
    fx = Fixture(spark, sf_dir)
    out = T.apps_with_keys(fx.apps, fx.api_keys, fx.analytics_events, AS_OF, nested=False)
    return out.withColumn("key_can_write", F.col("key_permissions.write")).drop("key_permissions")


@register("q13_apps_of_owner", oracle_with("SELECT * FROM apps WHERE user_id = 3", "apps"))
def q13_apps_of_owner(spark, sf_dir):
    """Q13: the apps of owner 3, newest first."""
    return T.apps_of_owner(Fixture(spark, sf_dir).apps, 3)


def _event_pairs(fx):
    ev = fx.analytics_events
    return (ev.filter(F.col("user_id").isNotNull())
              .select("app_id", F.col("user_id").cast("long").alias("user_id")).distinct())


@register("q14_is_owner", oracle_with("""
SELECT p.app_id, p.user_id,
       EXISTS (SELECT 1 FROM apps a WHERE a.id = p.app_id AND a.user_id = p.user_id) AS is_owner
FROM pairs p""", "apps", EV,
    more="pairs AS (SELECT DISTINCT app_id, CAST(user_id AS BIGINT) AS user_id FROM analytics_events "
         "WHERE user_id IS NOT NULL)"))
def q14_is_owner(spark, sf_dir):
    """Q14: ownership test for every (app, user) pair seen in the events."""
    fx = Fixture(spark, sf_dir)
    return T.is_owner(fx.apps, _event_pairs(fx))


_KEY_FLAT = ("id", "app_id", "key_hash", "key_prefix", "name", "is_active", "rate_limit_per_hour",
             "expires_at", "created_at")


@register("q15_key_lookup", oracle_with(f"""
SELECT {', '.join('ak.' + c for c in _KEY_FLAT)}, ak.can_write, ak.allowed_ip, a.user_id, a.app_name
FROM api_keys ak JOIN apps a ON ak.app_id = a.id
WHERE ak.key_hash IN (SELECT sha256(api_key) FROM raw_requests WHERE api_key IS NOT NULL)""",
    "api_keys", "apps", "raw_requests"))
def q15_key_lookup(spark, sf_dir):
    """Q15: key rows with owner and app name for every key hash presented in the requests."""
    fx = Fixture(spark, sf_dir)
    hashes = (fx.raw_requests.filter(F.col("api_key").isNotNull())
              .select(F.sha2("api_key", 256).alias("key_hash")))
    out = T.key_lookup(fx.api_keys, fx.apps, hashes)
    return out.select(*_KEY_FLAT, F.col("permissions.write").alias("can_write"),
                      F.array_join("allowed_ips", ",").alias("allowed_ip"), "user_id", "app_name")


@register("q16_keys_of_app", oracle_with("""
SELECT id, app_id, key_prefix, name, is_active, expires_at, CAST(NULL AS TIMESTAMP) AS last_used_at,
       created_at, CAST(NULL AS TIMESTAMP) AS revoked_at, can_write, allowed_ip, rate_limit_per_hour
FROM api_keys""", "api_keys"))
def q16_keys_of_app(spark, sf_dir):
    """Q16 for every app: the listed key columns without the hash, newest first."""
    out = T.keys_of_app(Fixture(spark, sf_dir).api_keys)
    return (out.withColumn("can_write", F.col("permissions.write"))
               .withColumn("allowed_ip", F.array_join("allowed_ips", ","))
               .drop("permissions", "allowed_ips"))


@register("q17_bulk_lookup", oracle_with("""
SELECT * FROM users WHERE google_id IN (SELECT concat('g-', CAST(user_id AS VARCHAR)) FROM apps)""",
    "users", "apps"))
def q17_bulk_lookup(spark, sf_dir):
    """Q17: user rows looked up by google_id for every app owner (one semi join)."""
    fx = Fixture(spark, sf_dir)
    wanted = fx.apps.select(F.concat(F.lit("g-"), F.col("user_id").cast("string")).alias("google_id"))
    return T.bulk_lookup(fx.users, "google_id", wanted)


_CALLERS = "ids AS (SELECT DISTINCT user_id FROM security_events)"


def _callers(fx):
    return fx.security_events.select("user_id").distinct()


@register("q18_user_status", oracle_with("""
SELECT i.user_id, coalesce(u.is_active, false) AS is_active, coalesce(u.role, 'user') AS role,
       NOT coalesce(u.is_active, false) AS blocked
FROM ids i LEFT JOIN users u ON u.id = i.user_id""", "users", "security_events", more=_CALLERS))
def q18_user_status(spark, sf_dir):
    """Q18: active flag, role and blocked flag for every user id seen in the security log."""
    fx = Fixture(spark, sf_dir)
    return T.user_status(fx.users, _callers(fx))


@register("q19_user_security_level", oracle_with("""
SELECT user_id, security_level, security_level >= 3 AS allowed FROM (
  SELECT i.user_id,
         CASE WHEN u.id IS NULL THEN 2
              ELSE CASE coalesce(u.role, 'user') WHEN 'user' THEN 2 WHEN 'admin' THEN 3
                   WHEN 'super_admin' THEN 4 ELSE 2 END END AS security_level
  FROM ids i LEFT JOIN users u ON u.id = i.user_id) t""", "users", "security_events", more=_CALLERS))
def q19_user_security_level(spark, sf_dir):
    """Q19: security level (guest falls back to USER, as the reference does) vs. ADMIN."""
    fx = Fixture(spark, sf_dir)
    return T.security_levels(_callers(fx), fx.users, required=3)


# --- Q20 - Q23: security log ---------------------------------------------------


@register("q20_security_recent", oracle_with(f"""
SELECT * FROM security_events WHERE created_at > {_AS_OF_TS} - INTERVAL 24 HOUR""", "security_events"))
def q20_security_recent(spark, sf_dir):
    """Q20: security events of the last 24 hours, newest first."""
    return S.security_recent(Fixture(spark, sf_dir).security_events, AS_OF, 24)


@register("q21_security_open_high", oracle_with("""
SELECT * FROM security_events WHERE severity IN ('high', 'critical') AND resolved = false""", "security_events"))
def q21_security_open_high(spark, sf_dir):
    """Q21: unresolved high/critical security events."""
    return S.security_open_high(Fixture(spark, sf_dir).security_events)


@register("q22_failed_key_ips", oracle_with(f"""
SELECT ip_address, count(*) AS attempts FROM security_events
WHERE event_type = 'api_key_invalid' AND created_at > {_AS_OF_TS} - INTERVAL 24 HOUR
GROUP BY ip_address HAVING count(*) > 1""", "security_events"))
def q22_failed_key_ips(spark, sf_dir):
    """Q22: IPs with more than one invalid-key attempt in the last 24 hours (thresholds scaled to the data)."""
    return S.failed_key_ips(Fixture(spark, sf_dir).security_events, AS_OF, "24 HOURS", 1)


@register("q23_security_critical", oracle_with("""
SELECT * FROM security_events WHERE severity = 'critical'""", "security_events"))
def q23_security_critical(spark, sf_dir):
    """Q23: critical security events."""
    return S.security_critical(Fixture(spark, sf_dir).security_events)


# --- Q24 - Q26, Q29: request log ----------------------------------------------

@register("q24_request_metrics", oracle_with("""
SELECT count(*) AS total_requests, count(*) FILTER (WHERE status < 400) AS successful_requests,
       count(*) FILTER (WHERE status >= 400) AS failed_requests,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE status < 400) / count(*) * 100, 2) ELSE 100.0 END
         AS success_rate,
       CASE WHEN count(*) > 0 THEN round(sum(duration_ms) / count(*), 2) ELSE 0.0 END AS avg_response_ms,
       count(*) FILTER (WHERE duration_ms > 1000) AS slow_requests
FROM request_log""", "request_log"))
def q24_request_metrics(spark, sf_dir):
    """Q24: request totals, success rate, mean time and slow count over the whole log."""
    return RL.request_metrics(Fixture(spark, sf_dir).request_log)


@register("q25_top_endpoints", oracle_with("""
SELECT endpoint, count(*) AS count, round(sum(duration_ms) / count(*), 2) AS avg_time_ms,
       count(*) FILTER (WHERE status >= 400) AS errors,
       round(count(*) FILTER (WHERE status >= 400) / count(*) * 100, 2) AS error_rate
FROM request_log GROUP BY endpoint ORDER BY count DESC, endpoint LIMIT 10""", "request_log"))
def q25_top_endpoints(spark, sf_dir):
    """Q25: ten busiest endpoints."""
    return RL.top_endpoints(Fixture(spark, sf_dir).request_log, 10)


@register("q26_slowest_endpoints", oracle_with("""
SELECT endpoint, round(sum(duration_ms) / count(*), 2) AS avg_time_ms, count(*) AS count
FROM request_log GROUP BY endpoint ORDER BY sum(duration_ms) / count(*) DESC, endpoint LIMIT 10""",
    "request_log"))
def q26_slowest_endpoints(spark, sf_dir):
    """Q26: ten slowest endpoints by mean time."""
    return RL.slowest_endpoints(Fixture(spark, sf_dir).request_log, 10)


@register("q29_slow_requests", oracle_with("""
SELECT * FROM request_log WHERE duration_ms > 1000""", "request_log"))
def q29_slow_requests(spark, sf_dir):
    """Q29: log entries slower than one second."""
    return RL.slow_queries(Fixture(spark, sf_dir).request_log, 1000)


# --- I1 - I15: admission ---------------------------------------------------------


# The fixture's keys allow 3 requests per counter window and see ~7 requests per
# key and day, so the hourly counter is replayed with a one-day lifetime to make
# it bite (thresholds scaled to the data).
ADM_KEY_TTL = 86400
ADM_COLLECT = {"collect_limit": 2, "collect_ttl": 86400}


_REQUESTS: dict = {}


def _requests(spark, sf_dir):
    """The fixture requests as a stored table: admission numbers its rows on a file scan."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _REQUESTS:
        _REQUESTS[key] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-requests/{uuid.uuid4().hex}"
        Fixture(spark, sf_dir).raw_requests.write.parquet(_REQUESTS[key])
    return spark.read.parquet(_REQUESTS[key])


def _admission(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return I.admission(_requests(spark, sf_dir), fx.api_keys, fx.apps, as_of=AS_OF, key_hour_ttl=ADM_KEY_TTL, **ADM_COLLECT)


_SEVERITY_SQL = "CASE reject_reason " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in I.SECURITY_SEVERITY.items()) + " END"


@register("i_admission_outcome", admission_oracle("""
SELECT received_at, api_key, client_ip, event, reject_reason, validation_errors FROM outcome""", AS_OF, ADM_KEY_TTL))
def i_admission_outcome(spark, sf_dir):
    """Every raw request with its first failing step (NULL = accepted) and validation errors."""
    adm = _admission(spark, sf_dir)
    return adm.select("received_at", "api_key", "client_ip", "event", "reject_reason",
                      F.array_join("validation_errors", ",").alias("validation_errors"))


@register("i_admission_reason_counts", admission_oracle("""
SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS requests FROM outcome GROUP BY 1""",
    AS_OF, ADM_KEY_TTL))
def i_admission_reason_counts(spark, sf_dir):
    """Outcome counts per reject reason ('accepted' for admitted requests)."""
    adm = _admission(spark, sf_dir)
    return (adm.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))
               .agg(F.count(F.lit(1)).alias("requests")))


@register("i14_accepted_events", admission_oracle("""
SELECT app_id, event_name, url, referrer, device_out AS device, ip_address, user_id, session_id, ts AS "timestamp",
       metadata, browser, os, screen_size, country, city, received_at AS created_at, CAST(ts AS DATE) AS event_date
FROM outcome WHERE reject_reason IS NULL""", AS_OF, ADM_KEY_TTL))
def i14_accepted_events(spark, sf_dir):
    """Accepted requests enriched into the event-table layout (ids left out: they are UUIDs)."""
    return I.accepted_events(_admission(spark, sf_dir), with_ids=False)


@register("i11_accepted_events_by_agent", admission_oracle("""
SELECT app_id, event_name, user_id, session_id, ts AS "timestamp", device_out AS device, browser, os
FROM outcome WHERE reject_reason IS NULL""", AS_OF, ADM_KEY_TTL))
def i11_accepted_events_by_agent(spark, sf_dir):
    """Enrichment from a table of the distinct user agents, on which alone the rules run."""
    fx = Fixture(spark, sf_dir)
    adm = I.admission(_requests(spark, sf_dir), fx.api_keys, fx.apps, as_of=AS_OF, key_hour_ttl=ADM_KEY_TTL,
                      distinct_agents=True, **ADM_COLLECT)
    return I.accepted_events(adm, with_ids=False).select(
        "app_id", "event_name", "user_id", "session_id", "timestamp", "device", "browser", "os")


_DIGITS = "md5(coalesce(api_key, '') || strftime(received_at, '%Y-%m-%d %H:%M:%S'))"
_UUID_TEXT = " || '-' || ".join(f"substr({_DIGITS}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


@register("c12_c13_formats", oracle_with(f"""
SELECT length(api_key) = 64 AS raw_key_ok, length(sha256(api_key)) = 64 AS hashed_key_ok,
       regexp_matches({_UUID_TEXT}, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-4[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$') AS uuid_ok,
       count(*) AS requests
FROM raw_requests GROUP BY 1, 2, 3""", "raw_requests"))
def c12_c13_formats(spark, sf_dir):
    """Key length and UUID-v4 checks over every request (keys, their hashes, and texts of
    the UUID layout made of a request's hash, of which one in 64 has the version and variant digits)."""
    from ..functions import keys as K
    from ..functions import text as X
    raw = Fixture(spark, sf_dir).raw_requests
    digits = F.md5(F.concat(F.coalesce("api_key", F.lit("")), F.date_format("received_at", "yyyy-MM-dd HH:mm:ss")))
    layout = F.concat_ws("-", *[F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return raw.groupBy(K.key_well_formed(F.col("api_key")).alias("raw_key_ok"),
                       K.key_well_formed(K.key_hash(F.col("api_key"))).alias("hashed_key_ok"),
                       X.is_uuid_v4(layout).alias("uuid_ok")).agg(F.count(F.lit(1)).alias("requests"))


@register("s5_receipts", admission_oracle("""
SELECT event_name AS event, ts AS "timestamp" FROM outcome WHERE reject_reason IS NULL""", AS_OF, ADM_KEY_TTL))
def s5_receipts(spark, sf_dir):
    """The receipt of every accepted request (its id is a fresh UUID and left out)."""
    return I.receipts(I.accepted_events(_admission(spark, sf_dir))).drop("id")


@register("i15_security_events", admission_oracle(f"""
SELECT reject_reason AS event_type, {_SEVERITY_SQL} AS severity, client_ip AS ip_address,
       CAST(NULL AS VARCHAR) AS user_id, 'Security event: ' || reject_reason AS description,
       CAST(CASE reject_reason WHEN 'api_key_ip_blocked' THEN to_json({{'apiKeyId': key_id, 'allowedIPs': [key_ip]}})
                               WHEN 'api_key_rate_limit' THEN to_json({{'apiKeyId': key_id}})
                               ELSE '{{}}' END AS VARCHAR) AS metadata,
       false AS resolved, received_at AS created_at
FROM outcome WHERE reject_reason IN ({", ".join(repr(k) for k in I.SECURITY_SEVERITY)})""", AS_OF, ADM_KEY_TTL))
def i15_security_events(spark, sf_dir):
    """Security events emitted by the key checks."""
    return I.security_events(_admission(spark, sf_dir))


_KEY_CHECK_SQL = oracle_with("""
SELECT r.received_at, r.api_key, r.client_ip,
       CASE WHEN r.api_key IS NULL OR r.api_key = '' THEN 'api_key_missing'
            WHEN k.id IS NULL OR NOT coalesce(k.is_active, false)
                 OR (k.expires_at IS NOT NULL AND k.expires_at < r.received_at) THEN 'api_key_invalid'
            WHEN k.allowed_ip IS NOT NULL AND k.allowed_ip <> r.client_ip AND k.allowed_ip <> '*'
                 THEN 'api_key_ip_blocked'
            WHEN NOT k.can_write THEN 'no_permission' END AS key_outcome
FROM raw_requests r
LEFT JOIN (SELECT ak.* FROM api_keys ak JOIN apps a ON ak.app_id = a.id) k ON k.key_hash = sha256(r.api_key)""",
    "raw_requests", "api_keys", "apps")


def _key_details(fx):
    return (fx.api_keys.join(fx.apps.select(F.col("id").alias("_a")), F.col("app_id") == F.col("_a"), "inner")
            .select("key_hash", F.col("id").alias("key_id"), "is_active", "expires_at", "allowed_ips", "permissions"))


def _key_outcome(j):
    from ..functions import keys as K
    outcome = (F.when(F.col("api_key").isNull() | (F.col("api_key") == ""), F.lit("api_key_missing"))
                .when(F.col("key_id").isNull()
                      | ~K.key_usable(F.col("is_active"), F.col("expires_at"), F.col("received_at")),
                      F.lit("api_key_invalid"))
                .when(~K.ip_allowed(F.col("allowed_ips"), F.col("client_ip")), F.lit("api_key_ip_blocked"))
                .when(~K.has_permission(F.col("permissions"), "write"), F.lit("no_permission")))
    return j.select("received_at", "api_key", "client_ip", outcome.alias("key_outcome"))


@register("i_key_check", _KEY_CHECK_SQL)
def i_key_check(spark, sf_dir):
    """The key checks alone (missing, unknown/inactive/expired, IP allow-list, write permission)."""
    from ..functions import keys as K
    fx = Fixture(spark, sf_dir)
    raw, kd = fx.raw_requests, _key_details(fx)
    return _key_outcome(raw.join(kd, K.key_hash(raw["api_key"]) == kd["key_hash"], "left"))


@register("j7_key_check_spread", _KEY_CHECK_SQL)
def j7_key_check_spread(spark, sf_dir):
    """The same checks with busy keys dealt over many tasks, nothing but their list broadcast."""
    from ..functions import keys as K
    from ..operators.lookup import spread_lookup
    fx = Fixture(spark, sf_dir)
    raw = fx.raw_requests.withColumn("_hash", K.key_hash(F.col("api_key")))
    row = F.xxhash64("received_at", "client_ip", "event", "url", "userId")
    return _key_outcome(spread_lookup(raw, "_hash", _key_details(fx), "key_hash", row))


# --- L1 - L6: rate-limit replay ----------------------------------------------------

# Step-by-step replay of an anchored counter in SQL: each key's requests in
# arrival order, the counter restarting after its lifetime (independent of the
# island/fold plan used by the Spark operator).
def _anchored_replay_cte(src: str, key: str, ttl: int) -> str:
    return f"""ordered AS (
  SELECT {key} AS k, received_at, row_number() OVER (PARTITION BY {key} ORDER BY received_at) AS rn
  FROM {src}),
walk AS (
  SELECT k, rn, received_at, received_at AS window_start, CAST(1 AS BIGINT) AS window_count
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.k, o.rn, o.received_at,
         CASE WHEN o.received_at > w.window_start + INTERVAL {ttl} SECOND THEN o.received_at ELSE w.window_start END,
         CASE WHEN o.received_at > w.window_start + INTERVAL {ttl} SECOND THEN 1 ELSE w.window_count + 1 END
  FROM walk w JOIN ordered o ON o.k = w.k AND o.rn = w.rn + 1)"""


@register("l1_key_counter", oracle_with(f"""
SELECT k AS api_key, received_at, window_start, window_count, window_count > 3 AS limit_exceeded,
       CAST(greatest(0, 3 - window_count) AS BIGINT) AS remaining,
       received_at + INTERVAL {ADM_KEY_TTL} SECOND AS reset_at
FROM walk""", "raw_requests", recursive=True,
    more=_anchored_replay_cte("(SELECT * FROM raw_requests WHERE api_key IS NOT NULL) r", "api_key", ADM_KEY_TTL)))
def l1_key_counter(spark, sf_dir):
    """Anchored per-key counter replayed over all requests carrying a key
    (limit 3, one-day lifetime: scaled to the fixture), with remaining/reset columns."""
    raw = Fixture(spark, sf_dir).raw_requests.filter(F.col("api_key").isNotNull())
    raw = raw.select("api_key", "received_at", F.xxhash64("received_at", "api_key", "client_ip", "event", "url", "userId").alias("_rid"))
    out = L.anchored_counter(raw, ["api_key"], "received_at", ADM_KEY_TTL, 3, tiebreak=["_rid"])
    out = L.limit_headers(out, "received_at", 3, ADM_KEY_TTL)
    return out.select("api_key", "received_at", "window_start", "window_count", "limit_exceeded",
                      "remaining", "reset_at")


@register("l1_key_counter_parallel", oracle_with(f"""
SELECT k AS api_key, received_at, window_start, window_count, window_count > 3 AS limit_exceeded FROM walk""",
    "raw_requests", recursive=True,
    more=_anchored_replay_cte("(SELECT * FROM raw_requests WHERE api_key IS NOT NULL) r", "api_key", ADM_KEY_TTL)))
def l1_key_counter_parallel(spark, sf_dir):
    """L1 through the hot-key path (every key treated as hot): next-window pointers per
    (key, day) and pointer doubling, no step grouped by the key alone."""
    raw = Fixture(spark, sf_dir).raw_requests.filter(F.col("api_key").isNotNull())
    raw = raw.select("api_key", "received_at", F.xxhash64("received_at", "api_key", "client_ip", "event", "url", "userId").alias("_rid"))
    out = L.anchored_counter(raw, ["api_key"], "received_at", ADM_KEY_TTL, 3, tiebreak=["_rid"], hot_rows=0)
    return out.select("api_key", "received_at", "window_start", "window_count", "limit_exceeded")


@register("l2_collect_counter", oracle_with("""
SELECT r.api_key, r.client_ip, w.received_at, w.window_start, w.window_count, w.window_count > 2 AS limit_exceeded
FROM walk w JOIN raw_requests r ON coalesce(nullif(r.api_key, ''), r.client_ip) = w.k AND r.received_at = w.received_at""",
    "raw_requests", recursive=True, more=_anchored_replay_cte("raw_requests", "coalesce(nullif(api_key, ''), client_ip)", 86400)))
def l2_collect_counter(spark, sf_dir):
    """L2: per key header (else, also for an empty one, IP) counter, 2 per day (scaled to the fixture)."""
    raw = Fixture(spark, sf_dir).raw_requests
    raw = raw.select("api_key", "client_ip", "received_at", F.xxhash64("received_at", "api_key", "client_ip", "event", "url", "userId").alias("_rid"))
    out = L.collect_limit(raw, limit=2, ttl_seconds=86400, tiebreak=["_rid"])
    return out.select("api_key", "client_ip", "received_at", "window_start", "window_count", "limit_exceeded")


@register("l4_auth_counter_aligned", oracle_with("""
SELECT client_ip, received_at, window_start, window_count, window_count > 10 AS limit_exceeded FROM (
  SELECT client_ip, received_at,
         to_timestamp(floor(epoch_us(received_at) / 900000000) * 900) :: TIMESTAMP AS window_start,
         row_number() OVER (PARTITION BY client_ip, floor(epoch_us(received_at) / 900000000)
                            ORDER BY received_at) AS window_count
  FROM raw_requests) t""", "raw_requests"))
def l4_auth_counter_aligned(spark, sf_dir):
    """L4 option: clock-aligned 15-minute windows per client IP, limit 10."""
    raw = Fixture(spark, sf_dir).raw_requests
    raw = raw.select("client_ip", "received_at", F.xxhash64("received_at", "api_key", "client_ip", "event", "url", "userId").alias("_rid"))
    out = L.aligned_counter(raw, ["client_ip"], "received_at", L.AUTH_TTL, L.AUTH_LIMIT, tiebreak=["_rid"])
    return out.select("client_ip", "received_at", "window_start", "window_count", "limit_exceeded")


@register("l4_auth_counter", oracle_with("""
SELECT k AS client_ip, received_at, window_start, window_count, window_count > 10 AS limit_exceeded FROM walk""",
    "raw_requests", recursive=True, more=_anchored_replay_cte("raw_requests", "client_ip", 43200)))
def l4_auth_counter(spark, sf_dir):
    """L4: anchored counter per client IP, limit 10 (lifetime of half a day: scaled to the fixture)."""
    raw = Fixture(spark, sf_dir).raw_requests
    raw = raw.select("client_ip", "received_at", F.xxhash64("received_at", "api_key", "client_ip", "event", "url", "userId").alias("_rid"))
    out = L.auth_limit(raw, ttl_seconds=43200, tiebreak=["_rid"])
    return out.select("client_ip", "received_at", "window_start", "window_count", "limit_exceeded")


@register("l5_sliding_log", oracle_with("""
SELECT k AS userId, received_at, admitted FROM walk""", "raw_requests", recursive=True, more="""
ordered AS (
  SELECT userId AS k, received_at, row_number() OVER (PARTITION BY userId ORDER BY received_at) AS rn
  FROM raw_requests),
walk AS (
  SELECT k, rn, received_at, true AS admitted, [received_at] AS log FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.k, o.rn, o.received_at,
         len(list_filter(w.log, lambda x: o.received_at - x < INTERVAL 86400 SECOND)) < 3,
         CASE WHEN len(list_filter(w.log, lambda x: o.received_at - x < INTERVAL 86400 SECOND)) < 3
              THEN list_append(list_filter(w.log, lambda x: o.received_at - x < INTERVAL 86400 SECOND), o.received_at)
              ELSE list_filter(w.log, lambda x: o.received_at - x < INTERVAL 86400 SECOND) END
  FROM walk w JOIN ordered o ON o.k = w.k AND o.rn = w.rn + 1)"""))
def l5_sliding_log(spark, sf_dir):
    """Per-user sliding log admitting 3 per day (scaled to the fixture); rejected requests not logged."""
    raw = Fixture(spark, sf_dir).raw_requests
    raw = raw.withColumn("_rid", F.xxhash64("received_at", "api_key", "client_ip", "event", "url", "userId"))
    out = L.sliding_log_limit(raw, ["userId"], "received_at", 86400, 3, tiebreak=["_rid"])
    return out.select("userId", "received_at", "admitted")


@register("l5_report_limit", oracle_with("""
SELECT userId, client_ip, r.received_at, admitted FROM walk w
JOIN calls r ON r.k = w.k AND r.received_at = w.received_at""", "raw_requests", recursive=True, more="""
calls AS (
  SELECT received_at, userId, client_ip,
         CASE WHEN CAST(userId AS BIGINT) % 5 = 0 THEN 'ip:' || client_ip ELSE 'user:' || userId END AS k
  FROM raw_requests),
ordered AS (SELECT k, received_at, row_number() OVER (PARTITION BY k ORDER BY received_at) AS rn FROM calls),
walk AS (
  SELECT k, rn, received_at, true AS admitted, [received_at] AS log FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.k, o.rn, o.received_at,
         len(list_filter(w.log, lambda x: o.received_at - x < INTERVAL 86400 SECOND)) < 3,
         CASE WHEN len(list_filter(w.log, lambda x: o.received_at - x < INTERVAL 86400 SECOND)) < 3
              THEN list_append(list_filter(w.log, lambda x: o.received_at - x < INTERVAL 86400 SECOND), o.received_at)
              ELSE list_filter(w.log, lambda x: o.received_at - x < INTERVAL 86400 SECOND) END
  FROM walk w JOIN ordered o ON o.k = w.k AND o.rn = w.rn + 1)"""))
def l5_report_limit(spark, sf_dir):
    """L5 preset of the reports: per signed-in user, else (every fifth user here) per client IP;
    3 per day (scaled to the fixture)."""
    raw = Fixture(spark, sf_dir).raw_requests
    raw = raw.withColumn("_rid", F.xxhash64("received_at", "api_key", "client_ip", "event", "url", "userId"))
    raw = raw.withColumn("user_id", F.when(F.col("userId").cast("long") % 5 != 0, F.col("userId")))
    out = L.report_limit(raw, limit=3, window_seconds=86400, tiebreak=["_rid"])
    return out.select("userId", "client_ip", "received_at", "admitted")


# --- M1 - M15, Q27: table upkeep ---------------------------------------------------


_SCRATCH: dict = {}


def _stored_tables(spark, sf_dir):
    """Write the fixture events as the partitioned event table in two batches, refreshing
    the rollup incrementally after each (once per session and folder, in the shared
    checkpoint folder)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _SCRATCH:
        return _SCRATCH[key]
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-tables/{uuid.uuid4().hex}"
    ev_path, roll_path = f"{base}/events", f"{base}/daily_summary"
    ev = Fixture(spark, sf_dir).analytics_events.withColumn("event_date", F.to_date("timestamp"))
    cut = F.col("timestamp") < F.lit("2024-01-20").cast("timestamp_ntz")
    first, second = ev.filter(cut), ev.filter(~cut)
    TB.append_events(first, ev_path)
    TB.write_rollup(M.refresh_rollup(spark.read.parquet(ev_path)), roll_path)
    TB.append_events(second, ev_path)
    TB.write_rollup(M.refresh_rollup(spark.read.parquet(ev_path), M.touched_dates(second)), roll_path)
    _SCRATCH[key] = (ev_path, roll_path)
    return _SCRATCH[key]


@register("m13_rollup_incremental", oracle_with("SELECT * FROM daily", EV, more=_ROLLUP_SQL))
def m13_rollup_incremental(spark, sf_dir):
    """Rollup built from a first batch, then refreshed only for the dates a second
    batch touched (dynamic partition overwrite); must equal the full recompute."""
    _, roll_path = _stored_tables(spark, sf_dir)
    return spark.read.parquet(roll_path).select(*R.ROLLUP_COLUMNS)


_SHIFTED = "CASE WHEN app_id % 2 = 0 THEN \"timestamp\" - INTERVAL 60 DAY ELSE \"timestamp\" END"


@register("m15_upkeep_rollup", oracle_with("SELECT * FROM daily WHERE date >= DATE '2024-01-01'", EV, more=f"""
shifted AS (SELECT * EXCLUDE ("timestamp"), {_SHIFTED} AS "timestamp" FROM analytics_events),
""" + _ROLLUP_SQL.replace("analytics_events", "shifted").strip()))
def m15_upkeep_rollup(spark, sf_dir):
    """The upkeep job really drops the expired months of a stored event table (the even
    apps' events moved 60 days back); their days leave the rollup with them."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-upkeep/{uuid.uuid4().hex}"
    ev = Fixture(spark, sf_dir).analytics_events
    back = F.when(F.col("app_id") % 2 == 0, F.col("timestamp") - F.expr("INTERVAL 60 DAYS")).otherwise(F.col("timestamp"))
    ev = ev.withColumn("timestamp", back).withColumn("event_date", F.to_date("timestamp"))
    TB.append_events(ev, f"{base}/events")
    TB.write_rollup(M.refresh_rollup(spark.read.parquet(f"{base}/events")), f"{base}/daily_summary")
    report = M.upkeep(spark, f"{base}/events", f"{base}/daily_summary", "2024-03-15 00:00:00", months_to_keep=2, drop=True)
    if report["failed"]:
        raise RuntimeError(report["failed"])
    return spark.read.parquet(f"{base}/daily_summary").select(*R.ROLLUP_COLUMNS)


_FIRST_SEEN: dict = {}


def _first_seen(spark, sf_dir):
    """The fixture events added to the first-seen rollup in three batches that share their days
    (by id, so every later batch is full of late events), the second of them run twice."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FIRST_SEEN:
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-first-seen/{uuid.uuid4().hex}"
        ev = Fixture(spark, sf_dir).analytics_events
        for batch in (0, 1, 2, 1):
            M.add_to_rollup(ev.filter(F.col("id") % 3 == batch), base, batch)
        _FIRST_SEEN[key] = base
    return _FIRST_SEEN[key]


@register("m13_rollup_first_seen", oracle_with("SELECT * FROM daily", EV, more=_ROLLUP_SQL))
def m13_rollup_first_seen(spark, sf_dir):
    """The rollup from batches alone (first-seen table and deltas), with late events and a replay."""
    return M.rollup_of_deltas(spark, _first_seen(spark, sf_dir))


@register("a2_distinct_users_over_days", oracle_with("""
SELECT app_id, event_name, count(DISTINCT user_id) AS unique_users FROM analytics_events
WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-25' AND user_id IS NOT NULL GROUP BY 1, 2""", EV))
def a2_distinct_users_over_days(spark, sf_dir):
    """A2 over 24 days, exact, from the first-seen table."""
    seen = spark.read.parquet(f"{_first_seen(spark, sf_dir)}/first_seen")
    return M.distinct_over_days(seen, "user", "2024-01-02", "2024-01-25")


@register("m4_cascade_stored_events", oracle_with("""
SELECT CAST("timestamp" AS DATE) AS event_date, app_id, count(*) AS events FROM analytics_events
WHERE NOT (app_id IN (SELECT id FROM apps WHERE user_id = 3) OR app_id % 4 = 1) GROUP BY 1, 2""", EV, "apps"))
def m4_cascade_stored_events(spark, sf_dir):
    """M4 on a stored event table of its own: owner 3's apps and every fourth app go; only partitions that
    hold them are rewritten."""
    fx, path = Fixture(spark, sf_dir), f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-cascade/{uuid.uuid4().hex}"
    TB.append_events(fx.analytics_events.withColumn("event_date", F.to_date("timestamp")), path)
    M.cascade_stored_events(spark, path, fx.apps.filter("user_id = 3 OR id % 4 = 1").select("id"))
    return spark.read.parquet(path).groupBy("event_date", "app_id").agg(F.count(F.lit(1)).alias("events"))


@register("s6_batch_apps", oracle_with("SELECT app_id, count(*) AS events FROM analytics_events GROUP BY 1", EV))
def s6_batch_apps(spark, sf_dir):
    """The distinct apps that a batch touches, with their number of events."""
    return M.touched_apps(Fixture(spark, sf_dir).analytics_events)


@register("s2_dimension_scan", oracle_with("""
SELECT id, app_id, key_hash, is_active, can_write, rate_limit_per_hour, expires_at FROM api_keys""", "api_keys"))
def s2_dimension_scan(spark, sf_dir):
    """The key table written as a snapshot and read back with its fixed schema."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-keys/{uuid.uuid4().hex}"
    TB.write_snapshot(Fixture(spark, sf_dir).api_keys.select(*TB.API_KEYS.fieldNames()), path)
    return TB.read_dim(spark, path, "api_keys").select(
        "id", "app_id", "key_hash", "is_active", F.col("permissions.write").alias("can_write"), "rate_limit_per_hour", "expires_at")


@register("s3_log_scan", oracle_with("""
SELECT CAST(created_at AS DATE) AS log_date, event_type, severity, count(*) AS events FROM security_events
WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-20' GROUP BY 1, 2, 3""", "security_events"))
def s3_log_scan(spark, sf_dir):
    """S3: the security log written by day, ten days of it read by their partitions."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-log/{uuid.uuid4().hex}"
    log = Fixture(spark, sf_dir).security_events.withColumn("user_id", F.col("user_id").cast("string")).withColumn("id", F.col("id").cast("string"))
    TB.write_log(log, path)
    log = TB.read_log(spark, path, "security_events").filter(F.col("log_date").between("2024-01-10", "2024-01-19"))
    return log.groupBy("log_date", "event_type", "severity").agg(F.count(F.lit(1)).alias("events"))


@register("m12_events_by_provisioned_month", oracle_with("""
SELECT m.month, count(e.month) AS events FROM (
  SELECT DISTINCT strftime(TIMESTAMP '2024-01-31' + INTERVAL (i) MONTH, '%Y-%m') AS month FROM range(0, 12) r(i)
  UNION SELECT unnest(['2024-02', '2024-03', '2024-11', '2024-12', '2025-01', '2025-02'])) m
LEFT JOIN (SELECT strftime("timestamp", '%Y-%m') AS month FROM analytics_events) e ON e.month = m.month GROUP BY 1""", EV))
def m12_events_by_provisioned_month(spark, sf_dir):
    """Every provisioned month with its events."""
    per_month = Fixture(spark, sf_dir).analytics_events.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("events"))
    return M.provisioned_months_frame(spark, AS_OF).join(per_month, "month", "left").fillna({"events": 0})


@register("q27_partition_rows", oracle_with("""
SELECT CAST("timestamp" AS DATE) AS event_date, count(*) AS rows FROM analytics_events GROUP BY 1""", EV))
def q27_partition_rows(spark, sf_dir):
    """Q27 on the stored event table: rows per event_date partition (sizes and file counts
    depend on the writer, so only rows are compared)."""
    ev_path, _ = _stored_tables(spark, sf_dir)
    return M.partition_stats(spark, ev_path).select("event_date", "rows")


@register("s1_pruned_scan", oracle_with(f"""
SELECT event_name, count(*) AS count FROM analytics_events
WHERE "timestamp" >= TIMESTAMP '{F_START}' AND "timestamp" <= TIMESTAMP '{F_END}' GROUP BY event_name""", EV))
def s1_pruned_scan(spark, sf_dir):
    """Read the stored event table with a time range (partition filters on event_date)."""
    ev_path, _ = _stored_tables(spark, sf_dir)
    ev = TB.read_events(spark, ev_path, F_START, F_END)
    return ev.groupBy("event_name").agg(F.count(F.lit(1)).alias("count"))


_M1_CHANGES = """
changes AS (
  SELECT concat('g-', CAST(s_nationkey AS VARCHAR)) AS google_id, lower(s_name) || '@apps.example.com' AS email,
         s_name AS name, CAST(NULL AS VARCHAR) AS profile_picture, s_suppkey AS seq, CAST(NULL AS BIGINT) AS id
  FROM supplier
  UNION ALL
  SELECT concat('g-s', CAST(s_suppkey AS VARCHAR)), concat('s', CAST(s_suppkey AS VARCHAR), '@apps.example.com'),
         s_name, 'https://img.example.com/' || CAST(s_suppkey AS VARCHAR), s_suppkey, 1000000 + s_suppkey
  FROM supplier),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY google_id ORDER BY seq DESC) AS rn
                          FROM changes) t WHERE rn = 1)"""


def _m1_changes(spark, sf_dir):
    sup = Fixture(spark, sf_dir).raw("supplier")
    upd = sup.select(F.concat(F.lit("g-"), F.col("s_nationkey").cast("string")).alias("google_id"),
                     F.concat(F.lower("s_name"), F.lit("@apps.example.com")).alias("email"),
                     F.col("s_name").alias("name"), F.lit(None).cast("string").alias("profile_picture"),
                     F.col("s_suppkey").alias("seq"), F.lit(None).cast("long").alias("id"))
    new = sup.select(F.concat(F.lit("g-s"), F.col("s_suppkey").cast("string")).alias("google_id"),
                     F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@apps.example.com")).alias("email"),
                     F.col("s_name").alias("name"),
                     F.concat(F.lit("https://img.example.com/"), F.col("s_suppkey").cast("string")).alias("profile_picture"),
                     F.col("s_suppkey").alias("seq"), (F.lit(1000000) + F.col("s_suppkey")).alias("id"))
    return upd.unionByName(new)


@register("m1_upsert_users", oracle_with(f"""
SELECT coalesce(u.id, l.id) AS id, coalesce(u.google_id, l.google_id) AS google_id,
       CASE WHEN u.id IS NULL OR l.google_id IS NOT NULL THEN l.email ELSE u.email END AS email,
       CASE WHEN u.id IS NULL OR l.google_id IS NOT NULL THEN l.name ELSE u.name END AS name,
       CASE WHEN u.id IS NULL OR l.google_id IS NOT NULL THEN l.profile_picture END AS profile_picture,
       CASE WHEN u.id IS NULL THEN 'user' ELSE u.role END AS role,
       CASE WHEN u.id IS NULL THEN true ELSE u.is_active END AS is_active,
       CASE WHEN l.google_id IS NOT NULL AND u.id IS NOT NULL THEN {_AS_OF_TS} END AS last_login_at,
       CASE WHEN u.id IS NULL THEN {_AS_OF_TS} ELSE u.created_at END AS created_at,
       CASE WHEN l.google_id IS NOT NULL THEN {_AS_OF_TS} END AS updated_at
FROM users u
FULL OUTER JOIN latest l ON u.google_id = l.google_id""", "users", more=_M1_CHANGES))
def m1_upsert_users(spark, sf_dir):
    """M1: upsert on google_id: owners' details updated from their latest supplier row,
    every supplier also registered as a new user."""
    fx = Fixture(spark, sf_dir)
    users = (fx.users.withColumn("id", F.col("id").cast("long"))
             .withColumn("profile_picture", F.lit(None).cast("string"))
             .withColumn("last_login_at", F.lit(None).cast("timestamp_ntz"))
             .withColumn("updated_at", F.lit(None).cast("timestamp_ntz")))
    out = M.upsert_users(users, _m1_changes(spark, sf_dir), AS_OF, order_col="seq")
    return out.select("id", "google_id", "email", "name", "profile_picture", "role", "is_active",
                      "last_login_at", "created_at", "updated_at")


@register("m6_revoke_keys", oracle_with(f"""
SELECT id, app_id, CASE WHEN r THEN false ELSE is_active END AS is_active,
       CASE WHEN r THEN {_AS_OF_TS} END AS revoked_at
FROM (SELECT k.*, k.id IN (SELECT ak.id FROM api_keys ak JOIN apps a ON ak.app_id = a.id WHERE a.user_id = 3) AS r
      FROM api_keys k) t""", "api_keys", "apps"))
def m6_revoke_keys(spark, sf_dir):
    """M6: revoke every key of the apps of owner 3."""
    fx = Fixture(spark, sf_dir)
    mine = fx.api_keys.join(fx.apps.filter(F.col("user_id") == 3).select(F.col("id").alias("_a")),
                            F.col("app_id") == F.col("_a"), "left_semi").select("id")
    return M.revoke_keys(fx.api_keys, mine, AS_OF).select("id", "app_id", "is_active", "revoked_at")


@register("m8_touch_keys", oracle_with("""
SELECT k.id, max(w.window_start) AS last_used_at, CAST(count(DISTINCT w.window_start) AS BIGINT) AS touch_writes
FROM api_keys k LEFT JOIN walk w ON w.k = k.id GROUP BY k.id""", "raw_requests", "api_keys", recursive=True,
    more=_anchored_replay_cte("(SELECT k.id, r.received_at FROM raw_requests r JOIN api_keys k "
                              "ON k.key_hash = sha256(r.api_key)) u", "id", 300)))
def m8_touch_keys(spark, sf_dir):
    """M8: replay last_used_at touches (5-minute guard) of every key over all requests that presented it."""
    fx = Fixture(spark, sf_dir)
    keys = fx.api_keys
    uses = (fx.raw_requests.filter(F.col("api_key").isNotNull())
            .join(keys.select(F.col("id").alias("key_id"), "key_hash"),
                  F.sha2(F.col("api_key"), 256) == F.col("key_hash"))
            .select("key_id", F.col("received_at").alias("used_at")))
    return M.touch_keys(keys, uses).select("id", "last_used_at", "touch_writes")


# --- T1 - T4: streaming ---------------------------------------------------------


def _in_thirds(spark, sf_dir, folder, run):
    """Append the fixture requests to ``folder`` as JSON lines, one third of the arrival span
    after the other, and drain the stream over it after each."""
    raw = Fixture(spark, sf_dir).raw_requests
    part = F.when(F.col("received_at") < F.lit("2024-01-11").cast("timestamp_ntz"), 0) \
            .when(F.col("received_at") < F.lit("2024-01-21").cast("timestamp_ntz"), 1).otherwise(2)
    staged = raw.withColumn("_part", part)
    for p in (0, 1, 2):
        TB.write_raw(staged.filter(F.col("_part") == p).drop("_part"), folder, mode="append")
        run().awaitTermination()


_STREAMED: dict = {}


def _stream_admission(spark, sf_dir):
    """The streaming collection over three appended thirds (once per session and folder)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STREAMED:
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-stream/{uuid.uuid4().hex}"
        fx = Fixture(spark, sf_dir)
        _in_thirds(spark, sf_dir, f"{base}/raw", lambda: SC.start_collect_stream(
            spark, f"{base}/raw", fx.api_keys, fx.apps, f"{base}/out", f"{base}/ckpt", as_of=AS_OF,
            key_hour_ttl=ADM_KEY_TTL, **ADM_COLLECT))
        _STREAMED[key] = f"{base}/out"
    return _STREAMED[key]


@register("t1_stream_admission_counts", admission_oracle("""
SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS requests FROM outcome GROUP BY 1""",
    AS_OF, ADM_KEY_TTL))
def t1_stream_admission_counts(spark, sf_dir):
    """Streaming admission (three micro-batches, counters carried across them):
    outcome counts; equals the batch admission (see tests)."""
    out = _stream_admission(spark, sf_dir)
    acc = spark.read.parquet(f"{out}/events").groupBy().count().select(
        F.lit("accepted").alias("outcome"), F.col("count").alias("requests"))
    rej = spark.read.parquet(f"{out}/quarantine").groupBy(F.col("reject_reason").alias("outcome")) \
        .agg(F.count(F.lit(1)).alias("requests"))
    return acc.unionByName(rej)


@register("t2_stream_rollup", admission_oracle("""
SELECT app_id, CAST(ts AS DATE) AS date, event_name, count(*) AS event_count,
       count(DISTINCT session_id) AS unique_sessions, count(DISTINCT user_id) AS unique_users,
       count(DISTINCT device_out) AS unique_devices, count(DISTINCT country) AS unique_countries
FROM outcome WHERE reject_reason IS NULL GROUP BY 1, 2, 3""", AS_OF, ADM_KEY_TTL))
def t2_stream_rollup(spark, sf_dir):
    """Rollup maintained batch by batch by the streaming collection."""
    out = _stream_admission(spark, sf_dir)
    return spark.read.parquet(f"{out}/daily_summary").select(*R.ROLLUP_COLUMNS)


@register("t2_stream_rollup_first_seen", REGISTRY["t2_stream_rollup"].oracle)
def t2_stream_rollup_first_seen(spark, sf_dir):
    """The rollup that the stream keeps from its batches alone (first-seen table and deltas): no
    batch reads stored events again."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-stream/{uuid.uuid4().hex}"
    fx = Fixture(spark, sf_dir)
    _in_thirds(spark, sf_dir, f"{base}/raw", lambda: SC.start_collect_stream(
        spark, f"{base}/raw", fx.api_keys, fx.apps, f"{base}/out", f"{base}/ckpt", as_of=AS_OF,
        key_hour_ttl=ADM_KEY_TTL, first_seen=True, **ADM_COLLECT))
    return M.rollup_of_deltas(spark, f"{base}/out")


@register("t3_live_event_counts", oracle_with("""
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_name, count(*) AS count FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, "timestamp") AS window_start, event_name FROM analytics_events) t
GROUP BY 1, 3
HAVING window_start + INTERVAL 1 HOUR <= (SELECT max("timestamp") FROM analytics_events) - INTERVAL 1 HOUR""", EV))
def t3_live_event_counts(spark, sf_dir):
    """Watermarked hourly counts per event name over the stored event table as a stream;
    only windows closed by the final watermark are emitted (approximate users are computed
    by the operator but not compared: a sketch has no exact oracle)."""
    ev_path, _ = _stored_tables(spark, sf_dir)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-live/{uuid.uuid4().hex}"
    src = spark.readStream.schema(spark.read.parquet(ev_path).schema).parquet(ev_path)
    q = (SL.live_event_counts(src).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start(f"{base}/out"))
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_name", "count")


@register("t4_stream_key_counter", oracle_with(f"""
SELECT k AS api_key, received_at, window_start, window_count, window_count > 3 AS limit_exceeded FROM walk""",
    "raw_requests", recursive=True,
    more=_anchored_replay_cte("(SELECT * FROM raw_requests WHERE api_key IS NOT NULL) r", "api_key", ADM_KEY_TTL)))
def t4_stream_key_counter(spark, sf_dir):
    """T4: stateful streaming per-key counter (limit 3, one-day lifetime) over the raw request files."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evlens-stream/{uuid.uuid4().hex}"

    def run():
        src = TB.read_raw(spark, f"{out}/raw", streaming=True)
        return (SL.streaming_key_counter(src, ttl_seconds=ADM_KEY_TTL, limit=3, watermark="2 days")
                .writeStream.format("parquet").outputMode("append")
                .option("checkpointLocation", f"{out}/ckpt").trigger(availableNow=True).start(f"{out}/data"))

    _in_thirds(spark, sf_dir, f"{out}/raw", run)
    res = spark.read.parquet(f"{out}/data")
    return res.select(F.col("key").alias("api_key"), F.col("received_at").cast("timestamp_ntz").alias("received_at"),
                      F.col("window_start").cast("timestamp_ntz").alias("window_start"), "window_count",
                      "limit_exceeded")


# --- more upkeep and lookups ----------------------------------------------------

@register("m2_insert_apps", oracle_with(f"""
SELECT id, user_id, app_name, created_at FROM apps
UNION ALL
SELECT 100000 + n_nationkey, n_nationkey, 'console ' || n_name, {_AS_OF_TS} FROM nation""", "apps"))
def m2_insert_apps(spark, sf_dir):
    """M2: every user registers one more app (ids above the existing ones)."""
    fx = Fixture(spark, sf_dir)
    nat = fx.raw("nation")
    new = nat.select((F.lit(100000) + F.col("n_nationkey")).cast("long").alias("id"),
                     F.col("n_nationkey").alias("user_id"), F.concat(F.lit("console "), F.col("n_name")).alias("app_name"))
    return M.insert_apps(fx.apps, new, AS_OF).select("id", "user_id", "app_name", "created_at")


@register("m3_update_apps", oracle_with(f"""
SELECT a.id, coalesce(c.app_name, a.app_name) AS app_name, coalesce(c.description, a.description) AS description,
       CASE WHEN c.id IS NOT NULL THEN {_AS_OF_TS} END AS updated_at
FROM apps a LEFT JOIN (
  SELECT s_suppkey AS id, upper(s_name) AS app_name,
         CASE WHEN s_acctbal > 0 THEN 'balance ' || CAST(CAST(trunc(s_acctbal) AS BIGINT) AS VARCHAR) END AS description
  FROM supplier) c ON c.id = a.id""", "apps"))
def m3_update_apps(spark, sf_dir):
    """M3: COALESCE update of every app from its supplier row (NULL descriptions keep the old value)."""
    fx = Fixture(spark, sf_dir)
    sup = fx.raw("supplier")
    changes = sup.select(F.col("s_suppkey").alias("id"), F.upper("s_name").alias("app_name"),
                         F.when(F.col("s_acctbal") > 0, F.concat(F.lit("balance "),
                                F.col("s_acctbal").cast("long").cast("string"))).alias("description"))
    apps = fx.apps.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return M.update_apps(apps, changes, AS_OF).select("id", "app_name", "description", "updated_at")


@register("m4_cascade_event_counts", oracle_with("""
SELECT e.app_id, count(*) AS events FROM analytics_events e
WHERE e.app_id NOT IN (SELECT id FROM apps WHERE user_id = 3)
GROUP BY e.app_id""", EV, "apps"))
def m4_cascade_event_counts(spark, sf_dir):
    """M4: delete owner 3 with cascade; events left per app."""
    fx = Fixture(spark, sf_dir)
    users = fx.users.filter(F.col("id") == 3).select("id")
    _, _, _, events, _ = M.delete_users_cascade(fx.users, fx.apps, fx.api_keys, fx.analytics_events, [], users)
    return events.groupBy("app_id").agg(F.count(F.lit(1)).alias("events"))


@register("m4_cascade_keys", oracle_with("""
SELECT id, app_id FROM api_keys WHERE app_id NOT IN (SELECT id FROM apps WHERE user_id = 3)""", "api_keys", "apps"))
def m4_cascade_keys(spark, sf_dir):
    """M4: keys left after deleting owner 3 with cascade."""
    fx = Fixture(spark, sf_dir)
    users = fx.users.filter(F.col("id") == 3).select("id")
    _, _, keys, _, _ = M.delete_users_cascade(fx.users, fx.apps, fx.api_keys, fx.analytics_events, [], users)
    return keys.select("id", "app_id")


@register("m5_insert_keys", oracle_with(f"""
SELECT id, app_id, key_hash, key_prefix, expires_at FROM api_keys
UNION ALL
SELECT 1000000 + p_partkey, p_partkey % (SELECT count(*) FROM supplier), sha256('new-' || CAST(p_partkey AS VARCHAR)),
       substring('new-' || CAST(p_partkey AS VARCHAR), 1, 8), {_AS_OF_TS} + INTERVAL 365 DAY FROM part""",
    "api_keys"))
def m5_insert_keys(spark, sf_dir):
    """M5: one new key per part row: hash and prefix stored, expiry one year after as_of."""
    fx = Fixture(spark, sf_dir)
    part = fx.raw("part")
    new = part.select((F.lit(1000000) + F.col("p_partkey")).alias("id"), (F.col("p_partkey") % fx.raw("supplier").count()).alias("app_id"),
                      F.concat(F.lit("new-"), F.col("p_partkey").cast("string")).alias("api_key"),
                      F.col("p_name").alias("name"))
    keys = fx.api_keys.select(*[c for c in TB.API_KEYS.fieldNames()])
    return M.insert_keys(keys, new, AS_OF).select("id", "app_id", "key_hash", "key_prefix", "expires_at")


@register("m7_delete_keys", oracle_with("""
SELECT id, app_id FROM api_keys WHERE is_active""", "api_keys"))
def m7_delete_keys(spark, sf_dir):
    """M7: delete every inactive key."""
    keys = Fixture(spark, sf_dir).api_keys
    return M.delete_keys(keys, keys.filter(~F.col("is_active")).select("id")).select("id", "app_id")


@register("m9_touch_logins", oracle_with("""
SELECT u.id, s.last AS last_login_at FROM users u
LEFT JOIN (SELECT user_id, max(created_at) AS last FROM security_events GROUP BY user_id) s ON s.user_id = u.id""",
    "users", "security_events"))
def m9_touch_logins(spark, sf_dir):
    """M9: last_login_at from the latest security-log activity of each user."""
    fx = Fixture(spark, sf_dir)
    users = fx.users.withColumn("last_login_at", F.lit(None).cast("timestamp_ntz"))
    reqs = fx.security_events.select("user_id", F.col("created_at").alias("received_at"))
    return M.touch_logins(users, reqs).select("id", "last_login_at")


@register("m10_audit_entries", oracle_with("""
SELECT CAST(NULL AS VARCHAR) AS user_id, split_part(endpoint, ' ', 1) AS action,
       split_part(endpoint, ' ', 2) AS resource, CAST(NULL AS VARCHAR) AS ip_address,
       CAST(NULL AS VARCHAR) AS user_agent, received_at AS created_at
FROM request_log WHERE contains(split_part(endpoint, ' ', 2), '/error')""", "request_log"))
def m10_audit_entries(spark, sf_dir):
    """Audit rows for requests whose path contains a watched route ('/error' here)."""
    log = Fixture(spark, sf_dir).request_log
    parts = F.split("endpoint", " ")
    reqs = log.select("received_at", parts[0].alias("method"), parts[1].alias("path"),
                      F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("client_ip"),
                      F.lit(None).cast("string").alias("user_agent"))
    return M.audit_entries(reqs, paths=("/error",))


@register("m11_expired_dates", oracle_with("""
SELECT DISTINCT CAST("timestamp" AS DATE) AS event_date FROM analytics_events
WHERE CAST("timestamp" AS DATE) < DATE '2024-02-01'""", EV))
def m11_expired_dates(spark, sf_dir):
    """M11 dry run on the stored event table: partitions older than one month before 2024-03-15."""
    ev_path, _ = _stored_tables(spark, sf_dir)
    return M.expired_dates(spark.read.parquet(ev_path), "2024-03-15 00:00:00", months_to_keep=1)


@register("q28_table_rows", oracle_with(f"""
SELECT 'events' AS table_name, count(*) AS rows FROM analytics_events
UNION ALL SELECT 'daily_summary', count(*) FROM daily""", EV, more=_ROLLUP_SQL))
def q28_table_rows(spark, sf_dir):
    """Q28 over the stored tables (rows per table; byte sizes depend on the writer)."""
    ev_path, roll_path = _stored_tables(spark, sf_dir)
    return M.table_stats(spark, {"events": ev_path, "daily_summary": roll_path}).select("table_name", "rows")


@register("q17_bulk_lookup_apps", oracle_with("""
SELECT * FROM apps WHERE id IN (SELECT app_id FROM api_keys)""", "apps", "api_keys"))
def q17_bulk_lookup_apps(spark, sf_dir):
    """Q17: apps looked up by id for every key's app (semi join)."""
    fx = Fixture(spark, sf_dir)
    return T.bulk_lookup(fx.apps, "id", fx.api_keys.select("app_id"))


@register("l3_analytics_counter", oracle_with("""
SELECT r.userId, r.client_ip, w.received_at, w.window_start, w.window_count, w.window_count > 2 AS limit_exceeded
FROM walk w JOIN raw_requests r
  ON w.k = CASE WHEN r.userId IS NOT NULL THEN 'user:' || r.userId ELSE 'ip:' || r.client_ip END
 AND w.received_at = r.received_at""", "raw_requests", recursive=True, more=_anchored_replay_cte(
    "raw_requests", "CASE WHEN userId IS NOT NULL THEN 'user:' || userId ELSE 'ip:' || client_ip END", 3600)))
def l3_analytics_counter(spark, sf_dir):
    """L3: report-read counter per signed-in user, else per IP; 2 per hour (scaled to the fixture)."""
    raw = Fixture(spark, sf_dir).raw_requests.withColumn("user_id", F.col("userId"))
    raw = raw.withColumn("_rid", F.xxhash64("received_at", "api_key", "client_ip", "event", "url", "userId"))
    out = L.analytics_limit(raw, limit=2, ttl_seconds=3600, tiebreak=["_rid"])
    return out.select("userId", "client_ip", "received_at", "window_start", "window_count", "limit_exceeded")


@register("f13_url_prefix_metadata", oracle_with("""
SELECT event_name, count(*) AS count FROM analytics_events
WHERE starts_with(url, 'https://site3.') AND json_extract_string(metadata, '$.k') = '42'
GROUP BY event_name""", EV))
def f13_url_prefix_metadata(spark, sf_dir):
    """events of one site (URL prefix) carrying metadata k = 42, counted per event name."""
    from ..operators.filters import filter_metadata, filter_url_prefix
    ev = filter_metadata(filter_url_prefix(Fixture(spark, sf_dir).analytics_events, "https://site3."), "k", 42)
    return ev.groupBy("event_name").agg(F.count(F.lit(1)).alias("count"))
