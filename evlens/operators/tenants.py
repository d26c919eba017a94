"""Tenant and dashboard reports Q9-Q19 over apps, api_keys, users and events.

Joins against the event table never fan out: events and keys are first
aggregated to one row per app (or per owner), and only those small frames are
joined to the app dimension. Where the reference's SQL counts over a fan-out
join (Q10), the same number is produced algebraically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import filter_apps, rolling_after, typed_lit

# Role names and their security levels (guest, user, admin,
# super_admin) and the levels of API-key callers and anonymous callers.
ROLE_LEVELS = {"guest": 0, "user": 2, "admin": 3, "super_admin": 4}
LEVEL_PUBLIC, LEVEL_BASIC, LEVEL_USER = 0, 1, 2


def _after(df: DataFrame, column: str, as_of, days: int):
    return F.col(column) > typed_lit(df, column, as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def _active_keys_per_app(keys: DataFrame) -> DataFrame:
    return (keys.filter(F.col("is_active") == F.lit(True))
                .groupBy("app_id").agg(F.count_distinct("id").alias("_k_active")))


def _apps_subset(apps: DataFrame, app_id=None, user_id=None) -> DataFrame:
    if app_id is not None:
        apps = apps.filter(F.col("id") == F.lit(app_id))
    if user_id is not None:
        apps = apps.filter(F.col("user_id") == F.lit(user_id))
    return apps


# Activity from the app-day rollup ---------------------------------------------

def app_days(ev: DataFrame) -> DataFrame:
    """Per app and day: events and the last event's time. Dashboards read it instead of the events."""
    day = F.col("event_date") if "event_date" in ev.columns else F.to_date("timestamp")
    return ev.groupBy("app_id", day.alias("date")).agg(
        F.count(F.lit(1)).alias("event_count"), F.max("timestamp").alias("last_event_at"))


def activity(ev: DataFrame, rollup: DataFrame, as_of, windows: tuple[int, ...], app_ids: DataFrame | None = None) -> DataFrame:
    """Per app from its days: all events (``_rows``), ``last_event_at`` and, for each rolling window,
    the events after ``as_of`` less that many days (``_n<days>``).

    A strict bound cuts one day: days after it come from the rollup, the cut day alone is
    read from the events (event ids are unique, so rows count events).
    """
    bound = {n: F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(n)} DAYS") for n in windows}
    if app_ids is not None:
        ev, rollup = filter_apps(ev, app_ids), filter_apps(rollup, app_ids)
    zero = F.lit(0).cast("long")
    whole = rollup.select("app_id", F.col("event_count").alias("_rows"), F.col("last_event_at").cast("timestamp_ntz").alias("last_event_at"), *[
        F.when(F.col("date") > F.to_date(b), F.col("event_count")).otherwise(zero).alias(f"_n{n}") for n, b in bound.items()])
    day = F.col("event_date") if "event_date" in ev.columns else F.to_date("timestamp")
    inside = {n: (day == F.to_date(b)) & (F.col("timestamp").cast("timestamp_ntz") > b) for n, b in bound.items()}
    cut = ev.filter(day.isin(*[F.to_date(b) for b in bound.values()])).select(
        "app_id", zero.alias("_rows"), F.lit(None).cast("timestamp_ntz").alias("last_event_at"),
        *[F.when(c, F.lit(1).cast("long")).otherwise(zero).alias(f"_n{n}") for n, c in inside.items()])
    return whole.unionByName(cut).groupBy("app_id").agg(
        F.sum("_rows").alias("_rows"), F.max("last_event_at").alias("last_event_at"),
        *[F.sum(f"_n{n}").alias(f"_n{n}") for n in windows])


# Q9 ------------------------------------------------------------------------

def app_with_stats(apps: DataFrame, keys: DataFrame, ev: DataFrame, as_of, app_id=None,
                   days: int = 30, rollup: DataFrame | None = None) -> DataFrame:
    """Q9: app columns + distinct active keys + distinct events after ``as_of - days``.

    Strict lower bound, no upper bound. ``app_id=None`` returns every app. Events
    are filtered, then counted per app (one distinct aggregation, pre-aggregated
    on (app, id) before the shuffle), then left-joined: no fan-out. With the
    ``rollup`` of ``app_days`` only the day that the bound cuts is read from the events.
    """
    a = _apps_subset(apps, app_id=app_id)
    if rollup is not None:
        per_app = activity(ev, rollup, as_of, (days,), None if app_id is None else a.select("id")).select(
            "app_id", F.col(f"_n{days}").alias("_e"))
    else:
        e = rolling_after(ev, "timestamp", as_of, days)
        if app_id is not None:
            e = e.filter(F.col("app_id") == F.lit(app_id))
        per_app = e.groupBy("app_id").agg(F.count_distinct("id").alias("_e"))
    k = _active_keys_per_app(keys)
    return (a.join(k, a["id"] == k["app_id"], "left").drop(k["app_id"])
             .join(per_app, a["id"] == per_app["app_id"], "left").drop(per_app["app_id"])
             .withColumn("active_api_keys", F.coalesce(F.col("_k_active"), F.lit(0)).cast("long"))
             .withColumn(f"events_last_{days}_days", F.coalesce(F.col("_e"), F.lit(0)).cast("long"))
             .drop("_k_active", "_e"))


# Q10 -----------------------------------------------------------------------

def owner_apps(apps: DataFrame, keys: DataFrame, ev: DataFrame, as_of, user_id=None,
               exact_keys: bool = False, days: int = 7, rollup: DataFrame | None = None) -> DataFrame:
    """Q10: each app of an owner with active keys, events in the last ``days`` and last event time.

    The reference counts active keys over the join apps x keys x events, so its
    ``active_api_keys`` is active keys x max(event rows of the app, 1). That
    product is computed from per-app counts instead of materialising the join;
    ``exact_keys=True`` drops the factor. Newest app first (NULL created_at first).
    ``user_id=None`` lists the apps of every owner. ``rollup``: see ``app_with_stats``.
    """
    a = _apps_subset(apps, user_id=user_id)
    own = None if user_id is None else a.select(F.col("id").alias("app_id"))  # one owner: only that owner's apps
    if rollup is not None:
        per_app = activity(ev, rollup, as_of, (days,), own).withColumnRenamed(f"_n{days}", "_recent")
    else:
        e = filter_apps(ev, own)
        recent = _after(e, "timestamp", as_of, days)
        per_app = (e.groupBy("app_id")
                    .agg(F.count(F.lit(1)).alias("_rows"),
                         F.count_distinct(F.when(recent, F.col("id"))).alias("_recent"),
                         F.max("timestamp").alias("last_event_at")))
    k = _active_keys_per_app(keys)
    k_active = F.coalesce(F.col("_k_active"), F.lit(0)).cast("long")
    factor = F.lit(1) if exact_keys else F.greatest(F.coalesce(F.col("_rows"), F.lit(0)), F.lit(1))
    out = (a.join(k, a["id"] == k["app_id"], "left").drop(k["app_id"])
            .join(per_app, a["id"] == per_app["app_id"], "left").drop(per_app["app_id"]))
    return (out.withColumn("active_api_keys", (k_active * factor).cast("long"))
               .withColumn(f"events_last_{days}_days", F.coalesce(F.col("_recent"), F.lit(0)).cast("long"))
               .select(*a.columns, "active_api_keys", f"events_last_{days}_days", "last_event_at")
               .orderBy(F.desc_nulls_first("created_at"), F.asc("id")))


# Q11 / Q11b ------------------------------------------------------------------

def dashboard_stats(users: DataFrame, apps: DataFrame, keys: DataFrame, ev: DataFrame, as_of,
                    user_id=None, rollup: DataFrame | None = None) -> DataFrame:
    """Q11: per user total apps, distinct active keys, distinct events in 7 and 30 days.

    With ``user_id`` given: always exactly one row (zeros for an unknown user).
    With ``user_id=None``: one row per user of ``users``.
    Event ids are deduplicated per owner (``max(timestamp)`` per (owner, id)), so
    the counts stay exact distinct counts without expanding rows per filter.
    ``rollup``: see ``app_with_stats``.
    """
    owners = users.select(F.col("id").alias("owner"))
    a = apps.select(F.col("id").alias("app_id"), F.col("user_id").alias("owner"))
    if user_id is not None:
        owners = owners.filter(F.col("owner") == F.lit(user_id))
        a = a.filter(F.col("owner") == F.lit(user_id))
    a = a.join(owners, "owner", "left_semi")
    n_apps = a.groupBy("owner").agg(F.count_distinct("app_id").alias("total_apps"))
    k = (keys.filter(F.col("is_active") == F.lit(True)).select("app_id", F.col("id").alias("key_id"))
             .join(a, "app_id").groupBy("owner").agg(F.count_distinct("key_id").alias("total_active_keys")))
    own = None if user_id is None else a.select("app_id")  # one owner: only that owner's apps are aggregated
    if rollup is not None:
        e = activity(ev, rollup, as_of, (7, 30), own).join(a, "app_id").groupBy("owner").agg(
            F.sum("_n7").alias("events_last_7_days"), F.sum("_n30").alias("events_last_30_days"))
    else:
        e30 = filter_apps(rolling_after(ev, "timestamp", as_of, 30), own).select("app_id", "id", "timestamp")
        per_id = e30.join(a, "app_id").groupBy("owner", "id").agg(F.max("timestamp").alias("_ts"))
        seven = _after(per_id, "_ts", as_of, 7)
        e = per_id.groupBy("owner").agg(F.count_if(seven).alias("events_last_7_days"),
                                        F.count(F.lit(1)).alias("events_last_30_days"))
    zero = F.lit(0).cast("long")
    cols = ["total_apps", "total_active_keys", "events_last_7_days", "events_last_30_days"]
    if user_id is not None:
        # Global aggregate semantics: one row whether or not the user exists.
        stats = n_apps.join(k, "owner", "full").join(e, "owner", "full")
        return stats.agg(*[F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in cols])
    out = owners.join(n_apps, "owner", "left").join(k, "owner", "left").join(e, "owner", "left")
    return out.select(F.col("owner").alias("user_id"),
                      *[F.coalesce(F.col(c), zero).cast("long").alias(c) for c in cols])


def dashboard(users: DataFrame, apps: DataFrame, keys: DataFrame, ev: DataFrame, as_of,
              user_id=None, nested: bool = False, rollup: DataFrame | None = None) -> DataFrame:
    """Q11 numbers (NULL -> 0) with the owner's Q10 app rows.

    Flat by default: one row per (user, app), users without apps kept once with
    NULL app fields. ``nested=True`` gives the reply shape, one row per user with
    the apps as an array (newest first, NULL creation time first); that collects
    each owner's app list into one row, so use it for bounded app lists only.
    ``rollup``: see ``app_with_stats``.
    """
    stats = dashboard_stats(users, apps, keys, ev, as_of, user_id, rollup)
    if user_id is not None:
        stats = stats.withColumn("user_id", F.lit(user_id))
    rows = (owner_apps(apps, keys, ev, as_of, user_id, rollup=rollup).withColumnRenamed("id", "app_id")
            .withColumnRenamed("events_last_7_days", "app_events_last_7_days"))
    if not nested:
        return stats.join(rows, "user_id", "left")
    listing = (rows.groupBy("user_id")
               .agg(F.sort_array(F.collect_list(F.struct(
                   F.col("created_at").isNull().alias("_undated"), "created_at", "app_id", "app_name",
                   "active_api_keys", "app_events_last_7_days", "last_event_at")), asc=False).alias("_apps"))
               .select("user_id", F.transform("_apps", lambda a: a.dropFields("_undated")).alias("apps")))
    return stats.join(listing, "user_id", "left")


# Q12 -----------------------------------------------------------------------

KEY_FIELDS = ("id", "key_prefix", "name", "is_active", "expires_at", "last_used_at", "created_at",
              "permissions", "rate_limit_per_hour")


def apps_with_keys(apps: DataFrame, keys: DataFrame, ev: DataFrame, as_of, user_id=None,
                   nested: bool = False) -> DataFrame:
    """Q12: Q10 rows with each app's keys (9 fields, newest first); hash/whitelist hidden.

    One join instead of one lookup per app. ``nested=False`` gives flat rows, one
    per (app, key), apps without keys kept with NULL key fields; ``nested=True``
    collects each app's keys into one array (bounded key lists only).
    """
    rows = owner_apps(apps, keys, ev, as_of, user_id)
    k = keys.select("app_id", *KEY_FIELDS)
    if not nested:
        kf = k.select(F.col("app_id").alias("_kapp"), *[F.col(c).alias(f"key_{c}") for c in KEY_FIELDS])
        return rows.join(kf, F.col("id") == F.col("_kapp"), "left").drop("_kapp")
    ordered = ("created_at",) + tuple(c for c in KEY_FIELDS if c != "created_at")
    arr = (k.groupBy("app_id")
            .agg(F.sort_array(F.collect_list(F.struct(*ordered)), asc=False).alias("apiKeys")))
    arr = arr.withColumnRenamed("app_id", "_kapp")
    out = rows.join(arr, F.col("id") == F.col("_kapp"), "left").drop("_kapp")
    return out.withColumn("apiKeys", F.coalesce(F.col("apiKeys"), F.array().cast(arr.schema["apiKeys"].dataType)))


# Q13 - Q17 -------------------------------------------------------------------

def apps_of_owner(apps: DataFrame, user_id) -> DataFrame:
    """Q13: the owner's apps, newest first (NULL created_at first)."""
    return (apps.filter(F.col("user_id") == F.lit(user_id))
                .orderBy(F.desc_nulls_first("created_at"), F.asc("id")))


def is_owner(apps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Q14: for every (app_id, user_id) pair, whether that app exists with that owner."""
    own = apps.select(F.col("id").alias("_app"), F.col("user_id").alias("_owner"), F.lit(True).alias("_hit"))
    j = pairs.join(own, (pairs["app_id"] == own["_app"]) & (pairs["user_id"] == own["_owner"]), "left")
    return j.select(*pairs.columns, F.coalesce(F.col("_hit"), F.lit(False)).alias("is_owner"))


def key_lookup(keys: DataFrame, apps: DataFrame, hashes: DataFrame) -> DataFrame:
    """Q15: key rows with owner ``user_id`` and ``app_name`` for the given key hashes."""
    h = hashes.select(F.col("key_hash").alias("_h")).distinct()
    k = keys.join(h, keys["key_hash"] == h["_h"], "left_semi")
    a = apps.select(F.col("id").alias("_app"), "user_id", "app_name")
    return k.join(a, k["app_id"] == a["_app"], "inner").drop("_app")


KEY_LIST_COLUMNS = ("id", "app_id", "key_prefix", "name", "is_active", "expires_at", "last_used_at",
                    "created_at", "revoked_at", "permissions", "allowed_ips", "rate_limit_per_hour")


def keys_of_app(keys: DataFrame, app_id=None) -> DataFrame:
    """Q16: the 12 listed key columns (never the hash), newest first; all apps when None."""
    k = keys if app_id is None else keys.filter(F.col("app_id") == F.lit(app_id))
    return k.select(*KEY_LIST_COLUMNS).orderBy(F.asc("app_id"), F.desc_nulls_first("created_at"), F.asc("id"))


def bulk_lookup(table: DataFrame, key_col: str, keys) -> DataFrame:
    """Q17: rows of ``table`` whose ``key_col`` is among ``keys`` (a list or a one-column frame)."""
    if isinstance(keys, DataFrame):
        kf = keys.select(F.col(keys.columns[0]).alias("_k")).distinct()
        return table.join(kf, table[key_col] == kf["_k"], "left_semi")
    return table.filter(F.col(key_col).isin(list(keys)))


# Q18 / Q19 -------------------------------------------------------------------

def user_status(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Q18: per requested user id: active flag, role (default 'user'), blocked when missing/inactive."""
    u = users.select(F.col("id").alias("_uid"), "is_active", "role")
    j = ids.join(u, ids["user_id"] == u["_uid"], "left")
    active = F.coalesce(F.col("is_active"), F.lit(False))
    return j.select(*ids.columns, active.alias("is_active"),
                    F.coalesce(F.col("role"), F.lit("user")).alias("role"),
                    (~active).alias("blocked"))


def _level_of_role(role_col, strict: bool):
    mapping = F.create_map(*[x for r, lvl in ROLE_LEVELS.items() for x in (F.lit(r), F.lit(lvl))])
    level = mapping[F.coalesce(role_col, F.lit("user"))]
    if strict:
        return F.coalesce(level, F.lit(LEVEL_USER))
    # JavaScript `level || USER`: a zero level (guest) also falls back to USER.
    return F.when(F.coalesce(level, F.lit(0)) == 0, F.lit(LEVEL_USER)).otherwise(level)


def security_levels(callers: DataFrame, users: DataFrame, required: int, strict: bool = False) -> DataFrame:
    """Q19: security level per caller and whether it meets ``required``.

    ``callers`` has a nullable ``user_id`` and an optional boolean ``has_api_key``.
    A signed-in user gets the level of their role (unknown role or unknown user:
    USER); otherwise an API-key caller gets BASIC and an anonymous one PUBLIC.
    """
    u = users.select(F.col("id").alias("_uid"), F.col("role").alias("_role"), F.lit(True).alias("_known"))
    j = callers.join(u, callers["user_id"] == u["_uid"], "left")
    has_key = F.coalesce(F.col("has_api_key"), F.lit(False)) if "has_api_key" in callers.columns else F.lit(False)
    level = (F.when(F.col("user_id").isNotNull(),
                    F.when(F.col("_known"), _level_of_role(F.col("_role"), strict)).otherwise(F.lit(LEVEL_USER)))
              .when(has_key, F.lit(LEVEL_BASIC))
              .otherwise(F.lit(LEVEL_PUBLIC)))
    return j.select(*callers.columns, level.alias("security_level"),
                    (level >= F.lit(required)).alias("allowed"))
