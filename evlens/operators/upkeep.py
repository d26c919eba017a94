"""Table upkeep M1-M15 and storage reports Q27-Q28.

Every change operator takes the current table and a *change set* DataFrame
(many registrations, revocations or touches at once) and returns the new
snapshot; the reference's single-row statements are the semantics of one change.
Snapshots are written to a new folder by the caller (``write_snapshot``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..session import folder_exists, remove_folder
from . import limits as L
from .filters import typed_lit
from .ingest import MONTHS_AHEAD, STATIC_MONTHS
from .reports import ROLLUP_COLUMNS, daily_summary


def _now(df: DataFrame, column: str, as_of):
    return typed_lit(df, column, as_of)


def _latest(changes: DataFrame, key: str, order_col: str | None) -> DataFrame:
    """Keep one change per key: the last by ``order_col`` (the last write wins); what is then
    still equal is settled by the changes' content, so a re-run keeps the same one."""
    order = [order_col] if order_col else []
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order], F.xxhash64(*changes.columns), *changes.columns)
    return changes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# M1 --------------------------------------------------------------------------

def upsert_users(users: DataFrame, changes: DataFrame, as_of, order_col: str | None = None) -> DataFrame:
    """M1: insert by google_id, or update email/name/profile_picture + updated_at/last_login_at.

    ``changes``: google_id, email, name, profile_picture (and optionally ``id`` for new rows).
    New users get role 'user', active, created_at = updated_at = as_of.
    """
    ch = _latest(changes, "google_id", order_col)
    now = _now(users, "created_at", as_of)
    c = ch.select(F.col("google_id").alias("_g"), F.col("email").alias("_email"), F.col("name").alias("_name"),
                  F.col("profile_picture").alias("_pic"), *( [F.col("id").alias("_id")] if "id" in ch.columns else []))
    j = users.join(c, users["google_id"] == c["_g"], "left")
    hit = F.col("_g").isNotNull()
    changed = {"email": "_email", "name": "_name", "profile_picture": "_pic"}
    cols = []
    for f in users.schema:
        if f.name in changed:
            cols.append(F.when(hit, F.col(changed[f.name])).otherwise(F.col(f.name)).alias(f.name))
        elif f.name in ("updated_at", "last_login_at"):
            cols.append(F.when(hit, now).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    updated = j.select(*cols)
    new = c.join(users.select("google_id"), c["_g"] == users["google_id"], "left_anti")
    new_id = F.col("_id") if "_id" in new.columns else F.expr("uuid()")
    defaults = {"id": new_id, "google_id": F.col("_g"), "email": F.col("_email"), "name": F.col("_name"),
                "profile_picture": F.col("_pic"), "role": F.lit("user"), "is_active": F.lit(True),
                "last_login_at": F.lit(None), "created_at": now, "updated_at": now}
    inserted = new.select(*[defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in users.schema])
    return updated.unionByName(inserted)


# M2 / M3 / M4 ------------------------------------------------------------------

def insert_apps(apps: DataFrame, new_apps: DataFrame, as_of) -> DataFrame:
    """M2: append apps (created_at = updated_at = as_of).

    C19: name, URL and description are trimmed; a registration whose name is
    missing or blank is refused (not inserted).
    """
    now = _now(apps, "created_at", as_of)
    trimmed = {c: F.trim(F.col(c)) for c in ("app_name", "app_url", "description") if c in new_apps.columns}
    new_apps = new_apps.withColumns(trimmed).filter(F.coalesce(F.col("app_name") != "", F.lit(False)))
    add = new_apps.select(*[(F.col(f.name) if f.name in new_apps.columns else
                             (now if f.name in ("created_at", "updated_at") else F.lit(None))).cast(f.dataType)
                            .alias(f.name) for f in apps.schema])
    return apps.unionByName(add)


def update_apps(apps: DataFrame, changes: DataFrame, as_of, order_col: str | None = None) -> DataFrame:
    """M3: COALESCE update of app_name/app_url/description by id; NULL never clears a field."""
    ch = _latest(changes, "id", order_col)
    fields = [c for c in ("app_name", "app_url", "description") if c in ch.columns]
    c = ch.select(F.col("id").alias("_id"), *[F.col(x).alias(f"_{x}") for x in fields])
    j = apps.join(c, apps["id"] == c["_id"], "left")
    hit = F.col("_id").isNotNull()
    now = _now(apps, "updated_at", as_of) if "updated_at" in apps.columns else None
    cols = []
    for f in apps.schema:
        if f.name in fields:
            cols.append(F.coalesce(F.col(f"_{f.name}"), F.col(f.name)).alias(f.name))
        elif f.name == "updated_at":
            cols.append(F.when(hit, now).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return j.select(*cols)


def delete_apps_cascade(apps: DataFrame, keys: DataFrame, events: DataFrame, app_ids: DataFrame):
    """M4: remove apps and, by cascade, their keys and events (anti joins).

    Returns (apps, keys, events) without the deleted apps. For the event table,
    only partitions that hold a deleted app need rewriting: see ``touched_dates``.
    """
    ids = app_ids.select(F.col(app_ids.columns[0]).alias("_del")).distinct()
    return (apps.join(ids, apps["id"] == ids["_del"], "left_anti"),
            keys.join(ids, keys["app_id"] == ids["_del"], "left_anti"),
            events.join(ids, events["app_id"] == ids["_del"], "left_anti"))


def delete_users_cascade(users, apps, keys, events, logs: list[DataFrame], user_ids: DataFrame):
    """M4 for users: users, their apps (and those apps' keys and events) go; log rows keep
    their row with ``user_id`` set to NULL (ON DELETE SET NULL)."""
    ids = user_ids.select(F.col(user_ids.columns[0]).alias("_del")).distinct()
    gone_apps = apps.join(ids, apps["user_id"] == ids["_del"], "left_semi").select("id")
    a, k, e = delete_apps_cascade(apps, keys, events, gone_apps)
    u = users.join(ids, users["id"] == ids["_del"], "left_anti")
    new_logs = []
    for lg in logs:
        j = lg.join(ids.withColumn("_hit", F.lit(True)), lg["user_id"].cast("string") == ids["_del"].cast("string"),
                    "left")
        new_logs.append(j.withColumn("user_id", F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("user_id")))
                         .drop("_del", "_hit"))
    return u, a, k, e, new_logs


def cascade_stored_events(spark: SparkSession, path: str, app_ids: DataFrame,
                          columns: tuple[str, ...] = ("event_date",)) -> dict:
    """M4 on the stored event table: delete the apps' events, rewriting only the partitions that hold any.

    Partitions without a deleted app keep their files; those left empty are dropped. What comes
    to the driver is a row a touched partition. Returns the rewritten and the dropped ones.
    """
    from ..sources.tables import cluster_events
    table = spark.read.parquet(path)
    ids = app_ids.select(F.col(app_ids.columns[0]).alias("_del")).distinct()
    gone = table["app_id"] == ids["_del"]
    touched = [tuple(r) for r in table.join(ids, gone, "left_semi").select(*columns).distinct().collect()]
    if not touched:
        return {"rewritten": [], "dropped": []}
    part = table.filter(F.struct(*columns).isin(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, t)]) for t in touched])
                        if len(columns) > 1 else F.col(columns[0]).isin(*[t[0] for t in touched]))
    left = part.join(ids, gone, "left_anti")
    kept = {tuple(r) for r in left.select(*columns).distinct().collect()}
    if kept:
        (cluster_events(left).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*columns).parquet(path))
    empty = [t for t in touched if t not in kept]
    for t in empty:
        folder = "/".join(f"{c}={v}" for c, v in zip(columns, t))
        remove_folder(spark, f"{path.rstrip('/')}/{folder}")
    return {"rewritten": sorted(kept), "dropped": sorted(empty)}


# M5 - M9 -----------------------------------------------------------------------

def insert_keys(keys: DataFrame, new_keys: DataFrame, as_of, default_name: str = "Default Key") -> DataFrame:
    """M5: store hash and prefix of each plain key (never the key), expiry = as_of + 365 days.

    ``new_keys``: id, app_id, api_key (plain), name. The name is trimmed; without one it is
    ``default_name``. Defaults: active, read+write, no IP list, 10000/h.
    """
    now = _now(keys, "created_at", as_of)
    vals = {"id": F.col("id"), "app_id": F.col("app_id"), "key_hash": K.key_hash(F.col("api_key")),
            "key_prefix": K.key_prefix(F.col("api_key")), "name": F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit(default_name)), "is_active": F.lit(True),
            "permissions": F.struct(F.lit(True).alias("read"), F.lit(True).alias("write")),
            "allowed_ips": F.lit(None), "rate_limit_per_hour": F.lit(L.KEY_HOUR_DEFAULT),
            "expires_at": K.key_expiry(now), "last_used_at": F.lit(None), "created_at": now,
            "revoked_at": F.lit(None)}
    add = new_keys.select(*[vals.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in keys.schema])
    return keys.unionByName(add)


def revoke_keys(keys: DataFrame, key_ids: DataFrame, as_of) -> DataFrame:
    """M6: is_active = false, revoked_at = as_of for the listed key ids."""
    ids = key_ids.select(F.col(key_ids.columns[0]).alias("_rev"), F.lit(True).alias("_hit")).distinct()
    j = keys.join(ids, keys["id"] == ids["_rev"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return (j.withColumn("is_active", F.when(hit, F.lit(False)).otherwise(F.col("is_active")))
             .withColumn("revoked_at", F.when(hit, _now(keys, "revoked_at", as_of)).otherwise(F.col("revoked_at")))
             .drop("_rev", "_hit"))


def delete_keys(keys: DataFrame, key_ids: DataFrame) -> DataFrame:
    """M7: remove the listed keys."""
    ids = key_ids.select(F.col(key_ids.columns[0]).alias("_del"))
    return keys.join(ids, keys["id"] == ids["_del"], "left_anti")


def touch_keys(keys: DataFrame, usage: DataFrame, minutes: int = 5) -> DataFrame:
    """M8: replay ``last_used_at`` updates over a batch of key uses.

    Each use at time u writes u only when the stored value is NULL or older than
    u - 5 minutes, so the stored values are the starts of an anchored 5-minute
    counter seeded by the current value. ``usage``: key_id, used_at. Returns the
    keys with the new ``last_used_at`` and ``touch_writes`` (writes performed).
    """
    seed = keys.filter(F.col("last_used_at").isNotNull()).select(
        F.col("id").alias("key_id"), F.col("last_used_at").alias("used_at"), F.lit(True).alias("_seed"))
    uses = usage.select("key_id", F.col("used_at").cast(keys.schema["last_used_at"].dataType).alias("used_at"),
                        F.lit(False).alias("_seed"))
    allu = seed.unionByName(uses)
    rep = L.anchored_counter(allu, ["key_id"], "used_at", minutes * 60, 1 << 62, tiebreak=["_seed"])
    starts = (rep.filter(F.col("window_count") == 1)
                 .groupBy("key_id")
                 .agg(F.max("window_start").alias("_last"), F.count_if(~F.col("_seed")).alias("touch_writes")))
    j = keys.join(starts, keys["id"] == starts["key_id"], "left")
    return (j.withColumn("last_used_at", F.coalesce(F.col("_last"), F.col("last_used_at")))
             .withColumn("touch_writes", F.coalesce(F.col("touch_writes"), F.lit(0)).cast("long"))
             .drop("key_id", "_last"))


def touch_logins(users: DataFrame, requests: DataFrame) -> DataFrame:
    """M9: last_login_at = latest authenticated request per user (no guard)."""
    last = requests.groupBy(F.col("user_id").alias("_u")).agg(F.max("received_at").alias("_last"))
    j = users.join(last, users["id"] == last["_u"], "left")
    return (j.withColumn("last_login_at",
                         F.greatest(F.col("last_login_at"), F.col("_last").cast(users.schema["last_login_at"].dataType)))
             .drop("_u", "_last"))


# Request paths whose calls are written to the audit log (':appId' removed).
SENSITIVE_PATHS = ("/api/auth/logout", "/api/auth/apps", "/api/auth/apps/:appId", "/api/auth/api-keys")


def audit_entries(requests: DataFrame, paths=SENSITIVE_PATHS) -> DataFrame:
    """Audit rows for requests whose path contains a sensitive route (substring match)."""
    hit = F.lit(False)
    for p in paths:
        hit = hit | F.col("path").contains(p.replace(":appId", ""))
    return requests.filter(hit).select(
        F.col("user_id").cast("string").alias("user_id"), F.col("method").alias("action"),
        F.col("path").alias("resource"), F.col("client_ip").alias("ip_address"), "user_agent",
        F.col("received_at").alias("created_at"))


# M11 / M12 -------------------------------------------------------------------

def month_floor(as_of) -> dt.date:
    d = as_of if isinstance(as_of, (dt.date, dt.datetime)) else dt.datetime.fromisoformat(str(as_of))
    return dt.date(d.year, d.month, 1)


def add_months(d: dt.date, n: int) -> dt.date:
    y, m = divmod(d.month - 1 + n, 12)
    return dt.date(d.year + y, m + 1, 1)


def expired_dates(events: DataFrame, as_of, months_to_keep: int = 12) -> DataFrame:
    """M11 (dry run): event_date partitions older than trunc(as_of, month) - n months.

    From the names of the partition folders alone; ``events`` is a stored, partitioned table.
    """
    cutoff = add_months(month_floor(as_of), -int(months_to_keep))
    return partition_values(events).filter(F.col("event_date") < F.lit(cutoff)).orderBy("event_date")


def partition_values(table: DataFrame, column: str = "event_date") -> DataFrame:
    """The distinct values of a stored table's first partition column, from the names of the folders
    below its root: one listing of one level, a row a partition, no file listed or opened."""
    spark, kind = table.sparkSession, table.schema[column].dataType
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    roots = table._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation().location().rootPaths()
    found = set()
    for k in range(roots.size()):
        root = roots.apply(k)
        for entry in root.getFileSystem(conf).listStatus(root):
            name = entry.getPath().getName()
            if name.startswith(f"{column}="):
                found.add(str(jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name.split("=", 1)[1])))
    rows = spark.createDataFrame([(None if v == "__HIVE_DEFAULT_PARTITION__" else v,) for v in sorted(found)], "v string")
    return rows.select(F.col("v").cast(kind).alias(column))


def drop_partitions(spark: SparkSession, path: str, column: str, values: list, dry_run: bool = True) -> list[str]:
    """Delete the given partition folders of a table (only when ``dry_run`` is False)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    dropped = []
    for v in values:
        p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{column}={v}")
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            dropped.append(str(p))
            if not dry_run:
                fs.delete(p, True)
    return dropped


def provisioned_months_frame(spark: SparkSession, as_of, ahead: int = MONTHS_AHEAD, static=STATIC_MONTHS) -> DataFrame:
    """The allowed-months frame: static months plus as-of month .. +ahead."""
    start = month_floor(as_of)
    rolling = (spark.range(0, ahead + 1)
                    .select(F.date_format(F.add_months(F.lit(start), F.col("id").cast("int")), "yyyy-MM")
                            .alias("month")))
    fixed = spark.createDataFrame([(m,) for m in static], "month string")
    return rolling.unionByName(fixed).distinct()


# M13 -------------------------------------------------------------------------

def touched_dates(batch: DataFrame, ts: str = "timestamp") -> list:
    """Dates a batch of events touches (one small driver-side list per batch)."""
    col = F.col("event_date") if "event_date" in batch.columns else F.to_date(ts)
    return [r[0] for r in batch.select(col.alias("d")).distinct().collect()]


def refresh_rollup(events: DataFrame, dates: list | None = None) -> DataFrame:
    """The rollup rows of the given dates recomputed from the base table (all when None).

    Write the result with ``write_rollup`` (dynamic overwrite of those dates only);
    dates without base rows any more are removed with ``vanished_dates``.
    """
    ev = events
    if dates is not None:
        day = F.col("event_date") if "event_date" in ev.columns else F.to_date("timestamp")
        ev = ev.filter(day.isin(list(dates)))
    return daily_summary(ev)


# The distinct counts of the rollup and the columns that they count.
FIRST_SEEN = {"session": "session_id", "user": "user_id", "device": "device", "country": "country"}


def add_to_rollup(batch: DataFrame, base: str, batch_id: int) -> None:
    """M13 from a batch alone: exact distinct counts without reading any stored event.

    ``first_seen`` holds each (app, day, event, kind, value) once, under the batch that brought
    it; ``deltas`` what each batch adds to the day's counts. A batch is compared with the first-seen
    partitions of its own days and earlier batches, so late events count right, and running a
    batch again overwrites its own partitions with the same rows.
    """
    spark, base = batch.sparkSession, base.rstrip("/")
    day = F.col("event_date") if "event_date" in batch.columns else F.to_date("timestamp")
    rows = batch.select("app_id", day.alias("date"), "event_name", *FIRST_SEEN.values())
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in FIRST_SEEN.items()]))
    names = ["app_id", "date", "event_name", "kind", "value"]
    facts = rows.select("app_id", "date", "event_name", kinds.alias("f")).select(
        "app_id", "date", "event_name", "f.kind", "f.value").filter("value IS NOT NULL")
    number = F.lit(int(batch_id)).alias("batch")
    schema = facts.select("app_id", "event_name", "kind", "value", "date", number).schema
    if folder_exists(spark, f"{base}/first_seen"):
        dates = [r[0] for r in rows.select("date").distinct().collect()]  # the batch's days
        seen = spark.read.schema(schema).parquet(f"{base}/first_seen").filter(F.col("date").isin(dates) & (F.col("batch") < batch_id))
        # One grouping makes the facts distinct and drops those seen before.
        both = facts.withColumn("_old", F.lit(False)).unionByName(seen.select(*names, F.lit(True).alias("_old")))
        facts = both.groupBy(*names).agg(F.max("_old").alias("_old")).filter("NOT _old").drop("_old")
    else:
        facts = facts.distinct()

    def put(df: DataFrame, name: str) -> None:
        # A day's rows go to few tasks (a large day to several), so that days x tasks aren't all files.
        (df.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("date", "batch").parquet(f"{base}/{name}"))

    put(facts.select("*", number), "first_seen")
    zero = [F.lit(0).cast("long").alias(f"{k}s") for k in FIRST_SEEN]
    new = spark.read.schema(schema).parquet(f"{base}/first_seen").filter(F.col("batch") == batch_id)
    one = [F.when(F.col("kind") == k, F.lit(1)).otherwise(F.lit(0)).cast("long").alias(f"{k}s") for k in FIRST_SEEN]
    parts = rows.select("app_id", "date", "event_name", F.lit(1).cast("long").alias("events"), *zero).unionByName(
        new.select("app_id", "date", "event_name", F.lit(0).cast("long").alias("events"), *one))
    sums = parts.groupBy("app_id", "date", "event_name").agg(*[F.sum(c).alias(c) for c in ("events", *(f"{k}s" for k in FIRST_SEEN))])
    put(sums.select("*", number), "deltas")


def rollup_of_deltas(spark: SparkSession, base: str) -> DataFrame:
    """The daily rollup (as Q8) from what every batch added."""
    deltas = spark.read.parquet(f"{base.rstrip('/')}/deltas")
    return deltas.groupBy("app_id", "date", "event_name").agg(
        F.sum("events").alias("event_count"), F.sum("sessions").alias("unique_sessions"), F.sum("users").alias("unique_users"),
        F.sum("devices").alias("unique_devices"), F.sum("countrys").alias("unique_countries")).select(*ROLLUP_COLUMNS)


def distinct_over_days(first_seen: DataFrame, kind: str = "user", start=None, end=None) -> DataFrame:
    """A2 over any range of days, exact, from the first-seen table instead of the events: per app and
    event the distinct values of a kind between two days (both included)."""
    d = first_seen.filter(F.col("kind") == kind)
    if start is not None:
        d = d.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.filter(F.col("date") <= F.lit(end).cast("date"))
    return d.groupBy("app_id", "event_name").agg(F.count_distinct("value").alias(f"unique_{kind}s"))


def touched_apps(batch: DataFrame) -> DataFrame:
    """The distinct apps of a batch of events, with their number of events (batch receipt)."""
    return batch.groupBy("app_id").agg(F.count(F.lit(1)).alias("events"))


def _stored_partitions(table: DataFrame) -> list[str]:
    """The partition columns of a frame that is a file scan, else none."""
    leaf = table._jdf.queryExecution().analyzed().collectLeaves().apply(0)
    return list(leaf.relation().partitionSchema().fieldNames()) if leaf.getClass().getSimpleName() == "LogicalRelation" else []


def vanished_dates(rollup: DataFrame, events: DataFrame) -> DataFrame:
    """Rollup dates whose base rows are gone (e.g. dropped by retention)."""
    day = F.col("event_date") if "event_date" in events.columns else F.to_date("timestamp")
    base = (partition_values(events).select(F.col("event_date").alias("date")) if "event_date" in _stored_partitions(events)
            else events.select(day.alias("date")).distinct())
    return rollup.select("date").distinct().join(base, "date", "left_anti")


# Q27 / Q28 -------------------------------------------------------------------

def partition_stats(spark: SparkSession, path: str, column: str = "event_date") -> DataFrame:
    """Q27: per partition value: bytes on disk, files and rows (file metadata; no data columns read)."""
    df = spark.read.parquet(path).select(column, F.col("_metadata.file_path").alias("f"),
                                         F.col("_metadata.file_size").alias("s"))
    per_file = df.groupBy(column, "f").agg(F.count(F.lit(1)).alias("rows"), F.first("s").alias("s"))
    return (per_file.groupBy(column)
                    .agg(F.sum("s").alias("size_bytes"), F.count(F.lit(1)).alias("files"),
                         F.sum("rows").alias("rows"))
                    .orderBy(column))


def table_stats(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Q28: size per table, largest first."""
    parts = []
    for name, path in tables.items():
        df = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"),
                                             F.col("_metadata.file_size").alias("s"))
        parts.append(df.groupBy("f").agg(F.first("s").alias("s"), F.count(F.lit(1)).alias("rows"))
                       .agg(F.sum("s").alias("size_bytes"), F.sum("rows").alias("rows"))
                       .select(F.lit(name).alias("table_name"), "size_bytes", "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("size_bytes"))


# M15 -------------------------------------------------------------------------

def upkeep(spark: SparkSession, events_path: str, rollup_path: str, as_of, months_to_keep: int = 12,
           drop: bool = False, touched: list | None = None) -> dict:
    """Provision frame, retention, rollup refresh, partition stats; reports what ran.

    The rollup is refreshed for the ``touched`` days (all when None), then its days without
    any event left are dropped. Each task is attempted; failures are listed, not raised.
    """
    from ..sources.tables import write_rollup
    report = {"success": [], "failed": []}

    def step(name, fn):
        try:
            out = fn()
            report["success"].append(name)
            return out
        except Exception as e:  # report and continue, as the reference's job does
            report["failed"].append({"task": name, "error": str(e)})
            return None

    events = spark.read.parquet(events_path)
    report["months"] = step("provision", lambda: [r[0] for r in provisioned_months_frame(spark, as_of).collect()])
    expired = step("retention", lambda: [r[0] for r in expired_dates(events, as_of, months_to_keep).collect()])
    if expired:
        report["dropped"] = step("drop", lambda: drop_partitions(spark, events_path, "event_date",
                                                                 [str(d) for d in expired], dry_run=not drop))
    events = spark.read.parquet(events_path)
    step("refresh", lambda: write_rollup(refresh_rollup(events, touched), rollup_path))
    report["vanished"] = step("vanished", lambda: drop_partitions(spark, rollup_path, "date", [
        str(r[0]) for r in vanished_dates(spark.read.parquet(rollup_path), events).collect()], dry_run=False))
    report["partitions"] = step("stats", lambda: partition_stats(spark, events_path).count())
    return report
