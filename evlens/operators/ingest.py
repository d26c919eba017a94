"""Event admission I1-I15: raw collect requests in, accepted events and quarantine out.

One pass computes ``reject_reason`` = the first failing step, in the order the
reference's request pipeline runs them:

  too_large -> malformed_body -> sql_pattern -> api_key_missing -> api_key_invalid
  -> api_key_ip_blocked -> api_key_rate_limit -> no_permission -> collect_rate_limit
  -> validation -> constraint:<column> -> no_partition

Everything is Column expressions plus one left join to the key dimension, except
the two counters (I7, I9), which use the exact counter replay of
``operators.limits``. A counter only counts the requests that reached it: rows
already rejected get a private key, so they never share a counter with anyone.
The annotated rows are stored once (released by ``persist_scope`` around
the caller's writes); the counters shuffle only narrow frames, which are stored in
the shared folder (their lineage ends there), and the rows over a limit are joined
back by row id.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as X
from ..functions import useragent as UA
from ..session import stored
from . import limits as L
from .lookup import spread_lookup

# Body fields of a collect request (all strings; metadata is JSON text).
BODY_FIELDS = ("event", "url", "referrer", "device", "ipAddress", "userId", "sessionId", "timestamp_text",
               "metadata")
# JSON texts whose string values are screened one by one; ``extra`` holds all other fields of the body.
NESTED_FIELDS = ("metadata", "extra")
HEADER_FIELDS = ("api_key", "client_ip", "user_agent")

# Storage limits of the event table, in column order (characters).
VARCHAR_LIMITS = (("event_name", 255), ("device", 50), ("ip_address", 45), ("user_id", 255),
                  ("session_id", 255), ("browser", 100), ("os", 100), ("screen_size", 50),
                  ("country", 2), ("city", 100))
# Months provisioned by the schema itself, besides current..current+11.
STATIC_MONTHS = ("2024-02", "2024-03", "2024-11", "2024-12", "2025-01", "2025-02")
MONTHS_AHEAD = 11

# The severity of each key-check event.
SECURITY_SEVERITY = {"api_key_missing": "low", "api_key_invalid": "medium",
                     "api_key_ip_blocked": "high", "api_key_rate_limit": "medium"}

EVENT_COLUMNS = ("id", "app_id", "event_name", "url", "referrer", "device", "ip_address", "user_id",
                 "session_id", "timestamp", "metadata", "browser", "os", "screen_size", "country", "city",
                 "created_at")


def provisioned_months(as_of, ahead: int = MONTHS_AHEAD, static=STATIC_MONTHS) -> list[str]:
    """Months with a partition: the static ones plus the as-of month and ``ahead`` more."""
    d = as_of if isinstance(as_of, (dt.date, dt.datetime)) else dt.datetime.fromisoformat(str(as_of))
    y, m = d.year, d.month
    out = set(static)
    for i in range(ahead + 1):
        yy, mm = y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1
        out.add(f"{yy:04d}-{mm:02d}")
    return sorted(out)


def _with_body(raw: DataFrame) -> DataFrame:
    for c in BODY_FIELDS + HEADER_FIELDS + ("extra",):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return raw


def _first_reason(*steps: tuple[Column, str]) -> Column:
    expr = None
    for cond, reason in steps:
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))
    return expr


def admission(raw: DataFrame, keys: DataFrame, apps: DataFrame, as_of=None, months=None,
              key_hour_ttl: int = L.KEY_HOUR_TTL, collect_limit: int = L.COLLECT_LIMIT,
              collect_ttl: int = L.COLLECT_TTL, seeds: dict | None = None,
              counters: dict | None = None, spread_keys: bool = False, distinct_agents: bool = False) -> DataFrame:
    """Annotate every raw request with ``reject_reason`` (NULL = accepted),
    ``validation_errors`` and the enriched event columns.

    ``raw`` needs ``received_at`` plus any of the header/body columns (missing ones
    are NULL); it should be a file scan (row ids are assigned on its order). ``keys`` is the api_keys table, ``apps`` the apps table (a key whose
    app is gone is unknown, as the key lookup joins apps). ``months`` is the list
    of provisioned 'YYYY-MM' months (default: from ``as_of``, else from each
    request's arrival).

    ``seeds`` carries open counters from earlier batches ({'key_hour': frame,
    'collect': frame}, see ``counter_state``); a dict given as ``counters`` receives the
    stored counter frames with exact windows and counts, for the next seed. With
    ``spread_keys`` the key lookup deals busy keys over many tasks (one more pass over the
    keys of ``raw``): for key tables that are too large to broadcast. With ``distinct_agents``
    the user-agent rules run once an agent, on a stored table of the distinct ones that is joined
    back with busy agents dealt over many tasks. The rows are the same either way.
    """
    seeds = seeds or {}
    # Row ids are taken straight off the input scan, before any shuffle, so a
    # recomputed partition (lost executor) gets the same ids again.
    d = _with_body(raw).withColumn("_rowid", F.monotonically_increasing_id())
    # I1 body size (bytes of the JSON body), measured before sanitising. The raw value
    # bytes bound it from below, six times that (worst-case escaping) plus the field
    # names from above; the body is serialised only when the bounds cannot decide.
    scalar_body = F.to_json(F.struct(*[F.col(c) for c in BODY_FIELDS if c != "metadata"]))
    nested = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in NESTED_FIELDS)
    exact = F.octet_length(scalar_body) + nested
    lower = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in BODY_FIELDS) + F.coalesce(F.octet_length("extra"), F.lit(0))
    # Per field at most: quoted name, colon, quoted value, comma; escaping at most 6x.
    upper = lower * 6 + sum(len(c) + 6 for c in BODY_FIELDS) + 2
    size = (F.when(lower > X.BODY_MAX_BYTES, lower)
             .when(upper <= X.BODY_MAX_BYTES, lower)
             .otherwise(exact))
    if "body_bytes" in d.columns:
        size = F.coalesce("body_bytes", size)
    # I2 sanitise: top-level strings by Column regexes, the values of nested JSON by the walk
    # (only where the raw text needs it). Each step is one projection.
    needs = {c: F.coalesce(F.col(c).rlike(X.NEEDS_WALK_PATTERN), F.lit(False)) for c in NESTED_FIELDS}
    d = d.withColumns({
        # Stable per-request tie-break for equal arrival times.
        "_rid": F.xxhash64(*[F.col(c) for c in ("received_at",) + HEADER_FIELDS + BODY_FIELDS + ("extra",)]),
        "_size": size,
        "_meta_ok": F.col("metadata").isNull() | F.try_parse_json(F.col("metadata")).isNotNull(),
        **{c: X.sanitize(F.col(c)) for c in BODY_FIELDS if c not in NESTED_FIELDS},
        **{f"_walk_{c}": F.when(needs[c], X.metadata_walk(F.col(c))) for c in NESTED_FIELDS},
    })
    d = d.withColumns({c: F.coalesce(F.col(f"_walk_{c}.text"), F.col(c)) for c in NESTED_FIELDS})
    # I3 screen
    inj = F.lit(False)
    for c in BODY_FIELDS:
        if c not in NESTED_FIELDS:
            inj = inj | X.injection_hit(F.col(c))
    for c in NESTED_FIELDS:
        inj = inj | F.coalesce(F.col(f"_walk_{c}.injection"), F.lit(False))

    # I5 key lookup: keys joined to their app (inner), matched on the hash.
    kd = (keys.join(apps.select(F.col("id").alias("_app_id")), keys["app_id"] == F.col("_app_id"), "inner")
              .select(F.col("key_hash").alias("_key_hash"), F.col("id").alias("key_id"),
                      F.col("app_id").alias("_key_app"), F.col("is_active").alias("_key_active"),
                      F.col("expires_at").alias("_key_expires"), F.col("allowed_ips").alias("_key_ips"),
                      F.col("permissions").alias("_key_perms"),
                      F.col("rate_limit_per_hour").alias("_key_limit")))
    d = d.withColumn("_hash", F.when(F.col("api_key").isNotNull() & (F.col("api_key") != ""),
                                     K.key_hash(F.col("api_key"))))
    if spread_keys:
        d = spread_lookup(d, "_hash", kd, "_key_hash", F.col("_rowid"))
    else:
        d = d.join(kd, F.col("_hash") == F.col("_key_hash"), "left")
    now = F.col("received_at").cast(keys.schema["expires_at"].dataType) if "expires_at" in keys.columns \
        else F.col("received_at")
    stateless = _first_reason(
        (F.col("_size") > X.BODY_MAX_BYTES, "too_large"),
        (~F.col("_meta_ok")
         | (F.col("_corrupt_record").isNotNull() if "_corrupt_record" in raw.columns else F.lit(False)),
         "malformed_body"),
        (inj, "sql_pattern"),
        (F.col("_hash").isNull(), "api_key_missing"),
        (F.col("key_id").isNull() | ~K.key_usable(F.col("_key_active"), F.col("_key_expires"), now),
         "api_key_invalid"),
        (~K.ip_allowed(F.col("_key_ips"), F.col("client_ip")), "api_key_ip_blocked"),
    )
    # The wide annotated rows are stored once; the counters see a narrow stored frame of only the
    # requests that reach them, and only the rows over a limit are joined back.
    may_write = K.has_permission(F.col("_key_perms"), "write")
    d = stored(d.withColumn("_reason", stateless).drop(
        "_walk_metadata", "_walk_extra", "_meta_ok", "_size", "_hash", "_key_hash", "_key_active", "_key_expires", "_app_id"), "annotated")
    reach = stored(d.filter(F.col("_reason").isNull()).select(
        "_rowid", "_rid", "received_at", "_key_limit", F.coalesce(may_write, F.lit(False)).alias("_may_write"),
        F.concat(F.lit("k"), F.col("key_id").cast("string")).alias("_k1"),
        F.concat(F.lit("k"), F.coalesce(F.nullif(F.col("api_key"), F.lit("")), F.col("client_ip"))).alias("_k2")), "reach")

    # I7 per-key hourly counter over the requests that reached it.
    breach_only = counters is None
    c1 = stored(L.anchored_counter(reach, ["_k1"], "received_at", key_hour_ttl,
                                   F.coalesce(F.nullif(F.col("_key_limit"), F.lit(0)), F.lit(L.KEY_HOUR_DEFAULT)),
                                   tiebreak=["_rid"], breach_only=breach_only, seed=seeds.get("key_hour")), "key-hour")
    # I8 write permission, then I9 per key-header (else IP) minute counter.
    n = c1.filter(~F.col("limit_exceeded") & F.col("_may_write")).select("_rowid", "_rid", "received_at", "_k2")
    c2 = stored(L.anchored_counter(n, ["_k2"], "received_at", collect_ttl, collect_limit, tiebreak=["_rid"],
                                   breach_only=breach_only, seed=seeds.get("collect")), "collect")
    if counters is not None:
        counters.update(key_hour=c1, collect=c2)
    late = c1.filter("limit_exceeded").select("_rowid", F.lit("api_key_rate_limit").alias("_late")).unionByName(
        c2.filter("limit_exceeded").select("_rowid", F.lit("collect_rate_limit").alias("_late")))
    # Only requests that reached the counters can be late: no other row is shuffled for the join.
    d = (d.filter(F.col("_reason").isNull()).join(late, "_rowid", "left")
          .unionByName(d.filter(F.col("_reason").isNotNull()).withColumn("_late", F.lit(None).cast("string"))))
    first = F.when(F.col("_late") == "api_key_rate_limit", F.col("_late"))
    d = d.withColumn("_reason", F.coalesce("_reason", first, F.when(~may_write, F.lit("no_permission")), "_late")).drop("_late")

    # I10 validators (all run; errors listed).
    ev = F.col("event")
    checks = [
        (ev.isNull() | (ev == ""), "event_required"),
        (F.length(ev) > X.EVENT_NAME_MAX, "event_too_long"),
        (F.coalesce(~X.valid_event_name(ev), F.lit(True)), "event_invalid_chars"),
        (F.col("url").isNotNull() & (F.length("url") > X.URL_MAX), "url_too_long"),
        (F.col("timestamp_text").isNotNull() & ~F.coalesce(X.is_iso8601(F.col("timestamp_text")), F.lit(False)),
         "timestamp_invalid"),
        (F.col("metadata").isNotNull() & ~F.coalesce(X.is_json_object(F.col("metadata")), F.lit(False)),
         "metadata_not_object"),
    ]
    errors = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())
    d = d.withColumn("validation_errors", errors)

    # I11 / I12 enrichment.
    ua = F.nullif(F.col("user_agent"), F.lit(""))
    agent = {"browser": UA.agent_browser(ua), "os": UA.agent_os(ua), "handheld": UA.agent_is_handheld(ua)}
    if distinct_agents:
        agents = stored(d.select(ua.alias("_agent")).filter("_agent IS NOT NULL").distinct().select(
            "_agent", *[rule(F.col("_agent")).alias(f"_agent_{name}") for name, rule in UA.AGENT_RULES.items()]), "agents")
        d = spread_lookup(d, "user_agent", agents, "_agent", F.col("_rowid"))
        agent = {name: F.col(f"_agent_{name}") for name in agent}
    meta = F.col("metadata")
    m_browser, m_os = X.json_field(meta, "browser"), X.json_field(meta, "os")
    browser = F.when(ua.isNotNull(), X.js_or(m_browser, agent["browser"]))
    os_ = F.when(ua.isNotNull(), X.js_or(m_os, agent["os"]))
    device_type = F.when(ua.isNotNull(), X.js_or(F.col("device"), F.when(agent["handheld"], F.lit("mobile"))
                                                  .otherwise(F.lit("desktop"))))
    ts_text = F.nullif(F.col("timestamp_text"), F.lit(""))
    parsed = F.try_to_timestamp(ts_text).cast("timestamp_ntz")
    arrival = F.col("received_at").cast("timestamp_ntz")
    # One projection; every expression reads the columns as they were before it.
    d = d.withColumns({
        "app_id": F.col("_key_app"),
        "event_name": F.col("event"),
        "device": X.js_or(device_type, F.col("device")),
        "ip_address": X.js_or(F.col("ipAddress"), F.col("client_ip")),
        "user_id": F.col("userId"),
        "session_id": F.col("sessionId"),
        "timestamp": F.when(ts_text.isNull(), arrival).otherwise(parsed),
        "browser": X.js_or(browser, m_browser),
        "os": X.js_or(os_, m_os),
        "screen_size": X.json_field(meta, "screenSize"),
        "country": X.json_field(meta, "country"),
        "city": X.json_field(meta, "city"),
        "created_at": arrival,
    })

    # I13 storage constraints.
    if months is None:
        months = provisioned_months(as_of) if as_of is not None else None
    month = F.date_format("timestamp", "yyyy-MM")
    month_ok = F.lit(True) if months is None else month.isin(list(months))
    constraint_steps = [(F.length(c) > n, f"constraint:{c}") for c, n in VARCHAR_LIMITS]
    constraint_steps.insert(0, (ts_text.isNotNull() & F.col("timestamp").isNull(), "constraint:timestamp"))
    constraint_steps.append((~month_ok, "no_partition"))
    later = _first_reason((F.size("validation_errors") > 0, "validation"), *constraint_steps)
    d = d.withColumn("reject_reason", F.coalesce(F.col("_reason"), later))
    return d.drop("_agent", "_agent_browser", "_agent_os", "_agent_handheld", "_reason", "_rowid", "_meta_ok", "_size", "_hash", "_key_hash", "_key_active",
                  "_key_expires", "_key_perms", "_key_limit", "_app_id")


def counter_state(counters: dict, previous: dict | None, last_seen, key_hour_ttl: int = L.KEY_HOUR_TTL,
                  collect_ttl: int = L.COLLECT_TTL) -> dict:
    """Open counters after a batch (``counters`` as ``admission`` filled it): the batch's last
    window per counter key, plus earlier seeds of keys the batch did not touch, minus windows
    already expired at the batch's last arrival ``last_seen``."""
    previous = previous or {}
    out = {}
    for name, key, ttl in (("key_hour", "_k1", key_hour_ttl), ("collect", "_k2", collect_ttl)):
        now = L.open_counters(counters[name], [key], "window_start", ttl)
        prev = previous.get(name)
        if prev is not None:
            now = now.unionByName(prev.join(now.select(key), key, "left_anti"))
        if last_seen is not None:
            ts_type = counters[name].schema["received_at"].dataType
            now = now.filter(F.col("window_start") + F.expr(f"INTERVAL {int(ttl)} SECONDS")
                             >= F.lit(last_seen).cast(ts_type))
        out[name] = now
    return out


def accepted_events(adm: DataFrame, with_ids: bool = True) -> DataFrame:
    """Accepted rows in the event-table layout, plus the ``event_date`` partition column.

    ``id`` is a fresh UUID per event (non-deterministic: write the frame once,
    then read it back; never recompute it for a second sink).
    """
    acc = adm.filter(F.col("reject_reason").isNull())
    cols = [c for c in EVENT_COLUMNS if c != "id"]
    out = acc.select(*([F.expr("uuid()").alias("id")] if with_ids else []), *cols)
    return out.withColumn("event_date", F.to_date("timestamp"))


def receipts(events: DataFrame) -> DataFrame:
    """I14 receipt: id, event name and timestamp of each stored event."""
    return events.select("id", F.col("event_name").alias("event"), "timestamp")


def quarantine(adm: DataFrame) -> DataFrame:
    """Rejected requests with their reason and validation errors (headers kept, key hidden)."""
    rej = adm.filter(F.col("reject_reason").isNotNull())
    return rej.select("received_at", "client_ip", "user_agent", *BODY_FIELDS, "extra", "key_id", "reject_reason",
                      "validation_errors")


def security_events(adm: DataFrame) -> DataFrame:
    """One security event per key-check rejection (missing, invalid, IP blocked, rate limit)."""
    sev = F.create_map(*[x for k, v in SECURITY_SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    rej = adm.filter(F.col("reject_reason").isin(*SECURITY_SEVERITY))
    meta = (F.when(F.col("reject_reason") == "api_key_ip_blocked",
                   F.to_json(F.struct(F.col("key_id").alias("apiKeyId"), F.col("_key_ips").alias("allowedIPs"))))
             .when(F.col("reject_reason") == "api_key_rate_limit",
                   F.to_json(F.struct(F.col("key_id").alias("apiKeyId"))))
             .otherwise(F.lit("{}")))
    return rej.select(F.col("reject_reason").alias("event_type"), sev[F.col("reject_reason")].alias("severity"),
                      F.col("client_ip").alias("ip_address"), F.lit(None).cast("string").alias("user_id"),
                      F.concat(F.lit("Security event: "), F.col("reject_reason")).alias("description"),
                      meta.alias("metadata"), F.lit(False).alias("resolved"),
                      F.col("received_at").alias("created_at"))
