"""Stored tables: schemas, scans with pruning (S1-S4) and sinks.

Layout on shared storage (parquet):
  events/            partitionBy(event_date), rows sorted by (app_id, event_name, timestamp)
                     inside each file so row-group min/max statistics prune tenant filters
  daily_summary/     partitionBy(date)
  security_events/, audit_logs/, request_log/   partitionBy(log_date)
  users/, apps/, api_keys/                      snapshot folders (rewritten whole, small)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import filter_time

TS = T.TimestampNTZType()
S = T.StringType()
L = T.LongType()

EVENTS = T.StructType([
    T.StructField("id", S), T.StructField("app_id", L), T.StructField("event_name", S), T.StructField("url", S),
    T.StructField("referrer", S), T.StructField("device", S), T.StructField("ip_address", S),
    T.StructField("user_id", S), T.StructField("session_id", S), T.StructField("timestamp", TS),
    T.StructField("metadata", S), T.StructField("browser", S), T.StructField("os", S),
    T.StructField("screen_size", S), T.StructField("country", S), T.StructField("city", S),
    T.StructField("created_at", TS), T.StructField("event_date", T.DateType()),
])
USERS = T.StructType([
    T.StructField("id", L), T.StructField("google_id", S), T.StructField("email", S), T.StructField("name", S),
    T.StructField("profile_picture", S), T.StructField("role", S), T.StructField("is_active", T.BooleanType()),
    T.StructField("last_login_at", TS), T.StructField("created_at", TS), T.StructField("updated_at", TS),
])
APPS = T.StructType([
    T.StructField("id", L), T.StructField("user_id", L), T.StructField("app_name", S), T.StructField("app_url", S),
    T.StructField("description", S), T.StructField("created_at", TS), T.StructField("updated_at", TS),
])
PERMISSIONS = T.StructType([T.StructField("read", T.BooleanType()), T.StructField("write", T.BooleanType())])
API_KEYS = T.StructType([
    T.StructField("id", L), T.StructField("app_id", L), T.StructField("key_hash", S), T.StructField("key_prefix", S),
    T.StructField("name", S), T.StructField("is_active", T.BooleanType()), T.StructField("permissions", PERMISSIONS),
    T.StructField("allowed_ips", T.ArrayType(S)), T.StructField("rate_limit_per_hour", T.IntegerType()),
    T.StructField("expires_at", TS), T.StructField("last_used_at", TS), T.StructField("created_at", TS),
    T.StructField("revoked_at", TS),
])
SECURITY_EVENTS = T.StructType([
    T.StructField("id", S), T.StructField("event_type", S), T.StructField("severity", S),
    T.StructField("ip_address", S), T.StructField("user_id", S), T.StructField("description", S),
    T.StructField("metadata", S), T.StructField("resolved", T.BooleanType()), T.StructField("created_at", TS),
])
AUDIT_LOGS = T.StructType([
    T.StructField("id", S), T.StructField("user_id", S), T.StructField("action", S), T.StructField("resource", S),
    T.StructField("ip_address", S), T.StructField("user_agent", S), T.StructField("success", T.BooleanType()),
    T.StructField("error_message", S), T.StructField("metadata", S), T.StructField("created_at", TS),
])
DAILY_SUMMARY = T.StructType([
    T.StructField("app_id", L), T.StructField("date", T.DateType()), T.StructField("event_name", S),
    T.StructField("event_count", L), T.StructField("unique_sessions", L), T.StructField("unique_users", L),
    T.StructField("unique_devices", L), T.StructField("unique_countries", L),
])
REQUEST_LOG = T.StructType([
    T.StructField("received_at", TS), T.StructField("method", S), T.StructField("path", S),
    T.StructField("endpoint", S), T.StructField("status", T.IntegerType()), T.StructField("duration_ms", T.DoubleType()),
    T.StructField("user_id", S), T.StructField("client_ip", S), T.StructField("user_agent", S),
])
# One JSON line per collect request: headers plus the body (metadata kept as JSON text; ``extra`` is the
# JSON text of all further fields of the line and of known ones that hold nested values).
RAW_REQUEST = T.StructType([
    T.StructField("received_at", TS), T.StructField("api_key", S), T.StructField("client_ip", S),
    T.StructField("user_agent", S), T.StructField("body_bytes", L),
    T.StructField("event", S), T.StructField("url", S), T.StructField("referrer", S), T.StructField("device", S),
    T.StructField("ipAddress", S), T.StructField("userId", S), T.StructField("sessionId", S),
    T.StructField("timestamp_text", S), T.StructField("metadata", S), T.StructField("extra", S),
    T.StructField("_corrupt_record", S),
])
_LINE_FIELDS = [f.name for f in RAW_REQUEST.fields if f.name not in ("extra", "_corrupt_record")]
# Known fields of the body whose values are walked as nested ones if they aren't scalars.
_BODY_SCALARS = ("event", "url", "referrer", "device", "ipAddress", "userId", "sessionId", "timestamp_text")

DIMENSIONS = {"users": USERS, "apps": APPS, "api_keys": API_KEYS}
LOGS = {"security_events": SECURITY_EVENTS, "audit_logs": AUDIT_LOGS, "request_log": REQUEST_LOG}


def read_events(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """The event table with the time range repeated on ``event_date`` (partition pruning)."""
    return filter_time(spark.read.schema(EVENTS).parquet(path), start, end)


def read_dim(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A dimension snapshot with its fixed schema."""
    return spark.read.schema(DIMENSIONS[name]).parquet(path)


def read_log(spark: SparkSession, path: str, name: str) -> DataFrame:
    """S3: a log table (partitioned by ``log_date``)."""
    schema = T.StructType(LOGS[name].fields + [T.StructField("log_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


# Arrival times keep microseconds in the JSON text.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_raw(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """Raw collect requests as JSON lines; bad lines kept in ``_corrupt_record``.

    A ``metadata`` object is read as its JSON text (the schema declares a string). Fields that
    the schema doesn't name are kept, as one JSON text in ``extra``: a line's field names are
    listed first, and only lines that have such fields are parsed in full.
    """
    reader = spark.readStream if streaming else spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    line = F.col("value")
    known = T.StructType([f for f in RAW_REQUEST.fields if f.name != "extra"])
    parse = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "timestampNTZFormat": TS_FORMAT}
    unknown = F.size(F.array_except(F.json_object_keys(line), F.array(*[F.lit(c) for c in _LINE_FIELDS]))) > 0
    nested = F.lit(False)
    for c in _BODY_SCALARS:
        nested = nested | F.coalesce(F.col(f"r.{c}").rlike(r"^[\[{]"), F.lit(False))
    fields = F.map_filter(F.from_json(line, "map<string,variant>"), lambda k, v: ~k.isin(*_LINE_FIELDS) | (
        k.isin(*_BODY_SCALARS) & F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")))
    rows = reader.text(path).filter(F.trim(line) != "").withColumn("r", F.from_json(line, known, parse))
    extra = F.when(unknown | nested, F.nullif(F.to_json(fields), F.lit("{}")))
    return rows.select(*[extra.alias(c) if c == "extra" else F.col(f"r.{c}").alias(c) for c in RAW_REQUEST.fieldNames()])


def write_raw(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write raw requests as JSON lines (the format ``read_raw`` reads); the fields of ``extra``
    become fields of the line."""
    if "extra" not in df.columns:
        df.write.mode(mode).option("timestampNTZFormat", TS_FORMAT).json(path)
        return
    line = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != "extra"]), {"timestampNTZFormat": TS_FORMAT})
    both = F.concat(F.substring(line, F.lit(1), F.length(line) - 1), F.lit(","), F.substring("extra", 2, 1 << 30))
    df.select(F.when(F.coalesce(F.col("extra") != "{}", F.lit(False)), both).otherwise(line).alias("value")).write.mode(mode).text(path)


def append_events(events: DataFrame, path: str) -> int:
    """Append a batch of accepted events; returns the number of rows written.

    One write job: the commit protocol makes the batch all-or-nothing. Rows are
    range-partitioned on (event_date, app_id, timestamp), so a busy day or a hot
    app is split over many tasks while each file still holds one day and a narrow
    tenant range; inside a file rows are sorted for row-group pruning.
    """
    obs = Observation("append_events")
    # Observed above the range exchange, so the sampling pass is not counted.
    df = cluster_events(events).observe(obs, F.count(F.lit(1)).alias("rows"))
    df.write.mode("append").partitionBy("event_date").parquet(path)
    return int(obs.get["rows"])


def cluster_events(df: DataFrame) -> DataFrame:
    """Layout of event files: range partitions over (day, tenant, time), sorted inside."""
    return (df.repartitionByRange("event_date", "app_id", "timestamp")
              .sortWithinPartitions("event_date", "app_id", "event_name", "timestamp"))


def write_rollup(rollup: DataFrame, path: str) -> None:
    """Replace exactly the ``date`` partitions present in ``rollup`` (dynamic overwrite)."""
    (rollup.repartitionByRange("date", "app_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("date").parquet(path))


def write_log(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Append to a log table partitioned by day."""
    df.withColumn("log_date", F.to_date(ts)).write.mode("append").partitionBy("log_date").parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a dimension snapshot to a new folder (never overwrite the folder being read)."""
    df.write.mode("errorifexists").parquet(path)
