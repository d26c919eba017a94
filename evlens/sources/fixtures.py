"""Fixture views: the test tables reshaped into the schemas the operators expect.

Each view is one SQL text rendered for two engines: Spark (tables read straight
from parquet files) and DuckDB (the oracle, where the raw tables are
pre-registered views). The derivation only produces rows of the right shape; all
of the operators' work runs on top of these frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")

# The reference clock of every fixture query.
AS_OF = "2024-01-31 00:00:00"

_K = "(SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e"

# Tenants, keys, pages and addresses grow with their tables; ten busy tenants and forty
# busy keys take a fixed share of the traffic, so that limits are reached at every scale.
_APP = """CASE WHEN event_id % 3 = 0 THEN CAST(floor(event_id / 3) AS BIGINT) % 10
            ELSE event_id % (SELECT count(*) FROM {supplier}) END"""
_KEY = """CASE WHEN event_id % 5 = 0 THEN CAST(floor(event_id / 5) AS BIGINT) % 40
            ELSE event_id % CAST(floor((SELECT count(*) FROM {part}) * 1.25) AS BIGINT) END"""
_IP = "concat('10.', CAST(user_id % 4 AS STRING), '.', CAST(CAST(floor(user_id / 250) AS BIGINT) % 250 AS STRING), '.', CAST(user_id % 250 AS STRING))"

VIEWS: dict[str, str] = {
    "analytics_events": """
SELECT event_id AS id, """ + _APP + """ AS app_id, event_type AS event_name,
       concat('https://site', CAST(""" + _APP + """ AS STRING), '.example.com/p/', CAST(k AS STRING)) AS url,
       CASE WHEN k % 2 = 0 THEN 'https://ref.example.org/' END AS referrer,
       CASE k % 5 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' WHEN 2 THEN 'tablet' WHEN 3 THEN 'tv' END AS device,
       """ + _IP + """ AS ip_address,
       CASE WHEN k % 10 <> 9 THEN CAST(user_id AS STRING) END AS user_id,
       CASE WHEN k % 7 <> 6 THEN concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) END AS session_id,
       ts AS timestamp, props AS metadata,
       CASE k % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' ELSE 'Safari' END AS browser,
       CASE k % 4 WHEN 0 THEN 'Android' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Windows' ELSE 'macOS' END AS os,
       CASE WHEN k % 2 = 0 THEN '1080x1920' END AS screen_size,
       CASE k % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'ES' WHEN 4 THEN 'IN' END AS country,
       CAST(NULL AS STRING) AS city, ts AS created_at
FROM """ + _K,
    "users": """
SELECT n_nationkey AS id, concat('g-', CAST(n_nationkey AS STRING)) AS google_id,
       concat(lower(n_name), '@example.com') AS email, n_name AS name,
       CASE n_nationkey % 5 WHEN 0 THEN 'guest' WHEN 1 THEN 'admin' WHEN 2 THEN 'super_admin' WHEN 3 THEN 'user' END AS role,
       n_nationkey % 7 <> 3 AS is_active, o_orderdate AS created_at
FROM {nation} LEFT JOIN {orders} ON o_orderkey = n_nationkey""",
    "apps": """
SELECT s_suppkey AS id, s_nationkey AS user_id, s_name AS app_name,
       concat('https://site', CAST(s_suppkey AS STRING), '.example.com') AS app_url,
       CAST(NULL AS STRING) AS description,
       CASE WHEN s_suppkey % 9 <> 8 THEN o_orderdate END AS created_at
FROM {supplier} LEFT JOIN {orders} ON o_orderkey = s_suppkey""",
    "api_keys": """
SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM {supplier}) AS app_id,
       {sha_open}concat('key-', CAST(p_partkey AS STRING)){sha_close} AS key_hash,
       substring(concat('key-', CAST(p_partkey AS STRING)), 1, 8) AS key_prefix,
       p_name AS name, p_partkey % 3 <> 0 AS is_active,
       p_partkey % 11 <> 5 AS can_write,
       CASE WHEN p_partkey % 6 = 1 THEN '10.0.0.1' WHEN p_partkey % 6 = 2 THEN '*' END AS allowed_ip,
       CASE WHEN p_partkey % 4 <> 0 THEN CAST(3 AS INT) END AS rate_limit_per_hour,
       CASE p_partkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN (SELECT max(ts) FROM {events}) END AS expires_at,
       o_orderdate AS created_at
FROM {part} LEFT JOIN {orders} ON o_orderkey = p_partkey""",
    "security_events": """
SELECT event_id AS id,
       CASE k % 4 WHEN 0 THEN 'api_key_missing' WHEN 1 THEN 'api_key_invalid' WHEN 2 THEN 'api_key_ip_blocked' ELSE 'api_key_rate_limit' END AS event_type,
       CASE k % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'low' END AS severity,
       """ + _IP + """ AS ip_address,
       user_id % 30 AS user_id, k % 2 = 0 AS resolved, ts AS created_at
FROM """ + _K,
    "request_log": """
SELECT ts AS received_at, concat('GET /', event_type) AS endpoint,
       CASE WHEN event_type = 'error' THEN 500 WHEN user_id % 10 = 0 THEN 404 ELSE 200 END AS status,
       value * 10 AS duration_ms
FROM {events}""",
    "raw_requests": """
SELECT ts AS received_at,
       CASE WHEN k = 98 THEN '' WHEN k <> 99 THEN concat('key-', CAST(""" + _KEY + """ AS STRING)) END AS api_key,
       CASE WHEN k % 4 = 1 THEN '10.0.0.1' ELSE """ + _IP + """ END AS client_ip,
       CASE k % 4 WHEN 0 THEN 'Mozilla/5.0 (iPhone) Safari/604.1' WHEN 1 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0' WHEN 2 THEN 'curl/8.0' END AS user_agent,
       CASE k WHEN 1 THEN 'delete-item' WHEN 2 THEN 'bad name!' WHEN 3 THEN '' WHEN 4 THEN 'wasp_click' ELSE event_type END AS event,
       CASE WHEN event_id % 5000 = 17 THEN repeat('x', 1100000) ELSE p.url END AS url, CAST(user_id AS STRING) AS userId,
       CASE k WHEN 5 THEN 'invalid-date' WHEN 6 THEN NULL WHEN 10 THEN '2019-05-05' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS timestamp_text,
       CASE k WHEN 7 THEN '[1]' WHEN 8 THEN '{{"country": "USA"}}' WHEN 9 THEN '{{"screenSize": "12345678901234567890123456789012345678901234567890x"}}'
              WHEN 11 THEN '{{"a":' WHEN 12 THEN '{{"note": {{"q": "drop table x"}}}}' ELSE props END AS metadata,
       CASE k WHEN 13 THEN '{{"campaign":"drop table users"}}' WHEN 14 THEN '{{"utm":{{"tags":["spring",{{"note":"1; 2"}}]}}}}'
              WHEN 15 THEN '{{"select":1,"delete":[true,null,"plain"]}}' WHEN 16 THEN '{{"x":"<b>dr<op"}}' WHEN 18 THEN '{{"update":{{"or":"a","b":"c = d"}}}}' END AS extra
FROM (SELECT *, event_id % (SELECT count(*) FROM {pages}) AS page_no,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
JOIN {pages} p ON p.page_id = e.page_no""",
}


def _render(name: str, table_ref, sha_open: str, sha_close: str) -> str:
    subs = {t: table_ref(t) for t in RAW_TABLES}
    return VIEWS[name].format(sha_open=sha_open, sha_close=sha_close, **subs).strip()


def spark_view_sql(name: str, sf_dir: str) -> str:
    return _render(name, lambda t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`", "sha2(", ", 256)")


def duckdb_view_sql(name: str) -> str:
    return _render(name, lambda t: t, "sha256(", ")")


def oracle_with(sql: str, *views: str, more: str = "", recursive: bool = False) -> str:
    """Prefix an oracle query with the fixture views it reads, inlined as CTEs.

    ``more`` holds further CTE definitions (``name AS (...)``) placed after the views;
    ``recursive`` marks the list WITH RECURSIVE (for step-by-step replays).
    """
    parts = [f"{v} AS (\n{duckdb_view_sql(v)}\n)" for v in views]
    if more.strip():
        parts.append(more.strip())
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {',\n'.join(parts)}\n{sql.strip()}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a Spark DataFrame (``api_keys`` gets its nested columns back)."""
    df = spark.sql(spark_view_sql(name, sf_dir))
    if name == "api_keys":
        from pyspark.sql import functions as F
        df = (df.withColumn("permissions", F.struct(F.lit(True).alias("read"), F.col("can_write").alias("write")))
                .withColumn("allowed_ips", F.when(F.col("allowed_ip").isNotNull(), F.array("allowed_ip")))
                .withColumn("last_used_at", F.lit(None).cast("timestamp_ntz"))
                .withColumn("revoked_at", F.lit(None).cast("timestamp_ntz")))
    return df


class Fixture:
    """Lazily built fixture views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        # The library computes in UTC (arrival/event times are UTC wall clocks).
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{table}.parquet")
