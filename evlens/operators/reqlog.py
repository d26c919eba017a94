"""Request-log reports Q24-Q26 and Q29.

The reference keeps these as in-process counters; here they are aggregations
over a request-log table (received_at, endpoint, status, duration_ms), so they
cover any time span and any number of servers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOW_MS = 1000


def endpoint_key(method_col, path_col):
    """The ``METHOD path`` endpoint key."""
    return F.concat_ws(" ", method_col, path_col)


def request_metrics(log: DataFrame, slow_ms: float = SLOW_MS) -> DataFrame:
    """Q24: one row: total, success (<400), errors, success rate %, mean ms, slow requests.

    An empty log gives total 0, success rate 100 and mean 0.
    """
    agg = log.agg(F.count(F.lit(1)).alias("total_requests"),
                  F.count_if(F.col("status") < 400).alias("successful_requests"),
                  F.count_if(F.col("status") >= 400).alias("failed_requests"),
                  F.sum("duration_ms").alias("_total_ms"),
                  F.count_if(F.col("duration_ms") > slow_ms).alias("slow_requests"))
    total = F.col("total_requests")
    return agg.select(
        "total_requests", "successful_requests", "failed_requests",
        F.when(total > 0, F.round(F.col("successful_requests") / total * 100, 2))
         .otherwise(F.lit(100.0)).alias("success_rate"),
        F.when(total > 0, F.round(F.col("_total_ms") / total, 2)).otherwise(F.lit(0.0)).alias("avg_response_ms"),
        "slow_requests")


def _per_endpoint(log: DataFrame) -> DataFrame:
    return (log.groupBy("endpoint")
               .agg(F.count(F.lit(1)).alias("count"),
                    F.sum("duration_ms").alias("_total_ms"),
                    F.count_if(F.col("status") >= 400).alias("errors")))


def top_endpoints(log: DataFrame, n: int = 10) -> DataFrame:
    """Q25: the ``n`` busiest endpoints with mean time, errors and error rate %."""
    e = _per_endpoint(log)
    return (e.select("endpoint", "count",
                     F.round(F.col("_total_ms") / F.col("count"), 2).alias("avg_time_ms"),
                     "errors",
                     F.round(F.col("errors") / F.col("count") * 100, 2).alias("error_rate"))
             .orderBy(F.desc("count"), F.asc("endpoint")).limit(n))


def slowest_endpoints(log: DataFrame, n: int = 10) -> DataFrame:
    """Q26: the ``n`` endpoints with the highest mean time."""
    e = _per_endpoint(log).withColumn("_avg", F.col("_total_ms") / F.col("count"))
    return (e.orderBy(F.desc("_avg"), F.asc("endpoint")).limit(n)
             .select("endpoint", F.round("_avg", 2).alias("avg_time_ms"), "count"))


def slow_queries(log: DataFrame, threshold_ms: float = SLOW_MS, duration_col: str = "duration_ms") -> DataFrame:
    """Q29: log entries slower than the threshold (with their row counts, when the log has them)."""
    return log.filter(F.col(duration_col) > F.lit(threshold_ms))
