"""Security-log reports Q20-Q23 over the ``security_events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import typed_lit

# Severities counted as "high" by the open-issues report.
HIGH_SEVERITIES = ("high", "critical")


def _newer_than(sec: DataFrame, as_of, interval: str):
    return F.col("created_at") > typed_lit(sec, "created_at", as_of) - F.expr(f"INTERVAL {interval}")


def security_recent(sec: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Q20: events newer than ``as_of - hours``, newest first."""
    return (sec.filter(_newer_than(sec, as_of, f"{int(hours)} HOURS"))
               .orderBy(F.desc("created_at"), F.desc("id")))


def security_open_high(sec: DataFrame) -> DataFrame:
    """Q21: unresolved events of severity high or critical, newest first."""
    return (sec.filter(F.col("severity").isin(*HIGH_SEVERITIES) & (F.col("resolved") == F.lit(False)))
               .orderBy(F.desc("created_at"), F.desc("id")))


def failed_key_ips(sec: DataFrame, as_of, window: str = "1 HOUR", min_attempts: int = 10) -> DataFrame:
    """Q22: per IP the invalid-key attempts inside the window, kept when more than ``min_attempts``."""
    return (sec.filter((F.col("event_type") == F.lit("api_key_invalid")) & _newer_than(sec, as_of, window))
               .groupBy("ip_address").agg(F.count(F.lit(1)).alias("attempts"))
               .filter(F.col("attempts") > F.lit(min_attempts))
               .orderBy(F.desc("attempts"), F.asc("ip_address")))


def security_critical(sec: DataFrame) -> DataFrame:
    """Q23: critical events, newest first."""
    return sec.filter(F.col("severity") == F.lit("critical")).orderBy(F.desc("created_at"), F.desc("id"))
