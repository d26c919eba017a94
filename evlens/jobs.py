"""Batch job entry points: the same per-batch code the stream runs.

``run_admission_batch`` admits one folder of raw JSON request lines and writes
events, quarantine, security events, counter state and the touched rollup days
(re-running the same ``batch_id`` rewrites only that batch's output).
``run_upkeep`` is the maintenance job (M15).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .operators import upkeep as M
from .sources import tables as TB
from .streaming.collect import process_batch


def run_admission_batch(spark: SparkSession, raw_path: str, keys_path: str, apps_path: str, out_dir: str,
                        batch_id: int, as_of=None, **limits) -> dict:
    """Admit the JSON request lines under ``raw_path`` as batch ``batch_id`` (counters seeded
    from batch ``batch_id - 1``'s state, exactly as in the stream)."""
    raw = TB.read_raw(spark, raw_path)
    keys = TB.read_dim(spark, keys_path, "api_keys")
    apps = TB.read_dim(spark, apps_path, "apps")
    return process_batch(spark, raw, batch_id, keys, apps, out_dir, as_of=as_of, **limits)


def run_upkeep(spark: SparkSession, events_path: str, rollup_path: str, as_of, months_to_keep: int = 12,
               drop: bool = False) -> dict:
    """Provisioning frame, retention (dry run unless ``drop``), rollup refresh, stats."""
    return M.upkeep(spark, events_path, rollup_path, as_of, months_to_keep, drop)
