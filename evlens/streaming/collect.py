"""Streaming event collection with the same admission code as the batch job.

``readStream`` of raw JSON request lines -> ``foreachBatch``:
  1. admission of the micro-batch, seeded with the counters left open by the
     previous batch (state folder per batch id), so the counters are exact
     across batch boundaries;
  2. accepted events appended under partitions (event_date, ingest_batch) with
     dynamic overwrite: replaying a batch id rewrites only its own partitions;
  3. quarantine and security events likewise, keyed by ingest_batch;
  4. T2: the rollup dates touched by the batch are recomputed from the stored
     events and overwritten (exact distinct counts; a streaming aggregate cannot
     keep exact distincts); with ``first_seen`` the batch is compared with the
     first-seen table instead and adds its deltas (``upkeep.add_to_rollup``), so no
     stored event is read again; ``upkeep.rollup_of_deltas`` is then the rollup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import limits as L
from ..operators import upkeep as M
from ..session import keep, persist_scope
from ..sources import tables as TB


def _state_path(out_dir: str, name: str, batch_id: int) -> str:
    return f"{out_dir.rstrip('/')}/_state/{name}/batch_id={batch_id}"


def _read_state(spark: SparkSession, out_dir: str, batch_id: int) -> dict:
    seeds = {}
    if batch_id == 0:
        return seeds
    for name in ("key_hour", "collect"):
        # Every batch writes both frames, empty ones too: a missing folder is an error.
        seeds[name] = spark.read.parquet(_state_path(out_dir, name, batch_id - 1))
    return seeds


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, keys: DataFrame, apps: DataFrame,
                  out_dir: str, as_of=None, months=None, key_hour_ttl: int = L.KEY_HOUR_TTL,
                  collect_limit: int = L.COLLECT_LIMIT, collect_ttl: int = L.COLLECT_TTL,
                  first_seen: bool = False) -> dict:
    """Admit one micro-batch and write every output of it; safe to re-run for the same id."""
    with persist_scope():
        return _process(spark, batch, batch_id, keys, apps, out_dir.rstrip("/"), as_of, months, key_hour_ttl,
                        collect_limit, collect_ttl, first_seen)


def _process(spark, batch, batch_id, keys, apps, out, as_of, months, key_hour_ttl, collect_limit, collect_ttl, first_seen):
    seeds, counters = _read_state(spark, out, batch_id), {}
    adm = I.admission(batch, keys, apps, as_of=as_of, months=months, key_hour_ttl=key_hour_ttl,
                      collect_limit=collect_limit, collect_ttl=collect_ttl, seeds=seeds, counters=counters)
    adm = keep(adm.withColumn("ingest_batch", F.lit(batch_id)))
    events = I.accepted_events(adm).withColumn("ingest_batch", F.lit(batch_id))
    (TB.cluster_events(events)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("event_date", "ingest_batch").parquet(f"{out}/events"))
    (I.quarantine(adm).withColumn("ingest_batch", F.lit(batch_id))
      .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
      .partitionBy("ingest_batch").parquet(f"{out}/quarantine"))
    (I.security_events(adm).withColumn("ingest_batch", F.lit(batch_id))
      .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
      .partitionBy("ingest_batch").parquet(f"{out}/security_events"))
    last_seen = adm.agg(F.max("received_at")).first()[0]  # one scalar a batch
    state = I.counter_state(counters, seeds, last_seen, key_hour_ttl, collect_ttl)
    for name, frame in state.items():
        frame.write.mode("overwrite").parquet(_state_path(out, name, batch_id))
    # Exact refresh of the touched rollup dates, or the batch's own part.
    stored = spark.read.parquet(f"{out}/events")
    mine = stored.filter(F.col("ingest_batch") == batch_id)
    dates = M.touched_dates(mine)
    if first_seen:
        M.add_to_rollup(mine, out, batch_id)
    elif dates:
        TB.write_rollup(M.refresh_rollup(stored, dates), f"{out}/daily_summary")
    return {"batch_id": batch_id, "dates": [str(d) for d in dates]}


def start_collect_stream(spark: SparkSession, raw_dir: str, keys: DataFrame, apps: DataFrame, out_dir: str,
                         checkpoint: str, as_of=None, months=None, available_now: bool = True,
                         max_files_per_trigger: int | None = None, **limits):
    """Start the streaming collection (``availableNow`` drains what is there, then stops)."""
    opts = {"maxFilesPerTrigger": max_files_per_trigger} if max_files_per_trigger else {}
    stream = TB.read_raw(spark, raw_dir, streaming=True, **opts)

    def run(batch: DataFrame, batch_id: int):
        process_batch(spark, batch, batch_id, keys, apps, out_dir, as_of, months, **limits)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
