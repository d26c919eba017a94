"""Streaming admission over several micro-batches equals the batch admission."""

import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL
from evlens.operators import ingest as I
from evlens.session import ensure_checkpoint_dir
from evlens.sources import tables as TB
from evlens.sources.fixtures import AS_OF, Fixture
from evlens.streaming import collect as SC


# A lifetime of the key counters at which the small fixture's keys reach their limits.
KEY_TTL = 31 * 86400


def test_stream_equals_batch(spark):
    fx = Fixture(spark, SF_SMALL)
    base = f"{ensure_checkpoint_dir(spark)}/test-stream-{uuid.uuid4().hex}"
    raw = fx.raw_requests
    cuts = ["2024-01-08", "2024-01-16", "2024-01-24"]
    bounds = [None] + cuts + [None]
    for i in range(4):
        part = raw
        if bounds[i]:
            part = part.filter(F.col("received_at") >= F.lit(bounds[i]).cast("timestamp_ntz"))
        if bounds[i + 1]:
            part = part.filter(F.col("received_at") < F.lit(bounds[i + 1]).cast("timestamp_ntz"))
        TB.write_raw(part.coalesce(1), f"{base}/raw/p{i}")
    q = SC.start_collect_stream(spark, f"{base}/raw/*", fx.api_keys, fx.apps, f"{base}/out", f"{base}/ckpt",
                                as_of=AS_OF, max_files_per_trigger=1, key_hour_ttl=KEY_TTL)
    q.awaitTermination()
    batch = I.admission(raw, fx.api_keys, fx.apps, as_of=AS_OF, key_hour_ttl=KEY_TTL)
    exp = {r[0]: r[1] for r in batch.groupBy(F.coalesce("reject_reason", F.lit("ok"))).count().collect()}
    got = {r[0]: r[1] for r in spark.read.parquet(f"{base}/out/quarantine").groupBy("reject_reason").count().collect()}
    got["ok"] = spark.read.parquet(f"{base}/out/events").count()
    assert got == exp
    assert "api_key_rate_limit" in exp
    # the streamed rollup equals a rollup of the stored events
    from evlens.operators import reports as R
    stored = spark.read.parquet(f"{base}/out/events")
    a = sorted(tuple(r) for r in R.daily_summary(stored).collect())
    b = sorted(tuple(r) for r in spark.read.parquet(f"{base}/out/daily_summary").select(*R.ROLLUP_COLUMNS).collect())
    assert a == b


def test_batch_job_equals_admission(spark):
    from evlens import jobs
    fx = Fixture(spark, SF_SMALL)
    base = f"{ensure_checkpoint_dir(spark)}/test-batchjob-{uuid.uuid4().hex}"
    TB.write_raw(fx.raw_requests, f"{base}/raw")
    keys = fx.api_keys.select(*TB.API_KEYS.fieldNames())
    apps = fx.apps.withColumn("updated_at", F.lit(None).cast("timestamp_ntz")).select(*TB.APPS.fieldNames())
    keys.write.parquet(f"{base}/keys")
    apps.write.parquet(f"{base}/apps")
    jobs.run_admission_batch(spark, f"{base}/raw", f"{base}/keys", f"{base}/apps", f"{base}/out", 0,
                             as_of=AS_OF, key_hour_ttl=7 * 86400)
    batch = I.admission(fx.raw_requests, keys, apps, as_of=AS_OF, key_hour_ttl=7 * 86400)
    exp = {r[0]: r[1] for r in batch.groupBy(F.coalesce("reject_reason", F.lit("ok"))).count().collect()}
    got = {r[0]: r[1] for r in spark.read.parquet(f"{base}/out/quarantine").groupBy("reject_reason").count().collect()}
    got["ok"] = spark.read.parquet(f"{base}/out/events").count()
    assert got == exp


def test_streaming_counter_over_many_arrow_batches(spark, tmp_path):
    """More rows of one key than an Arrow batch holds, in no order, and late rows in a second batch."""
    import datetime as dt
    import random

    from evlens.operators import limits as L
    from evlens.streaming import live as SL
    rnd, start = random.Random(3), dt.datetime(2024, 1, 1)
    first = [("k", start + dt.timedelta(milliseconds=1400 * k)) for k in range(25_000)]
    second = [("k", start + dt.timedelta(milliseconds=1400 * k)) for k in range(25_000, 26_000)]
    rnd.shuffle(first)
    rnd.shuffle(second)
    schema = "api_key string, received_at timestamp"
    late = ("k", start + dt.timedelta(milliseconds=1400 * 24_999 - 60_000))  # within the watermark
    for rows in (first, [*second, late]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = (SL.streaming_key_counter(src, ttl_seconds=3600, limit=100).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start(f"{tmp_path}/out"))
        q.awaitTermination()
    got = {r["received_at"]: (r["window_start"], r["window_count"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = spark.createDataFrame(first, schema)
    want = {r["received_at"]: (r["window_start"], r["window_count"])
            for r in L.anchored_counter(batch, ["api_key"], "received_at", 3600, 100).collect()}
    assert {t: got[t] for t in want} == want
    assert len(got) == 26_001 and got[late[1]][1] > 100  # the late row counts in the window that is open


def test_plan_of_a_seeded_batch_stays_small(spark, monkeypatch):
    """The third batch, with counters carried in: Spark writes the text of every plan it caches."""
    fx = Fixture(spark, SF_SMALL)
    base = f"{ensure_checkpoint_dir(spark)}/test-plan-{uuid.uuid4().hex}"
    plans = []
    admission = I.admission

    def watched(*args, **kw):
        out = admission(*args, **kw)
        plans.append((sorted(kw["seeds"]), len(out._jdf.queryExecution().toString()), out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(I, "admission", watched)
    TB.write_raw(fx.raw_requests, f"{base}/raw")
    fx.api_keys.write.parquet(f"{base}/keys")
    fx.apps.write.parquet(f"{base}/apps")
    raw, keys, apps = TB.read_raw(spark, f"{base}/raw"), spark.read.parquet(f"{base}/keys"), spark.read.parquet(f"{base}/apps")
    for batch in range(3):
        third = raw.filter(F.pmod(F.dayofmonth("received_at"), F.lit(3)) == batch)
        SC.process_batch(spark, third, batch, keys, apps, f"{base}/out", as_of=AS_OF, key_hour_ttl=KEY_TTL)
    assert [p[0] for p in plans] == [[], ["collect", "key_hour"], ["collect", "key_hour"]]
    assert all(size < 200_000 for _, size, _ in plans), [p[1] for p in plans]
    assert not any("Python" in plan or "Arrow" in plan or "Pandas" in plan for _, _, plan in plans)


def test_scope_removes_what_it_stored(spark):
    import os

    from evlens.session import persist_scope, stored
    with persist_scope() as held:
        df = stored(spark.range(5), "scope-test")
        assert df.count() == 5 and os.path.isdir(held[0].removeprefix("file:"))
    assert not os.path.exists(held[0].removeprefix("file:"))


def test_missing_counter_state_is_an_error(spark, tmp_path):
    import pytest
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        SC._read_state(spark, str(tmp_path), 3)


def test_live_users_within_the_sketch_bound(spark, tmp_path):
    """T3's approximate users against exact distincts: three standard errors (5 % each), one at least."""
    from evlens.streaming import live as SL
    Fixture(spark, SF_SMALL).analytics_events.write.parquet(f"{tmp_path}/in")
    stored = spark.read.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(stored.schema).parquet(f"{tmp_path}/in")
    q = (SL.live_event_counts(src, window="7 days").writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start(f"{tmp_path}/out"))
    q.awaitTermination()
    exact = {(r["w"]["start"], r["event_name"]): r["users"] for r in stored.groupBy(
        F.window(F.col("timestamp").cast("timestamp"), "7 days").alias("w"), "event_name").agg(
        F.count_distinct("user_id").alias("users")).collect()}
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert got and max(r["approx_users"] for r in got) > 10
    for r in got:
        users = exact[r["window_start"], r["event_name"]]
        assert abs(r["approx_users"] - users) <= max(1, 0.15 * users), r


def test_streaming_counter_folds_many_keys_a_group(spark, tmp_path):
    """Keys share groups (one call a group, not a key); counters carried over three batches, rows
    without a time among them, equal the batch counter's."""
    import datetime as dt
    import random

    from evlens.operators import limits as L
    from evlens.streaming import live as SL
    rnd, start, schema = random.Random(5), dt.datetime(2024, 1, 1), "api_key string, received_at timestamp"
    rows = sorted(((f"k{rnd.randrange(40)}", start + dt.timedelta(seconds=rnd.randrange(30_000))) for _ in range(1500)), key=lambda r: r[1])
    for k in range(3):
        part = rows[k * 500:k * 500 + 500] + [("k1", None)] * (k == 1)
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = (SL.streaming_key_counter(src, ttl_seconds=3600, limit=3, key_groups=3).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start(f"{tmp_path}/out"))
        q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.filter("received_at IS NULL").count() <= 1
    got = sorted(map(tuple, out.filter("received_at IS NOT NULL AND key <> 'k1'").collect()))
    want = L.anchored_counter(spark.createDataFrame(rows, schema).filter("api_key <> 'k1'"), ["api_key"], "received_at", 3600, 3)
    assert got == sorted(map(tuple, want.select("api_key", "received_at", "window_start", "window_count", "limit_exceeded").collect()))
    assert len(got) > 1400
