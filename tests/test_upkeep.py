"""Upkeep operators: rollup refresh / vanished dates, retention, the upkeep job, API shapes."""

import datetime as dt
import os

from pyspark.sql import functions as F

from evlens.operators import reports as R
from evlens.operators import tenants as T
from evlens.operators import upkeep as M
from evlens.sources import tables as TB


def events(spark, days):
    rows = [(str(i), 1, "click", dt.datetime(2024, 1, d, 10), "u", "s", "mobile", "US", "x")
            for i, d in enumerate(days)]
    return (spark.createDataFrame(rows, "id string, app_id long, event_name string, timestamp timestamp_ntz, "
                                        "user_id string, session_id string, device string, country string, url string")
                 .withColumn("event_date", F.to_date("timestamp")))


def test_refresh_touched_dates_equals_full(spark, tmp_path):
    ev_path, roll = str(tmp_path / "ev"), str(tmp_path / "roll")
    TB.append_events(events(spark, [1, 2, 3]), ev_path)
    TB.write_rollup(M.refresh_rollup(spark.read.parquet(ev_path)), roll)
    batch = events(spark, [3, 4])
    TB.append_events(batch, ev_path)
    TB.write_rollup(M.refresh_rollup(spark.read.parquet(ev_path), M.touched_dates(batch)), roll)
    full = sorted(tuple(r) for r in R.daily_summary(spark.read.parquet(ev_path)).collect())
    inc = sorted(tuple(r) for r in spark.read.parquet(roll).select(*R.ROLLUP_COLUMNS).collect())
    assert full == inc
    TB.write_rollup(M.refresh_rollup(spark.read.parquet(ev_path), M.touched_dates(batch)), roll)  # twice = same
    assert sorted(tuple(r) for r in spark.read.parquet(roll).select(*R.ROLLUP_COLUMNS).collect()) == full


def test_retention_and_vanished_dates(spark, tmp_path):
    ev_path, roll = str(tmp_path / "ev"), str(tmp_path / "roll")
    TB.append_events(events(spark, [1, 2]), ev_path)
    TB.write_rollup(M.refresh_rollup(spark.read.parquet(ev_path)), roll)
    expired = [r[0] for r in M.expired_dates(spark.read.parquet(ev_path), "2024-03-10", 1).collect()]
    assert expired == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert M.drop_partitions(spark, ev_path, "event_date", ["2024-01-01"], dry_run=True)
    assert os.path.exists(f"{ev_path}/event_date=2024-01-01")
    M.drop_partitions(spark, ev_path, "event_date", ["2024-01-01"], dry_run=False)
    assert not os.path.exists(f"{ev_path}/event_date=2024-01-01")
    gone = [r[0] for r in M.vanished_dates(spark.read.parquet(roll), spark.read.parquet(ev_path)).collect()]
    assert gone == [dt.date(2024, 1, 1)]


def test_upkeep_job_reports(spark, tmp_path):
    ev_path, roll = str(tmp_path / "ev"), str(tmp_path / "roll")
    TB.append_events(events(spark, [1, 2]), ev_path)
    rep = M.upkeep(spark, ev_path, roll, "2024-01-31 00:00:00")
    assert rep["failed"] == [] and "refresh" in rep["success"] and rep["partitions"] == 2
    assert "2024-01" in rep["months"]


def test_api_shapes(spark):
    ev = events(spark, [1, 2, 3]).withColumn("ip_address", F.lit("1.2.3.4")).withColumn("browser", F.lit("B")) \
        .withColumn("os", F.lit("O")).withColumn("id", F.col("id").cast("long"))
    q1b = R.event_summary_api(R.event_summary(ev)).first()
    assert q1b["event"] == "click" and q1b["deviceData"]["mobile"] == 3
    q2b = R.user_stats_api(ev, n=2).first()
    assert q2b["totalEvents"] == 3 and len(q2b["recentEvents"]) == 2
    assert q2b["recentEvents"][0]["timestamp"] == dt.datetime(2024, 1, 3, 10)
    apps = spark.createDataFrame([(1, 7, "a", dt.datetime(2024, 1, 1))],
                                 "id long, user_id long, app_name string, created_at timestamp_ntz")
    keys = spark.createDataFrame([(5, 1, "p", "n", True, None, None, dt.datetime(2024, 1, 2), {"read": True, "write": True}, 10)],
                                 "id long, app_id long, key_prefix string, name string, is_active boolean, "
                                 "expires_at timestamp_ntz, last_used_at timestamp_ntz, created_at timestamp_ntz, "
                                 "permissions struct<read:boolean,write:boolean>, rate_limit_per_hour int")
    nested = T.apps_with_keys(apps, keys, ev, "2024-01-31 00:00:00", 7, nested=True).first()
    assert [k["id"] for k in nested["apiKeys"]] == [5]
    users = spark.createDataFrame([(7, "user")], "id long, role string")
    dash = T.dashboard(users, apps, keys, ev, "2024-01-31 00:00:00", user_id=7, nested=True).first()
    assert dash["total_apps"] == 1 and [a["app_id"] for a in dash["apps"]] == [1]


def test_register_trims_and_refuses_blank_names(spark):
    apps = spark.createDataFrame([], "id long, user_id long, app_name string, app_url string, description string, "
                                     "created_at timestamp_ntz, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, 7, "  Shop  ", " https://x ", None), (2, 7, "   ", None, None), (3, 7, None, None, None)],
                                "id long, user_id long, app_name string, app_url string, description string")
    out = M.insert_apps(apps, new, "2024-01-31 00:00:00").collect()
    assert [(r["id"], r["app_name"], r["app_url"]) for r in out] == [(1, "Shop", "https://x")]


def test_corrupt_json_line_is_malformed(spark, tmp_path):
    from evlens.operators import ingest as I
    p = tmp_path / "raw"
    p.mkdir()
    (p / "a.json").write_text('{"received_at": "2024-01-15T12:00:00.000000", "api_key": "k", "event": "click"}\n{oops\n')
    raw = TB.read_raw(spark, str(p))
    keys = spark.createDataFrame([], "id long, app_id long, key_hash string, is_active boolean, expires_at timestamp_ntz, "
                                     "allowed_ips array<string>, permissions struct<read:boolean,write:boolean>, "
                                     "rate_limit_per_hour int")
    apps = spark.createDataFrame([], "id long")
    got = sorted(r["reject_reason"] for r in I.admission(raw, keys, apps).collect())
    assert got == ["api_key_invalid", "malformed_body"]


def test_live_counts_have_sketch_users(spark, tmp_path):
    from evlens.streaming import live as SL
    path = str(tmp_path / "ev")
    TB.append_events(events(spark, [1, 1, 2, 3]), path)
    src = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    q = (SL.live_event_counts(src).writeStream.format("memory").queryName("live_t3").outputMode("append")
         .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start())
    q.awaitTermination()
    rows = spark.sql("SELECT * FROM live_t3").collect()
    assert rows and all(1 <= r["approx_users"] <= r["count"] for r in rows)


def test_upkeep_drops_rollup_days_without_events(spark, tmp_path):
    ev_path, roll = str(tmp_path / "e"), str(tmp_path / "r")
    rows = [(f"{k}", 1, "click", dt.datetime(2023 + k % 2, 1, 5), "u", "mobile", "s", "US") for k in range(6)]
    df = spark.createDataFrame(rows, "id string, app_id long, event_name string, timestamp timestamp_ntz, user_id string, "
                                     "device string, session_id string, country string")
    TB.append_events(df.withColumn("event_date", F.to_date("timestamp")), ev_path)
    TB.write_rollup(M.refresh_rollup(spark.read.parquet(ev_path)), roll)
    rep = M.upkeep(spark, ev_path, roll, "2024-03-31 00:00:00", drop=True)
    assert not rep["failed"], rep
    assert [str(r[0]) for r in spark.read.parquet(roll).select("date").distinct().collect()] == ["2024-01-05"]


def test_latest_change_is_settled_by_content(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("b", 2, "z")]
    got = {tuple(M._latest(spark.createDataFrame(rows, "k string, o int, v string").repartition(n), "k", "o")
                 .filter("k = 'a'").first()) for n in (1, 2, 5)}
    assert len(got) == 1


EVENTS = ("id long, app_id long, event_name string, session_id string, user_id string, device string, country string, "
          "timestamp timestamp_ntz, url string")


def some_events(spark, n=240):
    rows = [(k, k % 7, "click" if k % 3 else None, f"s{k % 11}", f"u{k % 13}" if k % 5 else None, "mobile" if k % 2 else None,
             "DE", dt.datetime(2024, 1, 1 + k % 9, k % 24, 5), "https://x/") for k in range(n)]
    return spark.createDataFrame(rows, EVENTS)


def test_rollup_from_batches_equals_the_whole(spark, tmp_path):
    """Late events, null values, a replayed batch and an empty one."""
    from evlens.operators import reports as R
    ev = some_events(spark)
    for batch, cond in ((0, "id < 100 AND id % 2 = 0"), (1, "id < 100 AND id % 2 = 1"), (2, "id > 1000"), (3, "id >= 100"), (1, "id < 100 AND id % 2 = 1")):
        M.add_to_rollup(ev.filter(cond), str(tmp_path), batch)
    got = sorted(map(tuple, M.rollup_of_deltas(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(map(tuple, R.daily_summary(ev).collect()), key=str)
    seen = spark.read.parquet(f"{tmp_path}/first_seen")
    got = {(r[0], r[1]): r[2] for r in M.distinct_over_days(seen, "user", "2024-01-02", "2024-01-06").collect()}
    want = ev.filter("timestamp >= '2024-01-02' AND timestamp < '2024-01-07' AND user_id IS NOT NULL").groupBy("app_id", "event_name").agg(
        F.count_distinct("user_id"))
    assert got == {(r[0], r[1]): r[2] for r in want.collect()}


def test_cascade_on_the_stored_table_leaves_other_files_alone(spark, tmp_path):
    import os
    path = f"{tmp_path}/events"
    ev = some_events(spark).withColumn("event_date", F.to_date("timestamp"))
    # App 3 only on days 1 and 2, and alone on day 20.
    ev = ev.filter("app_id <> 3 OR dayofmonth(timestamp) <= 2")
    alone = some_events(spark, 4).withColumn("app_id", F.lit(3).cast("long")).withColumn("event_date", F.lit("2024-01-20").cast("date"))
    ev.unionByName(alone).repartition(1).write.partitionBy("event_date").parquet(path)

    def files():
        return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    out = M.cascade_stored_events(spark, path, spark.createDataFrame([(3,), (99,)], "id long"))
    assert [str(t[0]) for t in out["rewritten"]] == ["2024-01-01", "2024-01-02"]
    assert [str(t[0]) for t in out["dropped"]] == ["2024-01-20"]
    after = files()
    assert {f: t for f, t in before.items() if not any(d in f for d in ("-01/", "-02/", "-20/"))}.items() <= after.items()
    left = spark.read.parquet(path)
    assert sorted(map(tuple, left.select("id", "app_id", "event_name").collect()), key=str) == sorted(
        map(tuple, ev.filter("app_id <> 3").select("id", "app_id", "event_name").collect()), key=str)
    assert M.cascade_stored_events(spark, path, spark.createDataFrame([(3,)], "id long")) == {"rewritten": [], "dropped": []}


def test_partition_values_list_one_level(spark, tmp_path):
    some_events(spark).withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date", "app_id").parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    table.inputFiles = None  # not asked for
    assert sorted(str(r[0]) for r in M.partition_values(table).collect()) == [f"2024-01-0{k}" for k in range(1, 10)]


def test_dashboards_from_app_days(spark, tmp_path):
    """Bounds inside a day, on midnight and outside the data; only the cut days are read raw."""
    from evlens.operators import tenants as T
    ev = some_events(spark).withColumn("event_date", F.to_date("timestamp"))
    ev.write.partitionBy("event_date").parquet(f"{tmp_path}/ev")
    ev = spark.read.parquet(f"{tmp_path}/ev")
    T.app_days(ev).write.parquet(f"{tmp_path}/days")
    days = spark.read.parquet(f"{tmp_path}/days")
    users = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    apps = spark.createDataFrame([(k, 1 + k % 2, f"a{k}", None) for k in range(9)], "id long, user_id long, app_name string, created_at timestamp_ntz")
    keys = spark.createDataFrame([(k, k % 5, True) for k in range(8)], "id long, app_id long, is_active boolean")
    for as_of in ("2024-01-09 11:30:00", "2024-01-10 00:00:00", "2024-02-05 03:00:00", "2025-01-01 00:00:00"):
        for user in (None, 2, 77):
            raw = T.dashboard(users, apps, keys, ev, as_of, user_id=user)
            fast = T.dashboard(users, apps, keys, ev, as_of, user_id=user, rollup=days)
            assert sorted(map(str, raw.collect())) == sorted(map(str, fast.select(*raw.columns).collect())), (as_of, user)
        raw, fast = (T.app_with_stats(apps, keys, ev, as_of, rollup=r) for r in (None, days))
        assert sorted(map(str, raw.collect())) == sorted(map(str, fast.collect()))
    plan = T.app_with_stats(apps, keys, ev, "2024-01-10 12:00:00", days=3, rollup=days)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("FileScan") if "/ev]" in x)
    assert "PartitionFilters: [isnotnull(event_date" in scan and "2024-01-07" in scan.split("PartitionFilters")[1][:160]


def test_rollup_batches_write_few_files(spark, tmp_path):
    """A day's rows go to one task (a large day to several): not a file a day and task."""
    import glob
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        M.add_to_rollup(some_events(spark), str(tmp_path), 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for name in ("first_seen", "deltas"):
        assert len(glob.glob(f"{tmp_path}/{name}/date=*/batch=0/*.parquet")) == 9
