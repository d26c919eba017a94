"""Physical-plan checks: pruning, pushdown, no Python in the reports."""

import datetime as dt

from pyspark.sql import functions as F

from evlens.operators import reports as R
from evlens.sources import tables as TB


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path):
    rows = [(str(i), i % 3, "click", dt.datetime(2024, 1, 1 + i % 9, i % 24), str(i % 5), "mobile", f"s{i % 4}",
             "US", "u") for i in range(300)]
    df = (spark.createDataFrame(rows, "id string, app_id long, event_name string, timestamp timestamp_ntz, "
                                      "user_id string, device string, session_id string, country string, url string")
               .withColumn("event_date", F.to_date("timestamp")))
    path = str(tmp_path / "events")
    n = TB.append_events(df, path)
    assert n == 300
    return path


def test_time_range_prunes_partitions_and_pushes_filters(spark, tmp_path):
    path = stored(spark, tmp_path)
    ev = TB.read_events(spark, path, "2024-01-03", "2024-01-04 12:00:00")
    p = plan_of(R.event_summary(ev, [1, 2], "click"))
    assert "PartitionFilters: [isnotnull(event_date" in p
    assert "PushedFilters: [IsNotNull(timestamp)" in p
    assert ev.count() == sum(1 for i in range(300) if dt.datetime(2024, 1, 3) <= dt.datetime(2024, 1, 1 + i % 9, i % 24)
                             <= dt.datetime(2024, 1, 4, 12))


def test_reports_stay_in_the_jvm(spark, tmp_path):
    ev = spark.read.parquet(stored(spark, tmp_path))
    for df in (R.event_summary(ev, [1]), R.top_events_raw(ev), R.events_over_time(ev, interval="hour"),
               R.device_distribution(ev), R.daily_summary(ev)):
        p = plan_of(df)
        assert "Python" not in p and "ArrowEval" not in p


def test_recent_events_limit_below_shuffle(spark, tmp_path):
    ev = spark.read.parquet(stored(spark, tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = R.recent_events(ev, 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p


def test_single_owner_dashboard_prunes_scan(spark, tmp_path):
    from evlens.operators import tenants as T
    ev = spark.read.parquet(stored(spark, tmp_path))
    apps = spark.createDataFrame([(1, 7, "a", None), (2, 8, "b", None)],
                                 "id long, user_id long, app_name string, created_at timestamp_ntz")
    keys = spark.createDataFrame([(1, 1, True)], "id long, app_id long, is_active boolean")
    users = spark.createDataFrame([(7, "user")], "id long, role string")
    p = plan_of(T.dashboard_stats(users, apps, keys, ev, "2024-01-10 00:00:00", user_id=7))
    assert "LeftSemi" in p
    assert "PartitionFilters: [isnotnull(event_date" in p
