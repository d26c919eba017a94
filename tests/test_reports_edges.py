"""Report operators on hand-made frames (edge cases the fixture lacks)."""

import datetime as dt

from pyspark.sql import functions as F

from evlens.operators import reports as R
from evlens.operators import tenants as T

EV_SCHEMA = ("id long, app_id long, event_name string, url string, device string, ip_address string, "
             "user_id string, session_id string, timestamp timestamp_ntz, browser string, os string, country string")


def ev(spark, rows):
    return spark.createDataFrame(rows, EV_SCHEMA)


def row(i, app, name, ts, user="u1", device="mobile", session="s1"):
    return (i, app, name, "https://x/", device, "10.0.0.1", user, session, ts, "Chrome", "iOS", "US")


def test_empty_app_list_gives_empty_result(spark):
    df = ev(spark, [row(1, 1, "click", dt.datetime(2024, 1, 1))])
    assert R.event_summary(df, []).count() == 0
    assert R.event_summary(df, None).count() == 1


def test_end_date_is_inclusive_at_the_instant(spark):
    df = ev(spark, [row(1, 1, "click", dt.datetime(2024, 1, 10, 0, 0, 0)),
                    row(2, 1, "click", dt.datetime(2024, 1, 10, 0, 0, 1))])
    out = R.event_summary(df, [1], end="2024-01-10").collect()
    assert out[0]["count"] == 1


def test_empty_event_name_means_no_filter(spark):
    df = ev(spark, [row(1, 1, "click", dt.datetime(2024, 1, 1)), row(2, 1, "view", dt.datetime(2024, 1, 1))])
    assert R.event_summary(df, [1], event_name="").count() == 2


def test_null_users_and_other_devices(spark):
    df = ev(spark, [row(1, 1, "click", dt.datetime(2024, 1, 1), user=None, device="tv"),
                    row(2, 1, "click", dt.datetime(2024, 1, 1), user="a", device=None)])
    r = R.event_summary(df).collect()[0]
    assert (r["count"], r["unique_users"], r["mobile_count"], r["desktop_count"]) == (2, 1, 0, 0)


def test_top_events_ties_broken_by_name(spark):
    df = ev(spark, [row(1, 1, "b", dt.datetime(2024, 1, 1)), row(2, 1, "a", dt.datetime(2024, 1, 1))])
    assert [r["event_name"] for r in R.top_events_raw(df, [1], limit=1).collect()] == ["a"]


def test_recent_events_caps_at_ten(spark):
    rows = [row(i, 1, "click", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), user="ten") for i in range(10)]
    rows += [row(100 + i, 1, "click", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), user="eleven")
             for i in range(11)]
    out = R.recent_events(ev(spark, rows), 10).groupBy("user_id").count().collect()
    assert {r["user_id"]: r["count"] for r in out} == {"ten": 10, "eleven": 10}
    newest = R.recent_events(ev(spark, rows), 10, app_id=1, user_id="eleven").orderBy("recent_rank").first()
    assert newest["timestamp"] == dt.datetime(2024, 1, 1, 0, 10)


def test_events_over_time_non_hour_is_daily(spark):
    df = ev(spark, [row(1, 1, "click", dt.datetime(2024, 1, 1, 5))])
    assert R.events_over_time(df, interval="week").first()["period"] == "2024-01-01"
    assert R.events_over_time(df, interval="hour").first()["period"] == "2024-01-01 05:00:00"


def test_top_events_dispatch_falls_back_when_rollup_empty(spark):
    df = ev(spark, [row(1, 1, "click", dt.datetime(2024, 1, 1))])
    empty = R.daily_summary(df).filter(F.lit(False))
    out = R.top_events(df, empty, [1], as_of="2024-01-31 00:00:00").collect()
    assert out[0]["count"] == 1


def test_q1_count_equals_sum_of_q6(spark):
    rows = [row(i, i % 3, "click" if i % 2 else "view", dt.datetime(2024, 1, 1 + i % 5, i % 24), user=str(i % 7))
            for i in range(200)]
    df = ev(spark, rows)
    q1 = sum(r["count"] for r in R.event_summary(df, [0, 1]).collect())
    q6 = sum(r["count"] for r in R.events_over_time(df, [0, 1], interval="hour").collect())
    assert q1 == q6


def test_dashboard_unknown_user_is_one_row_of_zeros(spark):
    df = ev(spark, [row(1, 1, "click", dt.datetime(2024, 1, 30))])
    users = spark.createDataFrame([(1, "user")], "id long, role string")
    apps = spark.createDataFrame([(1, 1, "a", None)], "id long, user_id long, app_name string, created_at timestamp_ntz")
    keys = spark.createDataFrame([(1, 1, True)], "id long, app_id long, is_active boolean")
    out = T.dashboard_stats(users, apps, keys, df, "2024-01-31 00:00:00", user_id=99).collect()
    assert len(out) == 1 and all(v == 0 for v in out[0].asDict().values())
    one = T.dashboard_stats(users, apps, keys, df, "2024-01-31 00:00:00", user_id=1).first()
    assert (one["total_apps"], one["total_active_keys"], one["events_last_7_days"]) == (1, 1, 1)


def test_owner_apps_fan_out_factor(spark):
    rows = [row(i, 1, "click", dt.datetime(2024, 1, 30)) for i in range(4)]
    apps = spark.createDataFrame([(1, 7, "a", None), (2, 7, "b", dt.datetime(2024, 1, 1))],
                                 "id long, user_id long, app_name string, created_at timestamp_ntz")
    keys = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, False)], "id long, app_id long, is_active boolean")
    out = T.owner_apps(apps, keys, ev(spark, rows), "2024-01-31 00:00:00", 7).collect()
    assert [r["id"] for r in out] == [1, 2]          # NULL created_at first
    assert out[0]["active_api_keys"] == 2 * 4        # keys x events, as the reference counts
    assert out[1]["active_api_keys"] == 0
    exact = T.owner_apps(apps, keys, ev(spark, rows), "2024-01-31 00:00:00", 7, exact_keys=True).first()
    assert exact["active_api_keys"] == 2


def test_rollup_sums_equal_raw_counts(spark):
    rows = [row(i, i % 4, ["click", "view", "buy"][i % 3], dt.datetime(2024, 1, 1 + i % 7, i % 24), user=str(i % 9))
            for i in range(300)]
    df = ev(spark, rows)
    q8 = {r["event_name"]: r["n"] for r in R.daily_summary(df).groupBy("event_name")
          .agg(F.sum("event_count").alias("n")).collect()}
    q3 = {r["event_name"]: r["count"] for r in R.top_events_raw(df, limit=10).collect()}
    assert q8 == q3


def test_rollup_sketch_estimates_distinct_users(spark):
    rows = [row(i, 1, "click", dt.datetime(2024, 1, 1 + i % 10, 12), user=str(i % 8)) for i in range(400)]
    df = ev(spark, rows)
    roll = R.daily_summary(df, with_sketch=True)
    out = R.top_events_rollup(roll, [1], "2024-01-31 00:00:00", users_estimate=True).first()
    assert out["unique_users"] == 40                  # user-days: 4 users (same parity) on each of 10 days
    assert abs(out["users_estimate"] - 8) <= 1        # distinct users, from the merged sketches
    approx = R.events_over_time(df, interval="day", approx=True).collect()
    assert len(approx) == 10
