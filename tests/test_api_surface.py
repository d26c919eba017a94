"""Public helpers not covered by the registered queries."""

import datetime as dt

from pyspark.sql import functions as F

from evlens.functions import keys as K
from evlens.operators import ingest as I
from evlens.operators import limits as L
from evlens.operators import reqlog as RL
from evlens.sources import tables as TB

T0 = dt.datetime(2024, 1, 1)


def test_limit_presets(spark):
    rows = [(1, None, "10.0.0.1", T0 + dt.timedelta(minutes=i)) for i in range(12)]
    df = spark.createDataFrame(rows, "key_id long, rate_limit_per_hour int, client_ip string, received_at timestamp_ntz")
    kh = L.key_hour_limit(df.withColumn("rate_limit_per_hour", F.lit(0)))   # 0 -> default 10000
    assert kh.filter("limit_exceeded").count() == 0
    kh3 = L.key_hour_limit(df.withColumn("rate_limit_per_hour", F.lit(3)))
    assert kh3.filter("limit_exceeded").count() == 9
    auth = L.auth_limit(df)                                                  # 10 per 15 minutes per IP
    assert auth.filter("limit_exceeded").count() == 2                        # the 11th and 12th in the window


def test_small_helpers(spark):
    df = spark.createDataFrame([("GET", "/x", "a" * 64, None), ("POST", "/y", "short", T0)],
                               "m string, p string, k string, last timestamp_ntz")
    out = df.select(RL.endpoint_key(F.col("m"), F.col("p")).alias("e"), K.key_well_formed(F.col("k")).alias("ok"),
                    K.stale_touch(F.col("last"), F.lit(T0 + dt.timedelta(minutes=4))).alias("s1"),
                    K.stale_touch(F.col("last"), F.lit(T0 + dt.timedelta(minutes=6))).alias("s2")).collect()
    assert [tuple(r) for r in out] == [("GET /x", True, True, True), ("POST /y", False, False, True)]


def test_receipts_and_tables(spark, tmp_path):
    ev = spark.createDataFrame([("i1", "click", T0)], "id string, event_name string, timestamp timestamp_ntz")
    assert I.receipts(ev).first().asDict() == {"id": "i1", "event": "click", "timestamp": T0}
    users = spark.createDataFrame([], TB.USERS)
    TB.write_snapshot(users, str(tmp_path / "users"))
    assert TB.read_dim(spark, str(tmp_path / "users"), "users").schema == TB.USERS
    sec = spark.createDataFrame([("1", "api_key_missing", "low", "1.1.1.1", None, "d", "{}", False, T0)],
                                TB.SECURITY_EVENTS)
    TB.write_log(sec, str(tmp_path / "sec"))
    back = TB.read_log(spark, str(tmp_path / "sec"), "security_events")
    assert back.first()["log_date"] == dt.date(2024, 1, 1)
