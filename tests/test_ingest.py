"""Admission pipeline: one hand-made request per reject reason, enrichment rules."""

import datetime as dt

from evlens.functions import keys as K
from evlens.operators import ingest as I
from evlens.operators import upkeep as M
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 1, 15, 12, 0, 0)
RAW = ("received_at timestamp_ntz, api_key string, client_ip string, user_agent string, event string, url string, "
       "device string, userId string, timestamp_text string, metadata string")


def dims(spark):
    apps = spark.createDataFrame([(1, 7)], "id long, user_id long")
    keys = spark.createDataFrame([
        (1, 1, "good", True, None, None, {"read": True, "write": True}, None),
        (2, 1, "inactive", False, None, None, None, None),
        (3, 1, "expired", True, dt.datetime(2024, 1, 1), None, None, None),
        (4, 1, "iplist", True, None, ["10.9.9.9"], None, None),
        (5, 1, "readonly", True, None, None, {"read": True, "write": False}, None),
        (6, 1, "limit1", True, None, None, None, 1),
        (7, 1, "expnow", True, NOW, None, None, None),
        (8, 99, "orphan", True, None, None, None, None),
    ], "id long, app_id long, plain string, is_active boolean, expires_at timestamp_ntz, allowed_ips array<string>, "
       "permissions struct<read:boolean,write:boolean>, rate_limit_per_hour int")
    keys = keys.withColumn("key_hash", K.key_hash(F.col("plain"))).drop("plain")
    return keys, apps


def req(key="good", event="click", ua=None, meta='{"a": 1}', ts_text=None, url="https://x/", at=NOW, ip="10.0.0.1",
        device=None, user="u1"):
    return (at, key, ip, ua, event, url, device, user, ts_text, meta)


CASES = {
    "ok": (req(), None),
    "xss_sanitised": (req(event="cl<i>ck"), None),
    "injection": (req(url="https://x/?q=1;drop"), "sql_pattern"),
    "nested_injection": (req(meta='{"a": {"b": ["x; y"]}}'), "sql_pattern"),
    "missing": (req(key=None), "api_key_missing"),
    "empty_key": (req(key=""), "api_key_missing"),
    "unknown": (req(key="nope"), "api_key_invalid"),
    "inactive": (req(key="inactive"), "api_key_invalid"),
    "expired": (req(key="expired"), "api_key_invalid"),
    "expires_now": (req(key="expnow"), None),
    "orphan_app": (req(key="orphan"), "api_key_invalid"),
    "ip": (req(key="iplist"), "api_key_ip_blocked"),
    "readonly": (req(key="readonly"), "no_permission"),
    "bad_name": (req(event="bad name!"), "validation"),
    "newline_name": (req(event="click\n"), "validation"),
    "name_255": (req(event="a" * 255), None),
    "name_256": (req(event="a" * 256), "validation"),
    "bad_ts": (req(ts_text="invalid-date"), "validation"),
    "array_meta": (req(meta="[1]"), "validation"),
    "broken_json": (req(meta="{oops"), "malformed_body"),
    "country": (req(meta='{"country": "USA"}'), "constraint:country"),
    "old_month": (req(ts_text="2023-01-05"), "no_partition"),
    "too_large": (req(url="https://x/" + "a" * (1024 * 1024)), "too_large"),
}


def test_every_reject_reason(spark):
    keys, apps = dims(spark)
    rows = [c[0] for c in CASES.values()]
    raw = spark.createDataFrame(rows, RAW).withColumn("case", F.lit(None).cast("string"))
    names = list(CASES)
    raw = spark.createDataFrame([r + (n,) for r, n in zip(rows, names)], RAW + ", case string")
    out = {r["case"]: r["reject_reason"] for r in I.admission(raw, keys, apps, as_of=NOW).collect()}
    for name, (_, expected) in CASES.items():
        assert out[name] == expected, (name, out[name])


def test_key_hour_limit_counts_rejected_requests(spark):
    keys, apps = dims(spark)
    rows = [req(key="limit1", at=NOW + dt.timedelta(minutes=i)) for i in range(3)]
    rows.append(req(key="limit1", at=NOW + dt.timedelta(minutes=59)))   # counter still alive (started at +0)
    rows.append(req(key="limit1", at=NOW + dt.timedelta(minutes=130)))  # new counter
    out = I.admission(spark.createDataFrame(rows, RAW), keys, apps, as_of=NOW).orderBy("received_at").collect()
    assert [r["reject_reason"] for r in out] == [None, "api_key_rate_limit", "api_key_rate_limit",
                                                 "api_key_rate_limit", None]


def test_enrichment_rules(spark):
    keys, apps = dims(spark)
    rows = [req(ua="Mozilla/5.0 (iPhone) Safari/604.1", meta='{"browser": "Mine", "screenSize": "1x1"}'),
            req(ua=None, meta='{"browser": "Mine"}', device="tablet"),
            req(ua="curl/8.0", meta='{"os": ""}', ts_text="2024-01-14T10:00:00Z"),
            req(meta='{"onclick=": "<b>hi</b>", "k": "javascript:x"}')]
    out = I.accepted_events(I.admission(spark.createDataFrame(rows, RAW), keys, apps, as_of=NOW)).collect()
    by_browser = sorted(out, key=lambda r: (r["browser"] or "", r["os"] or ""))
    assert len(out) == 4
    r_iphone = [r for r in out if r["screen_size"] == "1x1"][0]
    assert (r_iphone["browser"], r_iphone["device"], r_iphone["os"]) == ("Mine", "mobile", "iOS")
    r_noua = [r for r in out if r["device"] == "tablet"][0]
    assert r_noua["browser"] == "Mine" and r_noua["os"] is None
    r_curl = [r for r in out if r["timestamp"] == dt.datetime(2024, 1, 14, 10)][0]
    assert r_curl["device"] == "desktop" and r_curl["os"] == "Other"
    r_meta = [r for r in out if "hi" in (r["metadata"] or "")][0]
    assert r_meta["metadata"] == '{"onclick=":"bhi/b","k":"x"}'   # values sanitised, keys kept
    assert by_browser


def test_security_events_for_key_failures(spark):
    keys, apps = dims(spark)
    rows = [req(key=None), req(key="nope"), req(key="iplist")]
    sec = I.security_events(I.admission(spark.createDataFrame(rows, RAW), keys, apps, as_of=NOW)).collect()
    assert sorted((r["event_type"], r["severity"]) for r in sec) == [
        ("api_key_invalid", "medium"), ("api_key_ip_blocked", "high"), ("api_key_missing", "low")]


def test_provisioned_months(spark):
    months = I.provisioned_months("2024-01-31 00:00:00")
    assert "2024-01" in months and "2024-12" in months and "2025-01" in months and "2023-12" not in months
    frame = {r[0] for r in M.provisioned_months_frame(spark, "2024-01-31 00:00:00").collect()}
    assert frame == set(months)


BODIES = {  # request bodies beyond the nine fields, as further fields of a JSON line
    '"note": "drop table x"': "sql_pattern",
    '"a": {"b": ["x", {"c": "1; 2"}]}': "sql_pattern",
    '"a": "\\u0064rop x"': "sql_pattern",           # escaped text is decoded first
    '"a": "dr<op x"': "sql_pattern",                 # screened after sanitising
    '"select": 1, "x": {"drop": [null, true, 1.5]}': None,   # keys and other kinds of values aren't screened
    '"a": "b or c", "d": "e = f"': None,               # each value by itself
    '"a": {}': None,
    '"referrer": {"q": "x; y"}': "sql_pattern",      # a known field that holds nested values
    '"referrer": "[1; 2]"': "sql_pattern",
    '"deep": ' + '{"k": [' * 60 + '"union all select"' + "]}" * 60: "sql_pattern",
    '"long": "' + "ok \\\"" * 20000 + '"': None,
    '"long": "' + "ok \\\"" * 20000 + '--"': "sql_pattern",
}


def test_every_value_of_the_body_is_screened(spark, tmp_path):
    from evlens.sources import tables as TB
    keys, apps = dims(spark)
    line = ('{{"received_at": "2024-01-15T12:00:00.000000", "api_key": "good", "client_ip": "10.0.0.1", '
            '"event": "click", "userId": "{n}", {more}}}\n')
    text = "".join(line.format(n=n, more=more) for n, more in enumerate(BODIES)) + "\n   \n{oops\n[1]\n"
    (tmp_path / "lines.json").write_text(text)
    raw = TB.read_raw(spark, str(tmp_path))
    assert raw.count() == len(BODIES) + 2
    out = {r["userId"]: r for r in I.admission(raw, keys, apps, as_of=NOW).collect()}
    got = [out[str(n)]["reject_reason"] for n in range(len(BODIES))]
    assert got == list(BODIES.values())
    assert out[None]["reject_reason"] == "malformed_body"


def test_further_fields_survive_a_round_trip(spark, tmp_path):
    from evlens.sources import tables as TB
    rows = [("click", '{"a":{"b":["x",1,null]},"c":"d"}'), ("view", None), ("none", "{}")]
    df = spark.createDataFrame(rows, "event string, extra string")
    TB.write_raw(df, f"{tmp_path}/raw")
    got = {r["event"]: r["extra"] for r in TB.read_raw(spark, f"{tmp_path}/raw").collect()}
    assert got == {"click": '{"a":{"b":["x",1,null]},"c":"d"}', "view": None, "none": None}


def test_only_requests_at_the_counters_are_joined_with_the_late_ones(spark):
    """The rejected rows go round the join, each once."""
    from conftest import SF_SMALL
    from evlens.sources.fixtures import AS_OF, Fixture
    fx = Fixture(spark, SF_SMALL)
    adm = I.admission(fx.raw_requests, fx.api_keys, fx.apps, as_of=AS_OF)
    assert "Union" in adm._jdf.queryExecution().optimizedPlan().toString()
    assert adm.count() == fx.raw_requests.count()
