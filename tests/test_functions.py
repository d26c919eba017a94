"""Scalar functions (C6-C17, I11) on hand-made values."""

import pytest
from pyspark.sql import functions as F

from evlens.functions import keys as K
from evlens.functions import text as X
from evlens.functions import useragent as UA


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,expected", [
    ("<b>hi</b>", "bhi/b"),
    ("JavaScript:alert(1)", "alert(1)"),
    ("x onClick = y", "x  y"),
    ("?sessionId=9", "?sessi9"),            # sanitising eats URL parts, as the reference does
    ("plain", "plain"),
])
def test_sanitize(spark, value, expected):
    assert one(spark, X.sanitize, value) == expected


@pytest.mark.parametrize("value,hit", [
    ("select * from t", True), ("a; b", True), ("x -- y", True), ("union all select", True),
    ("a or b = c", True), ("delete-item", True), ("wasp_click", True), ("click", False),
    ("selection", False), ("https://x/p?q=1", False), (None, False),
])
def test_injection_screen(spark, value, hit):
    assert one(spark, X.injection_hit, value) == hit


@pytest.mark.parametrize("value,ok", [
    ("click", True), ("a:b.c-d_e", True), ("bad name!", False), ("click\n", False), ("", False),
])
def test_event_name_pattern(spark, value, ok):
    assert bool(one(spark, X.valid_event_name, value)) == ok


@pytest.mark.parametrize("value,ok", [
    ("2024-01-05", True), ("2024-01-05T10:00:00Z", True), ("2024-01-05T10:00:00.123+01:00", True),
    ("20240105", True), ("invalid-date", False), ("2024-1-5", False),
])
def test_iso8601(spark, value, ok):
    assert bool(one(spark, X.is_iso8601, value)) == ok


def test_js_or_and_json(spark):
    df = spark.createDataFrame([("", None, "c", '{"browser": "B", "n": 1}')], "a string, b string, c string, m string")
    r = df.select(X.js_or(F.col("a"), F.col("b"), F.col("c")).alias("o"),
                  X.json_field(F.col("m"), "browser").alias("b"), X.json_field(F.col("m"), "n").alias("n"),
                  X.is_json_object(F.col("m")).alias("obj")).first()
    assert (r["o"], r["b"], r["n"], r["obj"]) == ("c", "B", "1", True)


def test_metadata_walk_keeps_keys_and_finds_nested_injection(spark):
    df = spark.createDataFrame([('{"on<x>": ["<i>", {"d": "a;b"}]}',), ('{"k": 1}',)], "m string")
    rows = df.select(X.metadata_walk(F.col("m")).alias("w")).collect()
    assert rows[0]["w"]["text"] == '{"on<x>":["i",{"d":"a;b"}]}'
    assert rows[0]["w"]["injection"] is True
    assert rows[1]["w"]["injection"] is False


def test_metadata_walk_equals_a_parsed_walk(spark):
    import json
    import random
    import re
    rnd = random.Random(4)
    words = ["a", "<b>", "x;y", "drop it", "on click =1", "javascript:z", "q\"uote", "back\\slash", "\n\t", "é漢🙂", "", "or x = 1", ":", "{", "]"]

    def value(depth):
        kind = rnd.randrange(7 if depth else 4)
        if kind < 4:
            return rnd.choice([rnd.choice(words), rnd.choice(words) + rnd.choice(words), 1, None, True, 2.5])
        if kind == 4:
            return [value(depth - 1) for _ in range(rnd.randrange(4))]
        return {rnd.choice(words) + str(n): value(depth - 1) for n in range(rnd.randrange(4))}

    def clean(v):
        for pattern, _ in X.SANITIZE_STEPS:
            v = re.sub(pattern, "", v, flags=re.A)
        return v

    def walk(v):
        if isinstance(v, str):
            s = clean(v)
            return s, any(re.search(p, s, re.A | re.I) for p in X.INJECTION_PATTERNS)
        if isinstance(v, list):
            parts = [walk(x) for x in v]
            return [p[0] for p in parts], any(p[1] for p in parts)
        if isinstance(v, dict):
            parts = {k: walk(x) for k, x in v.items()}
            return {k: p[0] for k, p in parts.items()}, any(p[1] for p in parts.values())
        return v, False

    values = [value(4) for _ in range(300)]
    texts = [json.dumps(v, ensure_ascii=rnd.random() < .5, indent=rnd.choice([None, 2])) for v in values]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)] + [(300, "{oops"), (301, None)], "n int, t string")
    got = {r["n"]: r["w"] for r in rows.select("n", X.metadata_walk(F.col("t")).alias("w")).collect()}
    for n, v in enumerate(values):
        want, hit = walk(v)
        assert (json.loads(got[n]["text"]), got[n]["injection"]) == (want, hit), texts[n]
    assert got[300] is None and got[301] is None
    assert {walk(v)[1] for v in values} == {True, False}


def test_user_agent_rules(spark):
    df = spark.createDataFrame([("Mozilla/5.0 (iPhone) Safari/604.1",), ("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0",),
                                ("curl/8.0",), ("Googlebot/2.1",)], "ua string")
    out = df.select(UA.agent_browser(F.col("ua")).alias("b"), UA.agent_os(F.col("ua")).alias("o"),
                    UA.agent_is_handheld(F.col("ua")).alias("h")).collect()
    assert [tuple(r) for r in out] == [("Mobile Safari 604.1", "iOS", True), ("Chrome 120.0", "Windows", False),
                                      ("curl 8.0", "Other", False), ("Bot", "Other", False)]


def test_key_helpers(spark):
    df = spark.createDataFrame([("key-1", ["10.0.0.1"], None), ("k", [], {"read": True, "write": False})],
                               "k string, ips array<string>, p struct<read:boolean,write:boolean>")
    out = df.select(K.key_prefix(F.col("k")).alias("pre"), F.length(K.key_hash(F.col("k"))).alias("n"),
                    K.ip_allowed(F.col("ips"), F.lit("10.0.0.2")).alias("ip"),
                    K.has_permission(F.col("p"), "write").alias("w")).collect()
    assert [tuple(r) for r in out] == [("key-1", 64, False, True), ("k", 64, True, False)]


@pytest.mark.parametrize("value,ok", [
    ("123e4567-e89b-42d3-a456-426614174000", True), ("123E4567-E89B-42D3-A456-426614174000", True),
    ("123e4567-e89b-12d3-a456-426614174000", False), ("not-a-uuid", False),
])
def test_uuid_v4(spark, value, ok):
    assert bool(one(spark, X.is_uuid_v4, value)) == ok
