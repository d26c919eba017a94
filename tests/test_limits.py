"""Counter replays against plain sequential loops (the reference's counters)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from evlens.operators import limits as L

T0 = dt.datetime(2024, 1, 1)


def naive_anchored(times, ttl, limit):
    out, start, count = [], None, 0
    for t in times:
        if start is None or t > start + ttl:
            start, count = t, 0
        count += 1
        out.append((start, count, count > limit))
    return out


def naive_sliding(times, window, limit):
    log, out = [], []
    for t in times:
        log = [x for x in log if t - x < window]
        if len(log) >= limit:
            out.append(False)
        else:
            out.append(True)
            log.append(t)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long")


def gen(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for key in ("a", "b", "c"):
        t = T0
        for i in range(n):
            t += dt.timedelta(seconds=rnd.choice([1, 5, 30, 200, 900, 3600, 7200]))
            rows.append((key, t, i))
    return rows


def test_anchored_counter_matches_loop(spark):
    rows = gen(1)
    for breach_only in (False, True):
        out = L.anchored_counter(frame(spark, rows), ["k"], "ts", 3600, 5, tiebreak=["seq"],
                                 breach_only=breach_only).collect()
        assert breach_only == ("window_count" not in out[0].asDict())
        got = {(r["k"], r["seq"]): (None, None, r["limit_exceeded"]) if breach_only
               else (r["window_start"], r["window_count"], r["limit_exceeded"]) for r in out}
        for key in ("a", "b", "c"):
            ts = [t for k, t, _ in rows if k == key]
            for i, exp in enumerate(naive_anchored(ts, dt.timedelta(seconds=3600), 5)):
                g = got[(key, i)]
                assert g[2] == exp[2]
                if not breach_only:
                    assert (g[0], g[1]) == exp[:2]


def test_request_exactly_ttl_later_stays_in_window(spark):
    rows = [("a", T0, 0), ("a", T0 + dt.timedelta(seconds=3600), 1), ("a", T0 + dt.timedelta(seconds=3601), 2)]
    out = L.anchored_counter(frame(spark, rows), ["k"], "ts", 3600, 1, tiebreak=["seq"]).orderBy("seq").collect()
    assert [r["window_count"] for r in out] == [1, 2, 1]
    assert [r["limit_exceeded"] for r in out] == [False, True, False]


def test_seeded_batches_equal_one_batch(spark):
    rows = gen(2, 200)
    whole = L.anchored_counter(frame(spark, rows), ["k"], "ts", 3600, 4, tiebreak=["seq"])
    cut = sorted(t for _, t, _ in rows)[len(rows) // 2]
    first = L.anchored_counter(frame(spark, [r for r in rows if r[1] < cut]), ["k"], "ts", 3600, 4, tiebreak=["seq"])
    seed = L.open_counters(first, ["k"], "ts", 3600)
    second = L.anchored_counter(frame(spark, [r for r in rows if r[1] >= cut]), ["k"], "ts", 3600, 4,
                                tiebreak=["seq"], seed=seed)
    cols = ["k", "seq", "window_start", "window_count", "limit_exceeded"]
    a = sorted(tuple(r) for r in whole.select(*cols).collect())
    b = sorted(tuple(r) for r in first.select(*cols).unionByName(second.select(*cols)).collect())
    assert a == b


def test_sliding_log_matches_loop(spark):
    rows = gen(3)
    out = L.sliding_log_limit(frame(spark, rows), ["k"], "ts", 3600, 3, tiebreak=["seq"]).collect()
    got = {(r["k"], r["seq"]): r["admitted"] for r in out}
    for key in ("a", "b", "c"):
        ts = [t for k, t, _ in rows if k == key]
        for i, exp in enumerate(naive_sliding(ts, dt.timedelta(seconds=3600), 3)):
            assert got[(key, i)] == exp


def test_aligned_counter_and_headers(spark):
    rows = [("a", T0 + dt.timedelta(minutes=m), i) for i, m in enumerate([0, 5, 14, 16])]
    out = L.aligned_counter(frame(spark, rows), ["k"], "ts", 900, 2, tiebreak=["seq"]).orderBy("seq").collect()
    assert [r["window_count"] for r in out] == [1, 2, 3, 1]
    h = L.limit_headers(L.anchored_counter(frame(spark, rows), ["k"], "ts", 900, 2), "ts", 2, 900)
    assert [r["remaining"] for r in h.orderBy("seq").collect()] == [1, 0, 0, 1]
    assert h.filter(F.col("reset_at") != F.col("ts") + F.expr("INTERVAL 900 SECONDS")).count() == 0


def test_folds_carry_state_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_anchored_counter_matches_loop(spark)
        test_sliding_log_matches_loop(spark)
        test_seeded_batches_equal_one_batch(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_hot_keys_take_the_parallel_path(spark):
    rows = gen(6, 300)
    rows += [(k, t, 10000 + i) for i, (k, t, _) in enumerate(rows[::5])]   # tied arrival times
    cold = L.anchored_counter(frame(spark, rows), ["k"], "ts", 3600, 4, tiebreak=["seq"], hot_rows=None)
    mixed = L.anchored_counter(frame(spark, rows), ["k"], "ts", 3600, 4, tiebreak=["seq"], hot_rows=50)
    par = L.anchored_counter_parallel(frame(spark, rows), ["k"], "ts", 3600, 4, tiebreak=["seq"])
    cols = ["k", "seq", "window_start", "window_count", "limit_exceeded"]
    a = sorted(tuple(r) for r in cold.select(*cols).collect())
    assert a == sorted(tuple(r) for r in mixed.select(*cols).collect())
    assert a == sorted(tuple(r) for r in par.select(*cols).collect())
    for key in ("a", "b", "c"):
        ts = sorted(((t, s) for k, t, s in rows if k == key))
        exp = naive_anchored([t for t, _ in ts], dt.timedelta(seconds=3600), 4)
        got = {(r[0], r[1]): r for r in a}
        assert [(got[(key, s)][2], got[(key, s)][3]) for _, s in ts] == [e[:2] for e in exp]


def test_parallel_path_with_seed(spark):
    rows = gen(7, 150)
    cut = sorted(t for _, t, _ in rows)[len(rows) // 2]
    whole = L.anchored_counter(frame(spark, rows), ["k"], "ts", 3600, 4, tiebreak=["seq"], hot_rows=None)
    first = L.anchored_counter(frame(spark, [r for r in rows if r[1] < cut]), ["k"], "ts", 3600, 4,
                               tiebreak=["seq"], hot_rows=None)
    seed = L.open_counters(first, ["k"], "ts", 3600)
    second = L.anchored_counter_parallel(frame(spark, [r for r in rows if r[1] >= cut]), ["k"], "ts", 3600, 4,
                                         tiebreak=["seq"], seed=seed)
    cols = ["k", "seq", "window_start", "window_count", "limit_exceeded"]
    a = sorted(tuple(r) for r in whole.select(*cols).collect())
    b = sorted(tuple(r) for r in first.select(*cols).unionByName(second.select(*cols)).collect())
    assert a == b


def test_breach_only_is_the_same_for_hot_and_cold_keys(spark):
    rows = gen(5, 120)
    cold, hot = (L.anchored_counter(frame(spark, rows), ["k"], "ts", 3600, 4, tiebreak=["seq"], breach_only=True, hot_rows=n)
                 for n in (None, 0))
    assert sorted(cold.columns) == sorted(hot.columns)
    assert sorted(map(tuple, cold.collect())) == sorted(map(tuple, hot.select(*cold.columns).collect()))


def test_collect_limit_takes_the_address_for_an_empty_header(spark):
    rows = [("", f"10.0.0.{k % 3}", T0 + dt.timedelta(seconds=k)) for k in range(6)]
    df = spark.createDataFrame(rows, "api_key string, client_ip string, received_at timestamp_ntz")
    out = L.collect_limit(df, limit=10).collect()
    assert sorted(r["window_count"] for r in out) == [1, 1, 1, 2, 2, 2]


def test_vectorised_admissions_match_loop():
    import numpy as np
    rnd = random.Random(8)
    for case in range(300):
        limit, window = rnd.randint(1, 6), rnd.randint(1, 40)
        t, at = [], 0
        for _ in range(rnd.randint(0, 120)):
            at += rnd.choice([0, 0, 1, 1, 2, 5, 30])
            t.append(at)
        want = naive_sliding(t, window, limit)
        cut = rnd.randint(0, len(t))
        first = L.admitted_times(np.array(t[:cut], dtype=np.int64), np.empty(0, dtype=np.int64), window, limit)
        log = np.array(t[:cut], dtype=np.int64)[first][-limit:]
        second = L.admitted_times(np.array(t[cut:], dtype=np.int64), log, window, limit)
        assert first.tolist() + second.tolist() == want, (limit, window, t)


def test_sliding_log_of_a_busy_key_runs_in_segments(spark):
    """One key with most rows, bursts over the limit, ties, a null key and rows without a time."""
    rnd = random.Random(21)
    rows, t = [], T0
    for i in range(3000):
        t += dt.timedelta(seconds=rnd.choice([0, 0, 1, 2, 3, 40 if i % 90 == 0 else 1]))
        if i % 300 == 0:
            t += dt.timedelta(seconds=rnd.choice([61, 119, 120, 121, 500]))
        rows.append(("busy" if i % 10 else rnd.choice(["rare", None]), t, i))
    rows += [("busy", None, 5000), (None, None, 5001)]
    df = frame(spark, rows)
    for limit in (1, 7, 25):
        got = {r["seq"]: r["admitted"] for r in L.sliding_log_limit(df, ["k"], "ts", 60, limit, tiebreak=["seq"]).collect()}
        assert len(got) == len(rows) and got[5000] and got[5001]
        for key in ("busy", "rare", None):
            mine = [(t, s) for k, t, s in rows if k == key and t is not None]
            want = naive_sliding([t for t, _ in mine], dt.timedelta(seconds=60), limit)
            assert [got[s] for _, s in mine] == want, (key, limit)
    d = df.filter("ts IS NOT NULL").withColumn("_b", L._bucket(L._micros(F.col("ts")), 60_000_000))
    seg = L.sliding_segments(d, ["k"], 60_000_000, 25)
    assert seg.filter("k = 'busy' AND _fold").select("_seg").distinct().count() > 5


def test_running_total_spreads_one_group(spark, monkeypatch):
    seen = []
    keep = L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    df = spark.range(20_000).select(F.when(F.col("id") % 50 != 0, "hot").alias("k"), (F.col("id") * 7 % 1000).alias("t"), "id",
                                    F.lit(2).cast("long").alias("w"))
    out = L.running_total(df, ["k"], ["t", "id"], "w", "total")
    got = sorted((r["k"] or "", r["t"], r["id"], r["total"]) for r in out.collect())
    for key in ("", "hot"):
        mine = [r for r in got if r[0] == key]
        assert [r[3] for r in mine] == [2 * n for n in range(1, len(mine) + 1)]
    sizes = [r["count"] for r in seen[0].filter("k = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 6000


def test_aligned_counter_of_hot_windows_is_the_same(spark):
    rows = gen(6, 300) + [("a", T0 + dt.timedelta(seconds=k % 50), 1000 + k) for k in range(500)]
    df = frame(spark, rows)
    cold = L.aligned_counter(df, ["k"], "ts", 3600, 3, tiebreak=["seq"], hot_rows=None)
    hot = L.aligned_counter(df, ["k"], "ts", 3600, 3, tiebreak=["seq"], hot_rows=20)
    assert sorted(map(tuple, cold.collect())) == sorted(map(tuple, hot.select(*cold.columns).collect()))


def test_next_arrival_is_one_pass_and_hot_keys_are_bounded(spark):
    """A frame that ends at the last row is evaluated anew for every row of a bucket."""
    times = spark.createDataFrame([("k", 1), ("k", 2), ("k", 13), ("m", 4)], "k string, _us long")
    nxt = L._next_arrival(times, ["k"], 10)
    assert "unboundedfollowing" not in nxt._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(tuple, nxt.collect())) == [("k", 1, 13), ("k", 2, 13), ("k", 13, None), ("m", 4, None)]
    assert L.HOT_KEY_ROWS <= 500_000
