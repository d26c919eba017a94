"""The key lookup that deals busy keys over many tasks."""

from collections import Counter

from conftest import SF_SMALL
from pyspark.sql import functions as F

from evlens.operators import ingest as I
from evlens.operators.lookup import hot_keys, spread_lookup
from evlens.sources.fixtures import AS_OF, Fixture


def _rows(spark, n=30_000):
    """A third of the rows have one key, a sixth none, a few a key that is unknown."""
    return spark.range(n).select(
        F.col("id").alias("rid"),
        F.when(F.col("id") % 3 == 0, F.lit("busy")).when(F.col("id") % 6 == 1, F.lit(None)).when(
            F.col("id") % 100 == 2, F.lit("unknown")).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"))


def _table(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("name"), F.col("id").alias("owner"))
    busy = spark.createDataFrame([("busy", -1), ("k7", -7), (None, -9)], "name string, owner long")  # k7 stands twice
    return keys.unionByName(busy)


def _plain(rows, table):
    return rows.join(table, F.col("key") == F.col("name"), "left")


def test_equals_left_join(spark):
    rows, table = _rows(spark), _table(spark)
    rows = rows.unionByName(rows.limit(50))  # repeated rows
    for share in (1, 7, 1000):
        got = spread_lookup(rows, "key", table, "name", F.col("rid"), share)
        assert got.columns == ["rid", "key", "name", "owner"]
        assert Counter(got.collect()) == Counter(_plain(rows, table).collect())


def test_empty_sides(spark):
    rows, table = _rows(spark, 60), _table(spark)
    assert spread_lookup(rows.limit(0), "key", table, "name", F.col("rid")).count() == 0
    got = spread_lookup(rows, "key", table.limit(0), "name", F.col("rid"))
    assert got.count() == 60 and got.filter("name is not null").count() == 0


def test_hot_keys_are_bounded(spark):
    rows = _rows(spark)
    assert [(r["_hot_key"], r["_pieces"]) for r in hot_keys(rows, "key", 10).collect()] == [("busy", 4)]
    many = spark.range(2000).select(F.concat(F.lit("k"), F.col("id") % 20).alias("key"))
    assert hot_keys(many, "key", 10).count() == 0 and hot_keys(many, "key", 1000).count() == 20


def test_busy_key_spreads_over_all_tasks(spark):
    """Without broadcast of the table, no task has over twice the median's rows."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows, table = _rows(spark), _table(spark)

        def tasks(df):
            return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())

        got, plain = tasks(spread_lookup(rows, "key", table, "name", F.col("rid"))), tasks(_plain(rows, table))
        assert sum(got) == sum(plain)
        assert len(got) == 8 and got[-1] <= 2 * got[len(got) // 2]
        assert plain[-1] > 2 * plain[len(plain) // 2]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_admission_with_spread_keys(spark):
    fx = Fixture(spark, SF_SMALL)

    def outcome(**kw):
        adm = I.admission(fx.raw_requests, fx.api_keys, fx.apps, as_of=AS_OF, key_hour_ttl=7 * 86400, **kw)
        return Counter(adm.select("received_at", "api_key", "client_ip", "event", "key_id", "app_id", "reject_reason").collect())

    assert outcome(spread_keys=True) == outcome()


def test_admission_by_distinct_agents(spark, monkeypatch):
    """Same enrichment; the rules see every distinct agent once."""
    fx = Fixture(spark, SF_SMALL)
    tables = []
    store = I.stored

    def watched(df, name):
        out = store(df, name)
        tables.extend([out] if name == "agents" else [])
        return out

    monkeypatch.setattr(I, "stored", watched)

    def enriched(**kw):
        adm = I.admission(fx.raw_requests, fx.api_keys, fx.apps, as_of=AS_OF, key_hour_ttl=7 * 86400, **kw)
        return Counter(adm.select("received_at", "api_key", "client_ip", "event", "browser", "os", "device", "reject_reason").collect())

    plain = enriched()
    assert not tables
    assert enriched(distinct_agents=True) == plain
    want = {r[0] for r in fx.raw_requests.select("user_agent").distinct().collect()} - {None, ""}
    rows = [r["_agent"] for r in tables[0].collect()]
    assert len(rows) == len(want) and set(rows) == want
