"""Every registered query with an oracle equals its DuckDB SQL on the small fixture."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle import compare, duck_connection

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = compare(df, duck, ORACLES[name])
    assert res["match"], res


def test_every_query_runs(spark):
    for name, fn in E.queries().items():
        if name not in ORACLES:
            assert fn(spark, SF_SMALL).count() >= 0, name


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["event_name", "count"]
