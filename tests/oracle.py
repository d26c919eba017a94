"""Side-by-side check of a registered query against its DuckDB oracle SQL.

Columns are compared sorted by name; rows as an order-insensitive multiset of
normalised values (floats rounded, timestamps as ISO text).
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

from evlens.sources.fixtures import RAW_TABLES


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def run_oracle(con, sql: str):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(df, con, sql: str) -> dict:
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    o_cols, o_rows = run_oracle(con, sql)
    out = {"spark_rows": len(s_rows), "oracle_rows": len(o_rows),
           "spark_cols": sorted(s_cols), "oracle_cols": sorted(o_cols)}
    out["schema_match"] = sorted(s_cols) == sorted(o_cols)
    if not out["schema_match"]:
        out["match"] = False
        return out
    s_idx = [s_cols.index(c) for c in sorted(s_cols)]
    o_idx = [o_cols.index(c) for c in sorted(o_cols)]
    sc = Counter(tuple(_norm(r[i]) for i in s_idx) for r in s_rows)
    oc = Counter(tuple(_norm(r[i]) for i in o_idx) for r in o_rows)
    out["match"] = sc == oc
    if not out["match"]:
        out["only_spark"] = list((sc - oc).items())[:3]
        out["only_oracle"] = list((oc - sc).items())[:3]
    return out
