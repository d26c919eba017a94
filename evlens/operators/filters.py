"""The filter contract shared by the event reports.

* ``app_ids``: ``None`` = no tenant filter, a list = membership (empty list =
  empty result), a DataFrame with an ``app_id`` column = semi join (AQE
  broadcasts it when its measured size allows).
* ``event_name``: falsy (``None`` or ``''``) means no filter.
* ``start`` / ``end``: inclusive instants on ``timestamp``; a date-only ``end``
  keeps only midnight of that day.
* When the frame carries the ``event_date`` partition column, the same range is
  repeated on it so the scan prunes whole partitions (a predicate on
  ``timestamp`` alone never prunes directory partitions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed_lit(df: DataFrame, column: str, value) -> Column:
    """A literal cast to the column's own type, so the comparison stays pushable."""
    return F.lit(value).cast(df.schema[column].dataType)


def filter_apps(df: DataFrame, app_ids, column: str = "app_id") -> DataFrame:
    if app_ids is None:
        return df
    if isinstance(app_ids, DataFrame):
        first = app_ids.select(F.col(app_ids.columns[0] if column not in app_ids.columns else column).alias("__app"))
        return df.join(first.distinct(), df[column] == F.col("__app"), "left_semi")
    ids = list(app_ids)
    if not ids:
        return df.filter(F.lit(False))
    return df.filter(F.col(column).isin(ids))


def filter_time(df: DataFrame, start=None, end=None, column: str = "timestamp") -> DataFrame:
    if start is not None:
        df = df.filter(F.col(column) >= typed_lit(df, column, start))
    if end is not None:
        df = df.filter(F.col(column) <= typed_lit(df, column, end))
    if "event_date" in df.columns:
        if start is not None:
            df = df.filter(F.col("event_date") >= F.to_date(F.lit(start).cast("timestamp_ntz")))
        if end is not None:
            df = df.filter(F.col("event_date") <= F.to_date(F.lit(end).cast("timestamp_ntz")))
    return df


def filter_event_name(df: DataFrame, event_name=None) -> DataFrame:
    if event_name:
        return df.filter(F.col("event_name") == F.lit(event_name))
    return df


def event_filter(df: DataFrame, app_ids=None, event_name=None, start=None, end=None) -> DataFrame:
    """Apply the whole contract: apps, optional event name, inclusive time range."""
    df = filter_apps(df, app_ids)
    df = filter_event_name(df, event_name)
    return filter_time(df, start, end)


def rolling_after(df: DataFrame, column: str, as_of, days: int) -> DataFrame:
    """strict rolling window ``column > as_of - days`` (plus the derived ``event_date``
    bound on the event table, so old day partitions are never read)."""
    bound = typed_lit(df, column, as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    out = df.filter(F.col(column) > bound)
    if column == "timestamp" and "event_date" in df.columns:
        out = out.filter(F.col("event_date") >= F.to_date(F.lit(as_of).cast("timestamp_ntz")
                                                         - F.expr(f"INTERVAL {int(days)} DAYS")))
    return out


def filter_url_prefix(df: DataFrame, prefix: str, column: str = "url") -> DataFrame:
    """rows whose URL starts with ``prefix`` (pushed to the Parquet scan as StringStartsWith)."""
    return df.filter(F.col(column).startswith(prefix))


def filter_metadata(df: DataFrame, key: str, value, column: str = "metadata") -> DataFrame:
    """rows whose JSON metadata has ``key`` equal to ``value`` (compared as text)."""
    return df.filter(F.get_json_object(F.col(column), f"$.{key}") == F.lit(str(value)))
