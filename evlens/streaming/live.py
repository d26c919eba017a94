"""Live streaming aggregates over the stored or arriving events.

T3 counts events per (event name, hour) with a watermark: a window is emitted
once the watermark passes its end (append mode), users are counted with the
approximate distinct sketch (exact distincts are not a streaming aggregate).

T4 replays the per-key hourly counter on a request stream with keyed state
(``applyInPandasWithState``): keys are dealt to groups, a group's state = (window
start, count) of each of its keys, expired by an event-time timeout; each
micro-batch sees at most its own rows of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import limits as L


def live_event_counts(events: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Per (window, event name): count and approximate distinct users."""
    ev = events.withColumn("_ts", F.col("timestamp").cast("timestamp"))
    return (ev.withWatermark("_ts", watermark)
              .groupBy(F.window("_ts", window).alias("w"), "event_name")
              .agg(F.count(F.lit(1)).alias("count"), F.approx_count_distinct("user_id").alias("approx_users"))
              .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "event_name", "count", "approx_users"))


T4_OUT = "key string, received_at timestamp, window_start timestamp, window_count long, limit_exceeded boolean"
T4_STATE = "keys array<string>, starts binary, counts binary"
OUT_ROWS = 10_000
# Groups of keys that the stateful operator is called for; fixed for the life of a checkpoint.
KEY_GROUPS = 2048
_NO_TIME = np.iinfo(np.int64).min  # NaT as a long


def _fold_group(codes: np.ndarray, t: np.ndarray, start: np.ndarray, count: np.ndarray, ttl_us: int):
    """Window start and count of each arrival, and the open window of each key: ``codes`` numbers
    the keys (sorted), ``t`` has their sorted times, ``start`` and ``count`` each key's open window."""
    # A row older than the open window counts in it, as it arrives after its start.
    seen = np.maximum(t, start[codes])
    touched = np.unique(codes)
    g, at = np.concatenate((touched, codes)), np.concatenate((start[touched], seen))
    order = np.lexsort((at, g))  # stable: a key's open window stands before its rows
    g, at, weight = g[order], at[order], np.concatenate((count[touched], np.ones(len(t), dtype=np.int64)))[order]
    # The keys are laid out on one axis, each behind the end of the one before it.
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    last = np.r_[first[1:], len(g)] - 1
    span = at[last] - at[first] + ttl_us + 1
    shift = np.repeat(np.cumsum(span) - span - at[first], last - first + 1)
    starts, counts = L.anchored_windows(at + shift, weight, ttl_us)
    starts -= shift
    start[touched], count[touched] = starts[last], counts[last]
    rows = np.ones(len(g), dtype=bool)
    rows[first] = False
    return starts[rows], counts[rows]


def _t4_update(ttl_us: int, limit: int):
    def update(group, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, start, count = state.get if state.exists else ([], b"", b"")
        start, count = np.frombuffer(start, dtype="<i8").copy(), np.frombuffer(count, dtype="<i8").copy()
        names = np.array(names, dtype=object)
        if not state.hasTimedOut:
            # The rows of one micro-batch come as several frames in no order: only their
            # keys and arrival times are gathered, sorted and folded together.
            frames = [(pdf["key"].to_numpy(dtype=object), pdf["received_at"].to_numpy().astype("datetime64[us]").astype(np.int64)) for pdf in pdfs]
            t = np.concatenate([x for _, x in frames])
            codes, names = pd.factorize(np.concatenate((names, *[k for k, _ in frames])))
            codes = codes[len(start):]
            order = np.lexsort((t, codes))
            codes, t = codes[order], t[order]
            # A key without an open window starts one at its first time.
            fresh = np.full(len(names) - len(start), np.iinfo(np.int64).max)
            timed = (codes >= len(start)) & (t != _NO_TIME)
            np.minimum.at(fresh, codes[timed] - len(start), t[timed])
            start, count = np.concatenate((start, fresh)), np.concatenate((count, np.zeros(len(fresh), dtype=np.int64)))
            counted = start[codes] != np.iinfo(np.int64).max  # else a key that has no time at all
            starts, counts = np.full(len(t), _NO_TIME), np.zeros(len(t), dtype=np.int64)
            if counted.any():
                starts[counted], counts[counted] = _fold_group(codes[counted], t[counted], start, count, ttl_us)
            for k in range(0, len(t), OUT_ROWS):
                part = slice(k, k + OUT_ROWS)
                yield pd.DataFrame({"key": names[codes[part]], "received_at": pd.to_datetime(t[part].view("M8[us]")),
                                    "window_start": pd.to_datetime(starts[part].view("M8[us]")),
                                    "window_count": counts[part],
                                    "limit_exceeded": counts[part] > limit})
        # Counters whose lifetime ended before the watermark go: no row can reach them any more.
        ends = np.where(count > 0, start // 1000 + ttl_us // 1000 + 1, 0)
        alive = ends > state.getCurrentWatermarkMs()
        if not alive.any():
            if state.exists:
                state.remove()
            return
        state.update((names[alive].tolist(), start[alive].astype("<i8").tobytes(), count[alive].astype("<i8").tobytes()))
        state.setTimeoutTimestamp(int(ends[alive].min()))
    return update


def streaming_key_counter(requests: DataFrame, key: str = "api_key", ts: str = "received_at",
                          ttl_seconds: int = L.KEY_HOUR_TTL, limit: int = L.KEY_HOUR_DEFAULT,
                          watermark: str = "2 hours", key_groups: int = KEY_GROUPS) -> DataFrame:
    """T4: the anchored per-key counter as a stateful streaming operator.

    Keys are dealt by their hash to ``key_groups`` groups; the operator is called once a group
    and micro-batch and folds all of the group's keys in one vectorised pass. Each batch's rows of
    one key are processed in order of their arrival times, however many Arrow batches they come
    in; a late row that is older than the open window counts in it; rows later than the
    watermark are dropped by Spark before the operator.
    """
    r = (requests.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("received_at"))
                 .filter(F.col("key").isNotNull())
                 .withColumn("key_group", F.pmod(F.xxhash64("key"), F.lit(int(key_groups))))
                 .withWatermark("received_at", watermark))
    return (r.groupBy("key_group")
             .applyInPandasWithState(_t4_update(int(ttl_seconds) * 1_000_000, int(limit)), T4_OUT, T4_STATE,
                                     "append", GroupStateTimeout.EventTimeTimeout))
