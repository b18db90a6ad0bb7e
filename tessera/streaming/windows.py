"""Tumbling, gap-session and threshold-session windows as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.aggregates import aggregate_column


def tumbling(stream: DataFrame, time: str, size: str, keys: list[str], spec, delay: str) -> DataFrame:
    """Aggregates by key and window of ``size``; rows more than ``delay`` late are dropped, as the state must end."""
    w = F.window(time, size)
    out = stream.withWatermark(time, delay).groupBy(w, *keys).agg(*[aggregate_column(fn, c).alias(o) for o, (fn, c) in spec.items()])
    return out.select(*keys, F.col("window.start").alias("window_start"), *spec)


def gap_sessions(stream: DataFrame, time: str, gap: str, keys: list[str], spec, delay: str) -> DataFrame:
    """Aggregates by key and session; a session ends where more than ``gap`` passes."""
    w = F.session_window(time, gap)
    out = stream.withWatermark(time, delay).groupBy(w, *keys).agg(*[aggregate_column(fn, c).alias(o) for o, (fn, c) in spec.items()])
    return out.select(*keys, F.col("session_window.start").alias("session_start"), *spec)


def threshold_sessions(stream: DataFrame, key: str, value: str, time: str, threshold: int) -> DataFrame:
    """(key, time, value, session): the first time of the run of values over ``threshold`` that each row lies in.

    Rows that are not over are left out.  The state of a key is one time, or
    none, so it stays small however long the stream is.  Rows of a key must
    arrive in order across batches; within a batch they are sorted.  The time may
    be a whole number, a timestamp or a date; the session is of its kind.
    """
    kind = dict(stream.dtypes)
    there, back = {
        "timestamp": (F.unix_micros, F.timestamp_micros),
        "timestamp_ntz": (lambda c: F.unix_micros(c.cast("timestamp")), lambda c: F.timestamp_micros(c).cast("timestamp_ntz")),
        "date": (F.unix_date, F.date_from_unix_date),
    }.get(kind[time], (lambda c: c.cast("long"), lambda c: c.cast(kind[time])))

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        start = state.get[0] if state.exists else None
        sessions = []
        for t, v in zip(rows[time], rows[value], strict=True):
            start = (start if start is not None else int(t)) if v > threshold else None
            sessions.append(start)
        state.update((start,))
        found = pd.DataFrame({key: k[0], time: rows[time].to_numpy(), value: rows[value].to_numpy(), "session": pd.array(sessions, "Int64")})
        yield found.dropna(subset=["session"])

    fields = f"{key} {kind[key]}, {time} long, {value} {kind[value]}, session long"
    rows = stream.select(key, there(F.col(time)).alias(time), value)
    found = rows.groupBy(key).applyInPandasWithState(step, fields, "start long", "append", "NoTimeout")
    return found.select(key, back(F.col(time)).alias(time), value, back(F.col("session")).alias("session"))
