"""Event-time forms over streams: counts in windows and sessions with late data, and queues with state for blocking reads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, by: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(window_start, by, n) of tumbling or sliding windows; events later than the watermark are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str) -> DataFrame:
    """(session_start, session_end, by, n)."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def matched_pops(events: DataFrame) -> DataFrame:
    """(key, waiter, value) of blocking pops over a stream of events(key, kind, seq, value): a `push` waits for a `pop` or a `pop` for a push, first come first served.

    The state of a key is what still waits, on one side only.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, waiters = map(list, state.get) if state.exists else ([], [])
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for kind, value in zip(rows["kind"], rows["value"], strict=True):
            (values if kind == "push" else waiters).append(value)
            if values and waiters:
                out.append((key[0], waiters.pop(0), values.pop(0)))
        state.update((values, waiters))
        yield pd.DataFrame(out, columns=["key", "waiter", "value"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, waiter string, value string", "items array<string>, waiters array<string>", "append", GroupStateTimeout.NoTimeout)
