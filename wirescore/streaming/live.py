"""Contract checks and activity counts on event streams (Structured Streaming)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .traces import AFTER_FINAL, NOT_FINITE, WENT_BACK

STATE = "t double, done boolean"
FOUND = "item string, seq bigint, problem string"


def _checker(idle_ms: int | None):
    def check(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, done = state.get if state.exists else (-math.inf, False)
        out = []
        for row in pd.concat(parts).sort_values("seq").itertuples():
            t = float("nan") if row.t is None else float(row.t)
            update = row.kind == "update"
            problem = NOT_FINITE if not math.isfinite(t) else WENT_BACK if t < last else AFTER_FINAL if update and done else None
            if problem:
                out.append((str(key[0]), int(row.seq), problem))
            last = t if math.isfinite(t) else last
            done = done or bool(update and row.is_final is not None and row.is_final)
        state.update((last, done))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["item", "seq", "problem"])

    return check


def live_violations(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """events (item, seq, kind, t, is_final), a stream in order within each item: every event that breaks the contract
    as soon as it comes. What is kept for an item is two values, until nothing has come for it for idle_ms (for good without
    it; a stream with it does not end by itself, as it waits for the time to pass). Events of a batch are put in order, those of
    an earlier batch cannot be."""
    rows = events.select("item", "seq", "kind", "t", "is_final").groupBy("item")
    return rows.applyInPandasWithState(_checker(idle_ms), FOUND, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def activity(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """events (ts timestamp, event_type, value): counts and sums by type in tumbling windows; windows close once the
    watermark has passed them, later events are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")
