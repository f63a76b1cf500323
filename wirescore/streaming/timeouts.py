"""Response timeouts on live event streams, by event time.

A session may take as long as it likes to send its audio; the wait begins with its final commit. Each session that waits has
one timer and one value in the state store, and both go when the answer comes or the timer fires, so what is kept is bounded by
the sessions that wait at one time. State and timers survive a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIMED_OUT = "timed out while waiting for the final text"
FOUND = "item string, committed_at timestamp, problem string"
#: The state store that timers need, and the setting that names it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Waiting(StatefulProcessor):
    def __init__(self, commit: str, done: str, timeout: timedelta):
        self.commit, self.done, self.timeout = commit, done, int(timeout.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "at bigint")

    def _wait(self, at: int) -> None:
        self.since.update((at,))
        self.handle.registerTimer(at + self.timeout)

    def _leave(self) -> None:
        self.handle.deleteTimer(self.since.get()[0] + self.timeout)
        self.since.clear()

    def _late(self, key: tuple) -> pd.DataFrame:
        return pd.DataFrame({"item": [str(key[0])], "committed_at": [pd.Timestamp(self.since.get()[0], unit="ms")], "problem": [TIMED_OUT]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [(int(t.value // 1_000_000), k) for part in rows for t, k in zip(part["ts"], part["kind"])]
        for at, kind in sorted(events):
            if kind == self.commit and not self.since.exists():
                self._wait(at)
            elif kind == self.done and self.since.exists() and at >= self.since.get()[0]:
                if at > self.since.get()[0] + self.timeout:
                    yield self._late(key)
                self._leave()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.since.exists():
            yield self._late(key)
            self.since.clear()

    def close(self) -> None:
        pass


def response_timeouts(events: DataFrame, timeout: timedelta, late: str = "10 seconds", commit: str = "commit.final", done: str = "transcription.done") -> DataFrame:
    """events (item, ts timestamp, kind), a stream: one row for each session whose answer did not come within `timeout` after its
    final commit, once the watermark has passed that time. Events that come in up to `late` after others are put in order;
    later ones are dropped. Needs the state store named in STORE."""
    rows = events.select("item", "ts", "kind").where(f"kind in ('{commit}', '{done}')").withWatermark("ts", late)
    return rows.groupBy("item").transformWithStateInPandas(_Waiting(commit, done, timeout), FOUND, "append", "eventTime")
