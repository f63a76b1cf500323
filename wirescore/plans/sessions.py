"""Calls of transcribers in tasks: batches, bounded load, file uploads and paced full-duplex sessions.

What goes wrong in a call is a row like any other, so Spark never repeats a call on account of it, and the first failure
of a run is a minimum over rows. A task that has a failure sets a mark that all tasks look for before their next call.
"""

from __future__ import annotations

import asyncio
import queue
import threading
import time
from collections.abc import AsyncIterator, Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Adapter, AdapterError
from ..functions.channel import Channel, ConfigurationError, frame_samples, through
from ..sources.shared import Mark, written

SAID = "item_index bigint, hypothesis string, audio_seconds double, adapter_seconds double, began double, ended double, worker int, error_kind string, error string"
EVENTS = "item bigint, seq bigint, kind string, t double, audio_seconds double, text string, is_final boolean"
_SAID = [c.split(" ")[0] for c in SAID.split(", ")]
_EVENTS = [c.split(" ")[0] for c in EVENTS.split(", ")]
#: The kind of the event that ends a session in which a call failed; its text has the error's kind and message.
FAILED = "failed"
#: Seconds from the time that the last worker of a load is ready to the first call.
LEAD = 1.5


class RunError(RuntimeError):
    pass


def as_error(kind: str, message: str) -> Exception:
    """The error that a row stands for."""
    for known in (AdapterError, ConfigurationError, RunError):
        if kind == known.__name__:
            return known(message)
    return RunError(f"{kind}: {message}")


def first_failure(said: DataFrame) -> Exception | None:
    """The failure of smallest item_index among the rows of transcribed() or loaded()."""
    worst = said.where("error_kind is not null").agg(F.min_by(F.struct("error_kind", "error"), "item_index").alias("e")).first()["e"]
    return as_error(worst["error_kind"], worst["error"]) if worst else None


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns, dtype=object)


def transcribed(items: DataFrame, factory: Callable[[], Adapter], channel: Channel = Channel(), clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """items (item_index, samples, sample_rate, language): what was said of each, behind the channel; adapter_seconds is
    the call alone. One adapter serves a task. The rows are written once, so nothing that reads them calls again."""
    mark = Mark(items.sparkSession)

    def one(adapter: Adapter, row) -> tuple:
        samples, rate = through(row.samples, row.sample_rate, int(row.item_index), channel)
        began = clock()
        text = adapter.transcribe(samples, rate, row.language)
        ended = clock()
        return (row.item_index, text, len(samples) / rate, ended - began, began, ended, 0, None, None)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter = None
        for part in parts:
            for row in part.itertuples():
                if mark.seen():
                    return
                try:
                    adapter = adapter or factory()
                    yield _frame([one(adapter, row)], _SAID)
                except Exception as wrong:
                    mark.set()
                    yield _frame([(row.item_index, *[None] * 5, 0, type(wrong).__name__, str(wrong))], _SAID)
                    return

    return written(items.select("item_index", "samples", "sample_rate", "language").mapInPandas(run, SAID))


def loaded(items: DataFrame, factory: Callable[[], Adapter], concurrency: int, total: int, clock: Callable[[], float] = time.time) -> DataFrame:
    """Clean audio through exactly `concurrency` workers at a time, each with an adapter of its own: a barrier stage, so that
    all workers have their adapters before the first calls and make these at one time, with threads where a task stands for several workers. The clock is
    read on all machines, so it must be one that they share. Besides the items there is a row without item_index for each
    task, from its first reading of the clock to its last. A task that Spark starts again calls nothing: that is a failure."""
    spark = items.sparkSession
    workers = min(concurrency, total)
    tasks = min(workers, spark.sparkContext.defaultParallelism)
    shares = [workers // tasks + (i < workers % tasks) for i in range(tasks)]
    mark, begun = Mark(spark), [Mark(spark) for _ in range(tasks)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        me = context.partitionId()
        failed = lambda i, wrong: (i, *[None] * 5, me, type(wrong).__name__, str(wrong))
        again, adapters = begun[me].seen(), []
        begun[me].set()
        try:
            if again:
                raise RunError("a task of the load was lost, and calls are not made twice")
            adapters = [factory() for _ in range(shares[me])]
        except Exception as wrong:
            mark.set()
            yield _frame([failed(me, wrong)], _SAID)
        # Tasks leave a barrier up to a second apart, so they agree on when to begin.
        time.sleep(max(0.0, max(map(float, context.allGather(repr(time.time())))) + LEAD - time.time()))
        start, done, lock = clock(), queue.Queue(), threading.Lock()
        rows = (row for part in parts for row in part.itertuples())

        def work(adapter: Adapter) -> None:
            try:
                while not mark.seen():
                    with lock:
                        row = next(rows, None)
                    if row is None:
                        return
                    samples, rate = np.asarray(row.samples, np.float32), int(row.sample_rate)
                    try:
                        began = clock()
                        text = adapter.transcribe(samples, rate, row.language)
                        ended = clock()
                        done.put((row.item_index, text, len(samples) / rate, ended - began, began, ended, me, None, None))
                    except Exception as wrong:
                        mark.set()
                        done.put(failed(row.item_index, wrong))
            finally:
                done.put(None)

        with ThreadPoolExecutor(len(adapters) or 1) as pool:
            for adapter in adapters:
                pool.submit(work, adapter)
            left = len(adapters)
            while left:
                if (row := done.get()) is None:
                    left -= 1
                else:
                    yield _frame([row], _SAID)
        yield _frame([(None, None, None, None, start, clock(), me, None, None)], _SAID)

    dealt = items.select("item_index", "samples", "sample_rate", "language").repartitionById(tasks, F.pmod("item_index", F.lit(tasks)).cast("int")).sortWithinPartitions("item_index")
    return written(dealt.mapInPandas(run, SAID, barrier=True))


class _Session:
    """The events of one session."""

    def __init__(self, row, clock: Callable[[], float], frame_ms: int):
        self.item, self.clock, self.events = row.item_index, clock, []
        self.samples, self.rate = np.asarray(row.samples, np.float32), int(row.sample_rate)
        self.size = frame_samples(self.rate, frame_ms)

    def say(self, kind: str, seconds: float | None = None, text: str | None = None, final: bool | None = None) -> None:
        self.events.append((self.item, len(self.events), kind, float(self.clock()), seconds, text, final))

    def update(self, said: tuple[str, bool]) -> None:
        text, final = said
        self.say("update", None, text if isinstance(text, str) else None, final if isinstance(final, bool) else None)

    def fail(self, wrong: Exception) -> None:
        self.events.append((self.item, len(self.events), FAILED, None, None, f"{type(wrong).__name__}: {wrong}", None))

    def frames(self) -> Iterator[np.ndarray]:
        for at in range(0, len(self.samples), self.size):
            frame = self.samples[at : at + self.size]
            self.say("frame", len(frame) / self.rate)
            yield frame


def streamed(items: DataFrame, factory: Callable, frame_ms: int = 20, languages: bool = True, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """items (item_index, samples, sample_rate, language): the events of a file upload of each, written once."""
    mark = Mark(items.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter = None
        for part in parts:
            for row in part.itertuples():
                if mark.seen():
                    return
                session = _Session(row, clock, frame_ms)
                try:
                    adapter = adapter or factory()
                    session.say("start")
                    for said in adapter.stream(session.frames(), session.rate, row.language if languages else None):
                        session.update(said)
                    session.say("end")
                except Exception as wrong:
                    mark.set()
                    session.fail(wrong)
                yield _frame(session.events, _EVENTS)

    return written(items.select("item_index", "samples", "sample_rate", "language").mapInPandas(run, EVENTS))


def duplexed(items: DataFrame, factory: Callable, frame_ms: int = 20, factor: float = 1.0, languages: bool = True, sessions: int = 1, clock: Callable[[], float] = time.perf_counter, sleep: Callable = asyncio.sleep) -> DataFrame:
    """The events of a paced session of each item, written once. Frames go out on the run's own schedule, one for each length of a
    frame over the factor, while updates come in: both run on one event loop, which has up to `sessions` of a task's items under
    way, with one adapter."""
    mark = Mark(items.sparkSession)

    async def converse(adapter, row) -> list[tuple]:
        session = _Session(row, clock, frame_ms)

        async def paced() -> AsyncIterator[np.ndarray]:
            for frame in session.frames():
                yield frame
                await sleep(len(frame) / session.rate / factor)
            session.say("input_end")

        try:
            session.say("start")
            async for said in adapter.stream_duplex(paced(), session.rate, row.language if languages else None):
                session.update(said)
            session.say("end")
        except Exception as wrong:
            mark.set()
            session.fail(wrong)
        return session.events

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter, loop = None, asyncio.new_event_loop()
        try:
            for part in parts:
                rows, under_way = list(part.itertuples()), []
                while rows or under_way:
                    while rows and len(under_way) < sessions and not mark.seen():
                        row = rows.pop(0)
                        try:
                            adapter = adapter or factory()
                            if not hasattr(adapter, "stream_duplex"):
                                raise ConfigurationError("a paced run needs an adapter with stream_duplex")
                        except Exception as wrong:
                            mark.set()
                            session = _Session(row, clock, frame_ms)
                            session.fail(wrong)
                            yield _frame(session.events, _EVENTS)
                            return
                        under_way.append(loop.create_task(converse(adapter, row)))
                    if not under_way:
                        return
                    done, rest = loop.run_until_complete(asyncio.wait(under_way, return_when=asyncio.FIRST_COMPLETED))
                    under_way = list(rest)
                    for one in done:
                        yield _frame(one.result(), _EVENTS)
        finally:
            loop.close()

    return written(items.select("item_index", "samples", "sample_rate", "language").mapInPandas(run, EVENTS))


def first_breach(events: DataFrame, breaches: DataFrame) -> Exception | None:
    """The failure or the breach of contract (item, seq, problem) of the smallest item, the earlier of two of one item."""
    failed = events.where(F.col("kind") == FAILED).select("item", "seq", F.col("text").alias("problem"), F.lit(True).alias("failed"))
    every = failed.union(breaches.select("item", "seq", "problem", F.lit(False)))
    first = every.agg(F.min_by(F.struct("item", "problem", "failed"), F.struct("item", F.coalesce("seq", F.lit(1 << 62)))).alias("e")).first()["e"]
    if not first:
        return None
    if first["failed"]:
        return as_error(*first["problem"].split(": ", 1))
    return RunError(f"item {first['item']}: {first['problem']}")
