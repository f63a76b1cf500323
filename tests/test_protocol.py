import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirescore.operators.protocol import PACED_REALTIME, REALTIME, Machine, run_machine, transcripts
from wirescore.streaming import timeouts

EVENTS = "item int, seq int, kind string, text string"
GOOD = ["session.created", "session.update", "commit", "append", "append", "commit.final", "transcription.delta", "transcription.done"]


def plain(machine, events):
    state, kinds = machine.states[0], machine.kinds
    for seq, kind, text in events:
        if kind in machine.worded and text is None:
            return state, seq, "text must be a string"
        if kind in machine.fatal:
            return state, seq, "the server reported an error"
        if kind not in machine.moves[state]:
            return state, seq, f"{kind if kind in kinds else 'an unknown event'} is not allowed when {state}"
        state = machine.moves[state][kind]
    return state, None, None


def run(spark, machine, sessions, width):
    rows = [(i, *e) for i, s in enumerate(sessions) for e in s]
    random.Random(1).shuffle(rows)
    got = run_machine(spark.createDataFrame(rows, EVENTS).repartition(3), machine, F.expr(f"seq div {width}")).collect()
    assert all(r["finished"] == (r["at_seq"] is None and r["state"] == machine.end) for r in got)
    return {r["item"]: (r["state"], r["at_seq"], r["problem"]) for r in got}


@pytest.mark.parametrize("width", [1, 3, 100])
def test_every_chunking_gives_the_same(spark, width):
    rng = random.Random(7)
    text = lambda k: "t" if k in REALTIME.worded else None
    sessions = [[(n, k, text(k)) for n, k in enumerate(GOOD)]]
    for _ in range(120):
        kinds = list(GOOD)
        kinds[4:5] = ["append"] * rng.randrange(12)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(kinds))
            kinds[at : at + rng.randrange(2)] = [rng.choice([*REALTIME.kinds, "ping"])]
        sessions.append([(5 * n, k, text(k) if rng.random() < 0.97 else None) for n, k in enumerate(kinds)])
    got = run(spark, REALTIME, sessions, width)
    assert got == {i: plain(REALTIME, s) for i, s in enumerate(sessions)}
    assert got[0] == ("done", None, None) and len({r[2] for r in got.values()}) > 8


def test_paced_sessions_may_answer_early(spark):
    early = [(n, k, "x") for n, k in enumerate([*GOOD[:4], "transcription.delta", *GOOD[4:]])]
    assert run(spark, REALTIME, [early], 4)[0] == ("sending", 4, "transcription.delta is not allowed when sending")
    assert run(spark, PACED_REALTIME, [early], 4)[0] == ("done", None, None)


def test_own_machine_and_no_events(spark):
    light = Machine({"off": {"press": "on"}, "on": {"press": "off"}}, "on")
    assert run(spark, light, [[(n, "press", None) for n in range(1001)], [(0, None, None)]], 10) == {0: ("on", None, None), 1: ("off", 0, "an unknown event is not allowed when off")}
    assert run_machine(spark.createDataFrame([], EVENTS), light, F.lit(0)).count() == 0


def test_done_is_what_was_said(spark):
    rows = [(1, 2, "transcription.delta", "wor"), (1, 1, "transcription.delta", "Hello "), (1, 3, "transcription.done", "Hello, world"), (1, 4, "transcription.done", "no"), (2, 1, "transcription.delta", "a"), (3, 1, "commit", None)]
    got = {r["item"]: (r["deltas"], r["text"]) for r in transcripts(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {1: ("Hello wor", "Hello, world"), 2: ("a", None), 3: ("", None)}


def test_timeouts_after_the_final_commit(spark, tmp_path):
    """Three runs from one checkpoint: an answer in time, one too late, none at all, late rows in order and rows too late."""
    start = datetime(2024, 5, 1)
    schema = "item string, ts timestamp, kind string"
    at = lambda *rows: [(i, start + timedelta(seconds=s), k) for i, s, k in rows]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.conf.set(*timeouts.STORE)
    try:

        def feed(*rows):
            spark.createDataFrame(at(*rows), schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            found = timeouts.response_timeouts(stream, timedelta(seconds=20), "5 seconds")
            query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            assert query.awaitTermination(180)
            return sorted((r["item"], (r["committed_at"] - start).total_seconds()) for r in spark.read.parquet(out).collect())

        # a waits long before its commit, which costs nothing; b's answer overtakes its commit within the batch.
        assert feed(("a", 0, "append"), ("a", 100, "commit.final"), ("b", 103, "transcription.done"), ("b", 101, "commit.final"), ("c", 102, "commit.final"), ("d", 104, "commit.final")) == []
        # The state of the first run is there in the second: a is answered in time, c 1 s too late, d not yet due.
        assert feed(("a", 119, "transcription.done"), ("c", 123, "transcription.done"), ("x", 124, "transcription.done")) == [("c", 102.0)]
        # The watermark passes d's time; an answer that comes behind the watermark changes nothing.
        assert feed(("y", 300, "transcription.done"))[-1] in (("c", 102.0), ("d", 104.0))
        done = feed(("d", 110, "transcription.done"), ("z", 400, "transcription.done"))
        assert done == [("c", 102.0), ("d", 104.0)]
    finally:
        spark.conf.unset(timeouts.STORE[0])
