import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirescore.streaming import live, traces

EVENTS = "item bigint, seq bigint, kind string, t double, audio_seconds double, text string, is_final boolean"


def trace(item, *events):
    out = []
    for seq, (kind, t, *more) in enumerate(events):
        seconds = more[0] if kind == "frame" else None
        text, final = more if kind == "update" else (None, None)
        out.append((item, seq, kind, t, seconds, text, final))
    return out


GOOD = trace(1, ("start", 1.0), ("frame", 1.25, 0.1), ("update", 1.5, " ", False), ("frame", 1.75, 0.1), ("update", 2.0, "Hi", False), ("frame", 2.25, 0.05), ("input_end", 2.5), ("update", 3.0, "hi there", True), ("end", 3.5))


def test_metrics_of_one_trace(spark):
    events = spark.createDataFrame(GOOD, EVENTS)
    row = traces.with_stability(traces.item_metrics(events), events).first()
    assert (row["frame_count"], row["partial_update_count"], row["final_text"]) == (3, 2, "hi there") and row["audio_seconds"] == pytest.approx(0.25)
    assert (row["time_to_first_partial_seconds"], row["finalization_latency_seconds"], row["total_streaming_wall_seconds"]) == (1.0, 0.75, 2.5)
    assert row["partial_stability"] == 0.5
    row = traces.item_metrics(events, paced=True).first()
    assert (row["session_setup_seconds"], row["time_to_first_partial_seconds"], row["audio_submission_wall_seconds"], row["finalization_latency_seconds"], row["total_session_wall_seconds"]) == (0.25, 0.75, 1.25, 0.5, 2.5)
    assert row["audio_submitted_seconds_at_first_partial"] == pytest.approx(0.2)
    assert [r["observed_seconds"] for r in traces.observed_updates(events, True).orderBy("seq").collect()] == [0.25, 0.75, 1.75]


def test_items_without_partials_and_summaries(spark):
    quiet = trace(2, ("start", 0.0), ("frame", 0.5, 0.1), ("update", 1.0, "", True), ("end", 1.0))
    events = spark.createDataFrame(GOOD + quiet, EVENTS)
    items = traces.with_stability(traces.item_metrics(events), events)
    got = traces.summary(items).first()
    assert got["item_count"] == 2 and got["time_to_first_partial_count"] == 1 and got["time_to_first_partial_p95_seconds"] == 1.0
    assert (got["finalization_latency_p50_seconds"], got["finalization_latency_p95_seconds"], got["streaming_wall_max_seconds"], got["failed_items"]) == (0.5, 0.75, 2.5, 0)
    assert got["partial_stability_mean"] == 0.5 and got["partial_stability_count"] == 1
    none = traces.summary(traces.item_metrics(events.where("item > 9"))).first()
    assert none["item_count"] == 0 and none["total_audio_seconds"] == 0.0 and none["finalization_latency_p50_seconds"] is None


@pytest.mark.parametrize(
    ("events", "paced", "seq", "problem"),
    [
        ((("start", 0.0), ("frame", float("nan"), 1.0)), False, 1, traces.NOT_FINITE),
        ((("start", 2.0), ("frame", 1.0, 1.0)), False, 1, traces.WENT_BACK),
        ((("start", 0.0), ("update", 1.0, "a", False), ("frame", 2.0, 1.0)), True, 1, traces.EARLY_UPDATE),
        ((("start", 0.0), ("frame", 1.0, 1.0), ("update", 2.0, "a", True), ("update", 3.0, "b", True)), False, 3, traces.AFTER_FINAL),
        ((("start", 0.0), ("frame", 1.0, 1.0), ("update", 2.0, None, True)), False, 2, traces.NO_TEXT),
        ((("start", 0.0), ("frame", 1.0, 1.0), ("update", 2.0, "a", None)), False, 2, traces.NO_FLAG),
        ((("start", 0.0), ("update", 2.0, "a", True)), False, None, traces.NO_FRAME),
        ((("start", 0.0), ("frame", 2.0, 1.0)), False, None, traces.NO_FINAL),
        ((("start", 0.0), ("frame", 2.0, 1.0), ("update", 3.0, "a", True)), True, None, traces.INPUT_OPEN),
        ((("start", 0.0), ("frame", 2.0, 1.0), ("update", 3.0, "a", True), ("frame", 4.0, 1.0)), False, None, traces.NEGATIVE),
        ((("start", 0.0), ("frame", 2.0, 1.0), ("update", 3.0, "a", True), ("input_end", 4.0)), True, None, traces.NEGATIVE),
    ],
)
def test_first_breach(spark, events, paced, seq, problem):
    rows = traces.violations(spark.createDataFrame(trace(7, *events), EVENTS), paced=paced).collect()
    assert [(r["item"], r["seq"], r["problem"]) for r in rows] == [(7, seq, problem)]


def test_frames_left(spark):
    events, due = spark.createDataFrame(GOOD, EVENTS), "item bigint, frames bigint"
    assert traces.violations(events, spark.createDataFrame([(1, 3)], due), True).collect() == []
    assert traces.violations(events, spark.createDataFrame([(1, 4)], due), True).first()["problem"] == traces.FRAMES_LEFT


def test_deltas_add_up(spark):
    rows = spark.createDataFrame([(1, 2, "lo"), (1, 1, "Hel"), (1, 3, None), (2, 1, "x")], "item int, seq int, delta string")
    assert {(r["item"], r["seq"]): r["text"] for r in traces.cumulative_text(rows).collect()} == {(1, 1): "Hel", (1, 2): "Hello", (1, 3): "Hello", (2, 1): "x"}


def run_stream(spark, frame, name, checkpoint, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name)


def test_live_checks(spark, tmp_path):
    bad = trace(3, ("start", 5.0), ("frame", 4.0, 1.0), ("update", 6.0, "a", True), ("update", 7.0, "b", False))
    spark.createDataFrame(GOOD + bad, EVENTS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    got = run_stream(spark, live.live_violations(stream), "wrong_events", str(tmp_path / "c1"))
    assert sorted((r["item"], r["seq"], r["problem"]) for r in got.collect()) == [("3", 1, traces.WENT_BACK), ("3", 3, traces.AFTER_FINAL)]


def test_activity_closes_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=m), "view", 1.0) for m in (0, 1, 6, 30)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    got = run_stream(spark, live.activity(stream), "windows", str(tmp_path / "c2")).select(F.minute("start").alias("m"), "n", "total").collect()
    assert sorted(tuple(r) for r in got) == [(0, 2, 2.0), (5, 1, 1.0)]


def test_idle_state_goes(spark, tmp_path):
    """After a second without events of an item its state is gone, so that a clock that went back is a new session."""
    import time

    spark.createDataFrame(trace(4, ("start", 50.0), ("frame", 51.0, 1.0)), EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    query = live.live_violations(stream, 1000).writeStream.format("memory").queryName("idle_events").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).start()
    seen = []

    def wait(done):
        until = time.time() + 60
        while time.time() < until and not done():
            time.sleep(0.3)
            seen.extend(p for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["batchId"] not in {q["batchId"] for q in seen})
        assert done()

    try:
        wait(lambda: any(p["stateOperators"] and p["stateOperators"][0]["numRowsRemoved"] for p in seen))
        spark.createDataFrame(trace(4, ("start", 1.0), ("frame", 2.0, 1.0)), EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        wait(lambda: sum(p["numInputRows"] for p in seen) >= 4)
        assert spark.table("idle_events").count() == 0
    finally:
        query.stop()
