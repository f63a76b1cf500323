"""Metrics of streaming runs as plans over their events.

A trace has rows item, seq, kind, t, audio_seconds, text, is_final. Kinds are `start`, `frame` (with the
seconds of audio in it), `input_end` (paced runs only), `update` (with text and is_final) and `end`. One
aggregation per item makes the metrics, so a trace is shuffled once, by item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.selection import join_groups, nearest_ranks
from ..operators.summaries import partial_stability

#: What breaks the contract of a streaming run, in the order of precedence within one event.
NOT_FINITE = "clock must return a finite number"
WENT_BACK = "clock must be monotonic"
EARLY_UPDATE = "update before the first frame was submitted"
AFTER_FINAL = "update after the final update"
NO_TEXT = "update text must be a string"
NO_FLAG = "update is_final must be a bool"
FRAMES_LEFT = "every frame must be consumed"
INPUT_OPEN = "input must be exhausted"
NO_FINAL = "there must be exactly one final update"
NO_FRAME = "no frame was submitted"
NEGATIVE = "durations must not be negative"


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _when(kind: str, value: str = "t") -> Column:
    return F.when(_is(kind), F.col(value))


def item_metrics(events: DataFrame, paced: bool = False) -> DataFrame:
    """One row an item: counts, audio seconds, final text and, by the mode, the times of the run in seconds.
    A time is null where one of its ends is missing. The first partial that counts has more than white space."""
    w = W.partitionBy("item").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("submitted", F.sum(F.when(_is("frame"), F.col("audio_seconds"))).over(w))
    spoken = _is("update") & ~F.col("is_final") & F.col("text").rlike(r"[^\p{IsWhite_Space}\x1c-\x1f]")
    first = F.min_by(F.struct("t", "submitted"), F.when(spoken, F.col("seq")))
    final = _is("update") & F.col("is_final")
    made = rows.groupBy("item").agg(
        F.count(_when("frame", "seq")).alias("frame_count"),
        F.coalesce(F.sum(_when("frame", "audio_seconds")), F.lit(0.0)).alias("audio_seconds"),
        F.min_by("text", F.when(final, F.col("seq"))).alias("final_text"),
        F.count(F.when(_is("update") & ~F.col("is_final"), 1)).alias("partial_update_count"),
        first.alias("first"),
        F.min(_when("start")).alias("start"),
        F.min(_when("frame")).alias("first_frame"),
        F.max(_when("frame")).alias("last_frame"),
        F.max(_when("input_end")).alias("input_end"),
        F.min(F.when(final, F.col("t"))).alias("final"),
        F.max(_when("end")).alias("end"),
    )
    common = ["item", "audio_seconds", "frame_count", "final_text", "partial_update_count"]
    span = lambda a, b: F.col(a) - F.col(b)
    if not paced:
        return made.select(
            *common,
            span("first.t", "start").alias("time_to_first_partial_seconds"),
            span("final", "last_frame").alias("finalization_latency_seconds"),
            span("end", "start").alias("total_streaming_wall_seconds"),
        )
    return made.select(
        *common,
        span("first_frame", "start").alias("session_setup_seconds"),
        span("first.t", "first_frame").alias("time_to_first_partial_seconds"),
        F.col("first.submitted").alias("audio_submitted_seconds_at_first_partial"),
        span("input_end", "first_frame").alias("audio_submission_wall_seconds"),
        span("final", "input_end").alias("finalization_latency_seconds"),
        span("end", "start").alias("total_session_wall_seconds"),
    )


def with_stability(metrics: DataFrame, events: DataFrame) -> DataFrame:
    """metrics and partial_stability, null for an item without a partial that has words."""
    updates = events.where(_is("update"))
    return metrics.join(partial_stability(updates, "item", "seq").withColumnRenamed("stability", "partial_stability"), "item", "left")


def observed_updates(events: DataFrame, paced: bool = False) -> DataFrame:
    """The updates with observed_seconds since the start, or since the first frame of a paced run."""
    origin = F.min(_when("frame" if paced else "start")).over(W.partitionBy("item"))
    rows = events.withColumn("observed_seconds", F.col("t") - origin).where(_is("update"))
    return rows.select("item", "seq", "text", "is_final", "observed_seconds")


def violations(events: DataFrame, expected: DataFrame | None = None, paced: bool = False) -> DataFrame:
    """Rows item, seq, problem: the first breach of the contract of each item that has one. Breaches of the whole
    run (frames left, input open, no final update) come after all events, with a null seq. expected (item,
    frames), where given, is what each item should have submitted."""
    w = W.partitionBy("item").orderBy("seq")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    update = _is("update")
    finite = F.col("t").isNotNull() & ~F.isnan("t") & (F.abs(F.col("t")) != F.lit(float("inf")))
    marked = events.withColumn("back", F.col("t") < F.lag("t").over(w)).withColumn("done", F.max(update & F.col("is_final")).over(before)).withColumn("began", F.max(_is("frame")).over(before))
    early = F.lit(paced) & update & ~F.coalesce("began", F.lit(False))
    problem = F.coalesce(
        F.when(~finite, NOT_FINITE),
        F.when(F.col("back"), WENT_BACK),
        F.when(early, EARLY_UPDATE),
        F.when(update & F.col("done"), AFTER_FINAL),
        F.when(update & F.col("text").isNull(), NO_TEXT),
        F.when(update & F.col("is_final").isNull(), NO_FLAG),
    )
    runs = marked.withColumn("problem", problem).groupBy("item").agg(
        F.min_by(F.struct("seq", "problem"), F.when(F.col("problem").isNotNull(), F.col("seq"))).alias("first"),
        F.count(_when("frame", "seq")).alias("frames"),
        F.max(_is("input_end")).alias("closed"),
        F.coalesce(F.max(update & F.col("is_final")), F.lit(False)).alias("final"),
        F.min(F.when(update & F.col("is_final"), F.col("t"))).alias("final_t"),
        F.max(_when("input_end" if paced else "frame")).alias("input_t"),
    )
    runs = runs.withColumn("left", F.lit(False)) if expected is None else runs.join(expected.select("item", F.col("frames").alias("due")), "item", "left").withColumn("left", F.coalesce(F.col("due") != F.col("frames"), F.lit(False)))
    whole = F.coalesce(
        F.when(F.col("left"), FRAMES_LEFT),
        F.when(F.lit(paced) & ~F.col("closed"), INPUT_OPEN),
        F.when(F.col("frames") == 0, NO_FRAME),
        F.when(~F.col("final"), NO_FINAL),
        F.when(F.col("final_t") < F.col("input_t"), NEGATIVE),
    )
    return runs.select("item", F.col("first.seq").alias("seq"), F.coalesce("first.problem", whole).alias("problem")).where("problem is not null")


#: Fixed values, in the order of a result: (column, stem in the summary, greatest wanted, contributors wanted).
_FILE = (
    ("time_to_first_partial_seconds", "time_to_first_partial", False, True),
    ("finalization_latency_seconds", "finalization_latency", True, False),
    ("total_streaming_wall_seconds", "streaming_wall", True, False),
)
_PACED = (
    ("time_to_first_partial_seconds", "time_to_first_partial", False, True),
    ("audio_submitted_seconds_at_first_partial", "audio_submitted_at_first_partial", False, True),
    ("session_setup_seconds", "session_setup", True, False),
    ("audio_submission_wall_seconds", "audio_submission_wall", True, False),
    ("finalization_latency_seconds", "finalization_latency", True, False),
    ("total_session_wall_seconds", "total_session_wall", True, False),
)


def summary(items: DataFrame, paced: bool = False, *by: str) -> DataFrame:
    """One row over all items (or each group): counts, audio seconds, nearest-rank p50 and p95 of each time, the greatest of
    times that every item has, for the others how many items have one, and the mean stability. The ranks are selected
    level by level, so items should be a written table."""
    kept = _PACED if paced else _FILE
    aggregates = [F.count("*").alias("item_count"), F.count("*").alias("completed_items"), F.lit(0).cast("bigint").alias("failed_items"), F.coalesce(F.sum("audio_seconds"), F.lit(0.0)).alias("total_audio_seconds")]
    order = ["item_count", "completed_items", "failed_items", "total_audio_seconds"]
    for column, stem, greatest, contributors in kept:
        aggregates += [F.count(column).alias(f"{stem}_count")] if contributors else []
        aggregates += [F.max(column).alias(f"{stem}_max_seconds")] if greatest else []
        order += [f"{stem}_count"] * contributors + [f"{stem}_p50_seconds", f"{stem}_p95_seconds"] + [f"{stem}_max_seconds"] * greatest
    if "partial_stability" in items.columns:
        aggregates += [F.count("partial_stability").alias("partial_stability_count"), F.avg("partial_stability").alias("partial_stability_mean")]
        order += ["partial_stability_count", "partial_stability_mean"]
    ranks = nearest_ranks(items, list(by), [column for column, *_ in kept])
    ranks = ranks.withColumnsRenamed({f"{column}_p{p}": f"{stem}_p{p}_seconds" for column, stem, *_ in kept for p in (50, 95)})
    made = items.groupBy(*by).agg(*aggregates)
    return join_groups(made, ranks, by).select(*by, *order)


def update_lists(events: DataFrame, paced: bool = False) -> DataFrame:
    """Rows item, updates: the text, is_final and observed_seconds of the updates of each item, in order."""
    rows = observed_updates(events, paced)
    lists = rows.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("seq", "text", "is_final", "observed_seconds"))).alias("u"))
    return lists.select("item", F.transform("u", lambda x: F.struct(*[x[c].alias(c) for c in ("text", "is_final", "observed_seconds")])).alias("updates"))


def cumulative_text(deltas: DataFrame, item: str = "item", seq: str = "seq", delta: str = "delta") -> DataFrame:
    """deltas with text, all deltas of the item up to and with this one; a null delta adds nothing."""
    w = W.partitionBy(item).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    return deltas.withColumn("text", F.array_join(F.collect_list(F.col(delta)).over(w), ""))
