"""Summaries of runs: one row over all items, or one for each group; no item reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .metrics import micro_average, ratio
from .selection import join_groups, nearest_ranks


def batch_summary(items: DataFrame, *by: str) -> DataFrame:
    """items (audio_seconds, adapter_seconds, word_edits, word_units, char_edits, char_units,
    entity_matches, entity_count): the summary of a batch run."""
    audio, adapter = F.coalesce(F.sum("audio_seconds"), F.lit(0.0)), F.coalesce(F.sum("adapter_seconds"), F.lit(0.0))
    return items.groupBy(*by).agg(
        F.count("*").alias("item_count"),
        audio.alias("total_audio_seconds"),
        adapter.alias("adapter_seconds"),
        F.coalesce(ratio(adapter, audio), F.lit(0.0)).alias("rtf"),
        ratio(audio, adapter).alias("speed_factor"),
        micro_average("word_edits", "word_units").alias("wer"),
        micro_average("char_edits", "char_units").alias("cer"),
        ratio(F.sum("entity_matches"), F.sum("entity_count")).alias("numeric_entity_accuracy"),
    )


def load_summary(items: DataFrame, wall_seconds: float, *by: str) -> DataFrame:
    """items (audio_seconds, latency_seconds): the summary of a concurrent run of that length. The ranks are selected level
    by level, so items should be a stored table."""
    audio = F.coalesce(F.sum("audio_seconds"), F.lit(0.0))
    made = items.groupBy(*by).agg(
        F.count("*").alias("item_count"),
        audio.alias("total_audio_seconds"),
        F.lit(wall_seconds).alias("wall_seconds"),
        ratio(audio, F.lit(wall_seconds)).alias("audio_throughput"),
        F.max("latency_seconds").alias("latency_max"),
    )
    ranks = nearest_ranks(items, list(by), ["latency_seconds"]).withColumnsRenamed({f"latency_seconds_p{p}": f"latency_p{p}" for p in (50, 95)})
    return join_groups(made, ranks, by)


def partial_stability(updates: DataFrame, item: str = "item", seq: str = "seq") -> DataFrame:
    """updates (item, seq, text, is_final): item, stability. Between neighbouring states (partials that
    have words and differ from the one before, then the final text) 1 - word edits / longer length,
    averaged; null for an item without such a partial."""
    w = W.partitionBy(item).orderBy("is_final", seq)
    rows = updates.select(item, seq, "is_final", T.normalize_text("text").alias("normal"))
    rows = rows.where("is_final or normal <> ''").withColumn("before", F.lag("normal").over(w))
    states = rows.where("is_final or before is null or before <> normal").withColumn("before", F.lag("normal").over(w))
    a, b = T.tokens(F.col("before")), T.tokens(F.col("normal"))
    near = F.when(F.col("before").isNotNull(), 1 - T.word_edits(a, b) / F.greatest(F.size(a), F.size(b), F.lit(1)))
    return states.groupBy(item).agg(F.avg(near).alias("stability"))
