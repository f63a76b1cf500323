"""Scoring and summaries over transcripts and latencies, as plans over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def scored(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """pairs with word and character edits and units. Each text is normalised once."""
    normal = pairs.withColumn("_r", T.normalize_text(reference)).withColumn("_h", T.normalize_text(hypothesis))
    words = normal.withColumn("_rw", T.tokens(F.col("_r"))).withColumn("_hw", T.tokens(F.col("_h")))
    return words.select(
        *pairs.columns,
        T.word_edits(F.col("_rw"), F.col("_hw")).alias("word_edits"),
        F.size("_rw").alias("word_units"),
        T.character_edits(F.col("_r"), F.col("_h")).alias("char_edits"),
        F.char_length(F.replace("_r", F.lit(" "), F.lit(""))).alias("char_units"),
    )


def micro_average(edits: str, units: str) -> Column:
    return F.coalesce(F.sum(edits) / F.sum(F.greatest(F.lit(1), F.col(units))), F.lit(0.0))


def nearest_rank(value: str, percent: int) -> Column:
    """The value at rank ceil(percent * n / 100); null without values."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is 0."""
    return top / F.nullif(bottom, F.lit(0))


def adjacent_turns(conversations: DataFrame) -> DataFrame:
    """Each turn as hypothesis, against the turn before it in its conversation as reference."""
    w = W.partitionBy("conv_id").orderBy("turn")
    return conversations.select("conv_id", "turn", "role", F.lag("text").over(w).alias("reference"), F.col("text").alias("hypothesis")).where("reference is not null")


def trace(events: DataFrame, item: str, order: list[str]) -> DataFrame:
    """events with their place in the item's trace and the running value. Clocks are checked in streaming.traces."""
    w = W.partitionBy(item).orderBy(*order)
    return events.withColumn("seq", F.row_number().over(w) - 1).withColumn("running", F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)))
