"""Exact nearest-rank percentiles by distributed selection.

Values become 64-bit keys in the same order, and the ranks wanted are looked for digit by digit, from the highest 16 bits
down: the rows of a group are counted by digit (summed in each task before the exchange), the running count says in which
digit the rank lies, and only the rows that share it go on. Once what is left of every group fits `most` rows, these are sorted
as they are. A group never needs more than 65,536 counts or `most` values in one place, however many values it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..sources.shared import discard, written

#: Bits of a digit, and how many values of a group may be sorted at once.
DIGIT, MOST = 16, 4096
#: The key of every NaN, which pandas would bring back as null.
NAN = 0x7FF8000000000000


@F.pandas_udf(LongType())
def order_key(values: pd.Series) -> pd.Series:
    """Signed 64-bit keys in the order of the doubles, NaN last, -0.0 as 0.0. No value may be null."""
    x = values.to_numpy(np.float64) + 0.0
    bits = np.where(np.isnan(x), NAN, x.view(np.int64))
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(DoubleType())
def from_order_key(keys: pd.Series) -> pd.Series:
    bits = keys.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def _above(shift: int) -> Column:
    """The bits of a key from shift up, in unsigned order; none of them from 64 up."""
    return F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), shift) if shift < 64 else F.lit(0).cast("bigint")


def nearest_ranks(rows: DataFrame, by: list[str], values: list[str], percents: tuple[int, ...] = (50, 95), most: int = MOST) -> DataFrame:
    """A row for each group of `by` (one for all rows, if that is empty): the columns <value>_p<percent>, the value at rank
    ceil(percent * n / 100) of the n that are not null, as doubles; null for a group without any. rows is read more than once,
    so it should be a stored table."""
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("v"), F.col(c).cast("double").alias("x")) for i, c in enumerate(values)]))
    keyed = rows.select(group.alias("g"), each.alias("e")).select("g", "e.v", "e.x").where("x is not null")
    keyed = written(keyed.select("g", "v", order_key("x").alias("key")))
    wanted = F.explode(F.array(*[F.lit(p) for p in percents]))
    sizes = keyed.groupBy("g", "v").agg(F.count("*").alias("n")).select("g", "v", wanted.alias("p"), "n")
    # Where each rank is: among the n rows whose keys begin with prefix, at place rank.
    found = written(sizes.select("g", "v", "p", F.lit(0).cast("bigint").alias("prefix"), F.expr("(p * n + 99) div 100").alias("rank"), "n"))
    shift, upto = 64, W.partitionBy("g", "v", "p").orderBy("next").rowsBetween(W.unboundedPreceding, 0)
    while shift and (found.agg(F.max("n")).first()[0] or 0) > most:
        live = keyed.withColumn("prefix", _above(shift)).join(found.select("g", "v", "p", "prefix"), ["g", "v", "prefix"])
        shift -= DIGIT
        counted = live.groupBy("g", "v", "p", _above(shift).alias("next")).agg(F.count("*").alias("m"))
        met = counted.join(found.select("g", "v", "p", "rank"), ["g", "v", "p"]).withColumn("upto", F.sum("m").over(upto))
        here = met.where("upto >= rank and upto - m < rank")
        before, found = found, written(here.select("g", "v", "p", F.col("next").alias("prefix"), (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"), F.col("m").alias("n")))
        discard(before)
    if shift:
        left = keyed.withColumn("prefix", _above(shift)).join(found, ["g", "v", "prefix"])
        picked = left.groupBy("g", "v", "p", "rank").agg(F.sort_array(F.collect_list("key")).alias("keys"))
        picked = picked.select("g", "v", "p", F.expr("keys[cast(rank - 1 as int)]").alias("key"))
    else:
        picked = found.select("g", "v", "p", F.col("prefix").bitwiseXOR(F.lit(-(1 << 63))).alias("key"))
    picked = picked.select("g", "v", "p", F.when(F.col("key") == NAN, F.lit(float("nan"))).otherwise(from_order_key("key")).alias("x"))
    columns = [F.max(F.when((F.col("v") == i) & (F.col("p") == p), F.col("x"))).alias(f"{c}_p{p}") for i, c in enumerate(values) for p in percents]
    groups = rows.select(group.alias("g")).distinct() if by else rows.sparkSession.range(1).select(group.alias("g"))
    out = groups.join(picked.groupBy("g").agg(*columns), "g", "left")
    return out.select(*[F.col(f"g.`{c}`").alias(c) for c in by], *[f"`{c}_p{p}`" for c in values for p in percents])


def join_groups(one: DataFrame, other: DataFrame, by: list[str] | tuple[str, ...]) -> DataFrame:
    """Rows of two frames with one row a group beside each other, null groups too; without groups, their only rows."""
    if not by:
        return one.withColumn("_", F.lit(0)).join(other.withColumn("_", F.lit(0)), "_").drop("_")
    renamed = other.withColumnsRenamed({c: f"_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return one.join(renamed, on).drop(*[f"_{c}" for c in by])
