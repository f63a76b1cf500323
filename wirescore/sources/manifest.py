"""Strict reading of JSON-lines manifests: one item a line, a closed schema, order kept."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The fields of an item.
REQUIRED = ("id", "audio", "reference")
OPTIONAL = ("language",)
#: What ends a line in Python text besides CR, LF and both.
INNER_END = r"[\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _problem(value: object) -> str | None:
    if not isinstance(value, dict):
        return "manifest item must be a JSON object"
    if extra := set(value) - {*REQUIRED, *OPTIONAL}:
        return f"unknown field '{min(extra)}'"
    for field in REQUIRED:
        if field not in value:
            return f"missing required field '{field}'"
    if not isinstance(value["id"], str) or not value["id"].strip():
        return "id must be a non-empty string"
    return None


def _later_problem(value: dict) -> str | None:
    """What is checked once the id is known to be new and the audio to exist."""
    if not isinstance(value["reference"], str):
        return "reference must be a string"
    language = value.get("language", "en")
    if not isinstance(language, str) or not re.fullmatch("[a-z]{2}", language):
        return "language must be a lowercase ISO 639-1 code"
    return None


_FIELDS = ("id", "audio", "reference", "language", "early", "audio_problem", "late")


@F.pandas_udf(StructType([StructField(name, StringType()) for name in _FIELDS]))
def _parsed(lines: pd.Series) -> pd.DataFrame:
    out = []
    for line in lines:
        row = dict.fromkeys(_FIELDS)
        try:
            value = json.loads(line)
        except json.JSONDecodeError as wrong:
            row["early"] = f"invalid JSON: {wrong.msg}"
        else:
            row["early"] = _problem(value)
            if row["early"] is None:
                row["id"] = value["id"]
                if isinstance(value["audio"], str) and value["audio"].strip():
                    row["audio"] = value["audio"]
                else:
                    row["audio_problem"] = "audio must be a non-empty path string"
                row["late"] = _later_problem(value)
                if row["late"] is None:
                    row |= {"reference": value["reference"], "language": value.get("language")}
        out.append(row)
    return pd.DataFrame(out, columns=list(_FIELDS))


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^\p{IsWhite_Space}\x1c-\x1f]")


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows block, line: the lines of each block of the file, in order. Spark cuts at CR, LF and both, also across the edges of
    blocks; what else ends a line is cut here."""
    rows = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), "value")
    return rows.select("block", F.explode(F.split("value", INNER_END)).alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows line_number (from 1, blank lines counted), item_index (from 0, blank lines not), line. A first pass counts the
    lines that begin in each block of the file, sums over the blocks say where each begins, and a second pass numbers
    within the blocks as they are read: no line is moved, and only the blocks' counts meet in one place. Where another pass cuts the
    file elsewhere (the number of cores has changed), its blocks begin at known places or the run ends with an error."""
    lines = _split_lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    kept = lines.where(~_blank(F.col("line"))).withColumn("nth", F.monotonically_increasing_id())
    counts = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    filled = kept.groupBy("block").agg(F.count("*").alias("m"), F.min("nth").alias("first_item"))
    blocks = counts.join(filled, "block", "left").collect()
    rows, before, items = [], 0, 0
    for b in sorted(blocks, key=lambda b: b["block"]):
        rows.append((b["block"], before, items))
        before, items = before + b["n"], items + (b["m"] or 0)
    offsets = F.broadcast(spark.createDataFrame(rows, "block bigint, before bigint, items_before bigint"))
    # Where a partition holds several blocks, each counts from its own first line.
    own = counts.select("block", "first").join(filled.select("block", "first_item"), "block", "left")
    met = kept.join(F.broadcast(own), "block", "left").join(offsets, "block", "left")
    number = F.when(F.col("before").isNull(), F.raise_error("the blocks of the manifest have changed")).otherwise(F.col("before") + F.col("at") - F.col("first") + 1)
    return met.select(number.alias("line_number"), (F.col("items_before") + F.col("nth") - F.col("first_item")).alias("item_index"), "line")


def parse_items(lines: DataFrame, audio_files: DataFrame | None = None) -> DataFrame:
    """lines (line_number, item_index, line): their items, with problem (null if none), the first that a
    line has. audio_files (audio), where given, lists the audio that exists; without it, that
    is not checked. A repeated id is a problem of the later line."""
    rows = lines.withColumn("p", _parsed("line")).select("line_number", "item_index", "p.*")
    place = F.row_number().over(W.partitionBy("id").orderBy("line_number"))
    rows = rows.withColumn("again", F.col("id").isNotNull() & (place > 1))
    if audio_files is None:
        rows = rows.withColumn("there", F.lit(True))
    else:
        rows = rows.join(audio_files.select("audio").distinct().withColumn("there", F.lit(True)), "audio", "left")
    problem = F.coalesce(
        "early",
        F.when(F.col("again"), F.concat(F.lit("duplicate id '"), "id", F.lit("'"))),
        "audio_problem",
        F.when(F.col("there").isNull(), F.concat(F.lit("audio file does not exist: "), "audio")),
        "late",
    )
    return rows.select("line_number", "item_index", "id", "audio", "reference", "language", problem.alias("problem"))


def read_manifest(spark: SparkSession, path: str, audio_files: DataFrame | None = None) -> DataFrame:
    """The items of a manifest; a ValueError naming the first wrong line if there is one."""
    items = parse_items(numbered_lines(spark, path), audio_files)
    first = items.where("problem is not null").orderBy("line_number").select("line_number", "problem").first()
    if first:
        raise ValueError(f"{path}:{first['line_number']}: {first['problem']}")
    return items.drop("problem")
