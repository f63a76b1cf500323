"""Saved batch results (JSON, schemas 1 to 6): one checked row for each, and their comparison.

Files are read and checked on the executors. Of several faulty files the first one in the caller's
order is reported. A column that a file's schema did not have yet is null.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = range(1, 7)
CODECS = ("none", "pcmu", "pcma")


class Measure(NamedTuple):
    """A number in an artifact: its section, the schema that brought it, its range, may it be null."""

    name: str
    section: str
    since: int = 1
    low: float | None = None
    high: float | None = None
    nullable: bool = False


#: In the order in which they are checked.
MEASURES = (
    Measure("packet_loss_rate", "channel", 1, 0, 1),
    Measure("gain_db", "channel", 6),
    Measure("clip_threshold", "channel", 6, nullable=True),
    Measure("additive_noise_snr_db", "channel", 2, nullable=True),
    Measure("jitter_std_ms", "channel", 3, 0, nullable=True),
    Measure("playout_buffer_ms", "channel", 3, 0, nullable=True),
    Measure("wer", "summary", 1, 0),
    Measure("cer", "summary", 1, 0),
    Measure("rtf", "summary", 1, 0),
    Measure("speed_factor", "summary", 1, 0, nullable=True),
    Measure("numeric_entity_accuracy", "summary", 4, 0, 1, nullable=True),
)
COLUMNS = "input_order int, error string, artifact string, schema_version int, adapter string, model string, codec string, {}, item_count long, fingerprint string".format(
    ", ".join(f"{m.name} double" for m in MEASURES)
)


class ArtifactError(ValueError):
    pass


def _integer(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _measure(m: Measure, section: dict) -> float | None:
    if m.name.startswith(("jitter", "playout")) and not {"jitter_std_ms", "playout_buffer_ms"} <= set(section):
        raise ArtifactError("jitter metadata requires both jitter fields")
    if m.name not in section:
        raise ArtifactError(f"{m.name} is required")
    value = section[m.name]
    if value is None and m.nullable:
        return None
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ArtifactError(f"{m.name} must be a finite number")
    if m.low is not None and value < m.low:
        raise ArtifactError(f"{m.name} must be at least {m.low:g}")
    if m.high is not None and value > m.high:
        raise ArtifactError(f"{m.name} must be at most {m.high:g}")
    if m.name == "clip_threshold" and value <= 0:
        raise ArtifactError("clip_threshold must be a positive number")
    return float(value)


def check_artifact(content: bytes) -> dict:
    """The comparison columns of one artifact; ArtifactError names the first fault."""
    try:
        root = json.loads(content.decode("utf-8"))
    except ValueError as fault:
        raise ArtifactError(f"invalid JSON: {fault}") from fault
    if not isinstance(root, dict):
        raise ArtifactError("artifact must be a JSON object")
    if (kind := root.get("kind")) in ("concurrent", "streaming"):
        raise ArtifactError(f"{kind} artifacts are not supported by batch comparison")
    version = root.get("schema_version")
    if not _integer(version) or version not in SCHEMAS:
        raise ArtifactError(f"unsupported schema_version; expected one of {', '.join(map(str, SCHEMAS))}")
    for name in ("dataset", "adapter", "channel", "summary"):
        if not isinstance(root.get(name), dict):
            raise ArtifactError(f"{name} must be an object")
    row = {"schema_version": version} | {m.name: _measure(m, root[m.section]) for m in MEASURES if version >= m.since}
    if version >= 3 and (row["jitter_std_ms"] is None) != (row["playout_buffer_ms"] is None):
        raise ArtifactError("jitter metadata must be both set or both null")
    for column, name in (("adapter", "name"), ("model", "model")):
        row[column] = root["adapter"].get(name)
        if not isinstance(row[column], str) or not row[column]:
            raise ArtifactError(f"{name} must be a non-empty string")
    row["codec"] = root["channel"].get("codec")
    if row["codec"] not in CODECS:
        raise ArtifactError(f"codec must be one of {', '.join(CODECS)}")
    row["item_count"] = root["dataset"].get("item_count")
    if not _integer(row["item_count"]) or row["item_count"] < 0:
        raise ArtifactError("item_count must be a non-negative integer")
    if version >= 5:
        row["fingerprint"] = root["dataset"].get("fingerprint")
        if not isinstance(row["fingerprint"], str) or not re.fullmatch("sha256:[0-9a-f]{64}", row["fingerprint"]):
            raise ArtifactError("dataset fingerprint must be lowercase sha256:<64 hex digits>")
    return row


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for batch in batches:
        rows = []
        for order, path, content in zip(batch["input_order"], batch["path"], batch["content"], strict=True):
            row = dict.fromkeys(names) | {"input_order": order, "artifact": path.rpartition("/")[2]}
            try:
                rows.append(row | check_artifact(bytes(content)))
            except ArtifactError as fault:
                rows.append(row | {"error": str(fault)})
        # As objects, so that nulls stay nulls.
        yield pd.DataFrame(rows, columns=names, dtype=object)


def read_artifacts(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """One row for each path, repeated ones too, with its place in `input_order` and its fault in `error`."""
    full = [p if "://" in p else "file:" + os.path.abspath(os.path.expanduser(p)) for p in map(str, paths)]
    if not full:
        return spark.createDataFrame([], COLUMNS)
    asked = spark.createDataFrame(list(enumerate(full)), "input_order int, path string")
    files = spark.read.format("binaryFile").load(sorted(set(full))).select("path", "content")
    return files.join(F.broadcast(asked), "path").mapInPandas(_checked, COLUMNS)


def compare(spark: SparkSession, paths: Iterable[str]) -> list:
    """The rows in the caller's order (a caller's list of files, so small). ArtifactError for the
    first faulty file, or where two files have known fingerprints that differ."""
    paths = list(map(str, paths))
    rows = read_artifacts(spark, paths).orderBy("input_order").collect()
    for row in rows:
        if row["error"] is not None:
            raise ArtifactError(f"{paths[row['input_order']]}: {row['error']}")
    known = [r for r in rows if r["fingerprint"] is not None]
    for row in known:
        if row["fingerprint"] != known[0]["fingerprint"]:
            raise ArtifactError(f"dataset fingerprint mismatch between {known[0]['artifact']} and {row['artifact']}")
    return rows


#: The heads of the table, and the column that each shows.
HEADS = (
    ("Artifact", "artifact"), ("Schema", "schema_version"), ("Adapter", "adapter"), ("Model", "model"), ("Codec", "codec"), ("Loss", "packet_loss_rate"),
    ("Gain dB", "gain_db"), ("Clip", "clip_threshold"), ("SNR dB", "additive_noise_snr_db"), ("Jitter ms", None), ("WER", "wer"), ("CER", "cer"),
    ("RTF", "rtf"), ("Speed", "speed_factor"), ("Numeric entity", "numeric_entity_accuracy"), ("Items", "item_count"),
)
LEFT = {"Artifact", "Adapter", "Model", "Codec", "Jitter ms"}


def _shown(value: object) -> str:
    if value is None:
        return "—"
    if isinstance(value, float):
        return f"{value:.6g}"
    return re.sub(r"\r\n|[\r\n]", "<br>", str(value)).replace("|", "\\|")


def markdown(rows: Iterable) -> str:
    """The comparison as a Markdown table."""

    def jitter(row) -> str:
        return "—" if row["jitter_std_ms"] is None else f"{_shown(row['jitter_std_ms'])}/{_shown(row['playout_buffer_ms'])}"

    table = [[h for h, _ in HEADS], ["---" if h in LEFT else "---:" for h, _ in HEADS]]
    table += [[_shown(row[c]) if c else jitter(row) for _, c in HEADS] for row in rows]
    return "\n".join(f"| {' | '.join(line)} |" for line in table)
