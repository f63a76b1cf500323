"""Runs as plans: manifest, audio, channel, adapter, scores, summary and result document.

An adapter is called once for each item, in the tasks, and what it returns is written before anything is computed from
it. A run is a Document: its head has a bounded number of fields, its items are a frame that goes to the file from the tasks.
"""

from __future__ import annotations

import asyncio
import os
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import Adapter
from ..functions import text as T
from ..functions.channel import Channel, ConfigurationError
from ..operators import metrics as M
from ..operators.fingerprint import dataset_fingerprint
from ..operators.summaries import batch_summary, load_summary
from ..sources import writers
from ..sources.documents import Document
from ..sources.manifest import numbered_lines, parse_items
from ..sources.shared import discard, filesystem, written
from ..sources.wav import audio_of
from ..streaming import traces
from .sessions import RunError, duplexed, first_breach, first_failure, loaded, streamed, transcribed

#: The use of the digest that dataset_fingerprint() makes here.
DOMAIN = b"wirescore dataset\0"


def manifest_audio(spark: SparkSession, path: str) -> DataFrame:
    """Rows item_index, id, audio, reference, language, content, sample_rate, samples of a manifest whose audio paths are
    relative to it, written once; an error that names the first wrong line, or the first file that is no audio. Files are
    looked for and read in the tasks, by the names that the manifest gives."""
    if "://" not in path:
        path = os.path.abspath(os.path.expanduser(path))
    fs, inner = filesystem(path)
    if not fs.get_file_info(inner).is_file:
        raise RunError(f"no such manifest: {path}")
    folder = os.path.dirname(path)
    items = parse_items(numbered_lines(spark, path))
    whole = F.when(F.col("audio").startswith("/") | F.col("audio").contains("://"), F.col("audio")).otherwise(F.concat(F.lit(folder + "/"), "audio"))
    met = written(audio_of(items.withColumn("path", F.when(F.col("problem").isNull() | F.col("audio").isNotNull(), whole))))
    problem = F.coalesce("problem", F.when(~F.col("there"), F.concat(F.lit("audio file does not exist: "), "audio")), F.concat("audio", F.lit(": "), "wrong"))
    first = met.select("line_number", problem.alias("problem")).where("problem is not null").agg(F.min_by(F.struct("line_number", "problem"), "line_number").alias("e")).first()["e"]
    if first:
        discard(met)
        raise RunError(f"{path}:{first['line_number']}: {first['problem']}")
    inside = F.when(F.startswith("audio", F.lit(folder + "/")), F.substring("audio", len(folder) + 2, 1 << 20)).otherwise(F.col("audio"))
    out = met.select("item_index", "id", inside.alias("audio"), "reference", "language", "content", "sample_rate", "samples")
    out._shared_path = met._shared_path
    return out


def scored_items(items: DataFrame, said: DataFrame) -> DataFrame:
    """items and what was said of them, with counts, rates and numeric entities."""
    rows = M.scored(items.select("item_index", "id", "audio", "reference", "language").join(said, "item_index"))
    rows = rows.withColumn("r", T.numeric_entities(F.col("reference"))).withColumn("h", T.numeric_entities(F.col("hypothesis")))
    canon = lambda c: F.transform(F.col(c), lambda e: e["canonical"])
    rows = rows.withColumn("entity_matches", T.lcs_length(canon("r"), canon("h"))).withColumn("entity_count", F.size("r"))
    entities = F.struct(
        F.col("r").alias("reference"), F.col("h").alias("hypothesis"), F.col("entity_matches").alias("matches"), F.col("entity_count").alias("reference_count"),
        M.ratio(F.col("entity_matches"), F.col("entity_count")).alias("accuracy"),
    )
    wer, cer = T.error_rate(F.col("word_edits"), F.col("word_units")), T.error_rate(F.col("char_edits"), F.col("char_units"))
    return rows.select("*", wer.alias("wer"), cer.alias("cer"), entities.alias("numeric_entities")).drop("r", "h")


_ITEM = ("id", "audio", "reference", "hypothesis", "language", "audio_seconds", "adapter_seconds", "wer", "cer", "numeric_entities")


#: The fields of an adapter in a result; batch results call its options by another name.
_ADAPTER = ("name", "model", "device", "compute_type")


def _about(factory: Callable[[], Adapter], options: str = "options") -> dict:
    made = factory()
    return {name: getattr(made, name) for name in _ADAPTER} | {options: dict(made.decoding_options)}


def _dataset(path: str, items: DataFrame, total: int) -> dict:
    """The data set of a result: where, how many items, and a digest of them all."""
    fingerprint = dataset_fingerprint(items.select("item_index", "id", "reference", "language", "content"), DOMAIN)
    return {"path": path if "://" in path else os.path.abspath(os.path.expanduser(path)), "item_count": total, "fingerprint": fingerprint}


def run_batch(spark: SparkSession, manifest: str, factory: Callable[[], Adapter], channel: Channel = Channel()) -> Document:
    """A batch run: a result of version 6."""
    items = manifest_audio(spark, manifest)
    about = _about(factory, "decoding_options")
    said = transcribed(items, factory, channel)
    if wrong := first_failure(said):
        raise wrong
    made = written(scored_items(items, said).withColumn("matches", F.col("entity_matches")))
    summary = batch_summary(made).first().asDict()
    counts = made.agg(F.coalesce(F.sum("entity_matches"), F.lit(0)).alias("m"), F.coalesce(F.sum("entity_count"), F.lit(0)).alias("n")).first()
    summary |= {"numeric_entity_matches": counts["m"], "numeric_entity_reference_count": counts["n"]}
    head = writers.batch_head(_dataset(manifest, items, summary.pop("item_count")), about, asdict(channel), summary)
    discard(items)
    discard(said)
    return Document(head, made.select("item_index", *_ITEM), "item_index", [made])


def run_load(spark: SparkSession, manifest: str, factory: Callable[[], Adapter], concurrency: int, clock: Callable[[], float] = time.time) -> Document:
    """Clean audio through `concurrency` workers, each with an adapter of its own; the first failure ends the run. The wall time
    is from the first worker's start, with all adapters made, to the last one's end."""
    if isinstance(concurrency, bool) or not isinstance(concurrency, int) or concurrency <= 0:
        raise ConfigurationError("concurrency must be a positive integer")
    items = manifest_audio(spark, manifest)
    total = items.count()
    if not total:
        raise RunError("a load run needs at least one item")
    about = _about(factory)
    said = loaded(items, factory, concurrency, total, clock)
    if wrong := first_failure(said):
        raise wrong
    span = said.where("item_index is null").agg(F.min("began").alias("a"), F.max("ended").alias("b")).first()
    wall = span["b"] - span["a"]
    calls = said.where("item_index is not null").withColumnRenamed("adapter_seconds", "latency_seconds")
    made = written(items.select("item_index", "id", "audio").join(calls, "item_index").select("item_index", "id", "audio", "audio_seconds", "latency_seconds", "hypothesis"))
    row = load_summary(made, wall).first()
    if row["item_count"] != total:
        raise RunError("the run ended without all items")
    summary = {
        "item_count": total, "completed_items": total, "failed_items": 0, "total_audio_seconds": row["total_audio_seconds"], "total_wall_seconds": wall,
        "throughput_speed_factor": row["audio_throughput"], "latency_p50_seconds": row["latency_p50"], "latency_p95_seconds": row["latency_p95"], "latency_max_seconds": row["latency_max"],
    }
    head = writers.concurrent_head(_dataset(manifest, items, total), about, {"concurrency": concurrency}, summary)
    discard(items)
    discard(said)
    return Document(head, made, "item_index", [made])


def run_streaming(
    spark: SparkSession, manifest: str, factory: Callable, frame_ms: int = 20, timing_mode: str = "file_upload", factor: float | None = None, language_mode: str = "manifest",
    version: int | None = None, sessions: int = 1, clock: Callable[[], float] = time.perf_counter, sleep: Callable = asyncio.sleep,
) -> Document:
    """A streaming run over a manifest, as a result of version 1 (file uploads, unless 2 is asked for) or 2 (paced, by default
    in real time). The first failure or breach of the contract, by item, is an error. An adapter that says
    takes_languages = False refuses a manifest with language tags before any call, unless they are to be ignored."""
    if timing_mode not in ("file_upload", "paced"):
        raise ConfigurationError(f"unknown timing mode: {timing_mode}")
    if language_mode not in ("manifest", "autodetect"):
        raise ConfigurationError(f"unknown language mode: {language_mode}")
    paced = timing_mode == "paced"
    if factor is not None and not paced:
        raise ConfigurationError("a realtime factor is for paced runs only")
    items = manifest_audio(spark, manifest)
    total, tagged = items.agg(F.count("*"), F.count("language")).first()
    if not total:
        raise RunError("a streaming run needs at least one item")
    made = factory()
    if tagged and language_mode == "manifest" and not getattr(made, "takes_languages", True):
        raise ConfigurationError(f"{made.name} takes no languages, and the manifest has tags; the language mode autodetect ignores them")
    languages = language_mode == "manifest"
    if paced:
        factor = 1.0 if factor is None else factor
        events = duplexed(items, factory, frame_ms, factor, languages, sessions, clock, sleep)
    else:
        events = streamed(items, factory, frame_ms, languages, clock)
    due = items.select(F.col("item_index").alias("item"), F.ceil(F.size("samples") / (F.col("sample_rate") * frame_ms / 1000)).cast("bigint").alias("frames"))
    if wrong := first_breach(events, traces.violations(events.where("kind <> 'failed'"), due, paced)):
        raise wrong
    metrics = written(traces.with_stability(traces.item_metrics(events, paced), events))
    summary = traces.summary(metrics, paced).first().asDict()
    rows = items.select(F.col("item_index").alias("item"), "id", "audio").join(metrics, "item").join(traces.update_lists(events, paced), "item", "left")
    rows = written(rows.withColumn("updates", F.coalesce("updates", F.array().cast(rows.schema["updates"].dataType))))
    how = {"frame_duration_ms": frame_ms} | ({"realtime_factor": factor} if paced else {}) | {"language_mode": language_mode}
    version = version or (2 if paced else 1)
    about = {name: getattr(made, name) for name in _ADAPTER} | {"options": dict(made.decoding_options)}
    head = writers.streaming_head(version, timing_mode, _dataset(manifest, items, total), about, how, summary)
    for gone in (items, events, metrics):
        discard(gone)
    return Document(head, rows, "item", [rows])
