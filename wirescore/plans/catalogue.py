"""Registry of the library's own queries and their SQL twins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import channel
from ..functions import signal as S
from ..functions import streams
from ..functions import text as T
from ..operators import metrics as M
from ..operators import summaries
from ..operators.fingerprint import item_bytes
from ..operators.protocol import Machine, run_machine
from ..operators.selection import join_groups, nearest_ranks
from ..sources.manifest import parse_items
from ..sources.shared import written
from ..streaming import traces


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scored(M.adjacent_turns(table(spark, sf_dir, "conversations")))


def normalize_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_text("text").alias("normal"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(T.normalize_text("text"))).cast("bigint").alias("n_words"))


def wer_adjacent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    return rows.select("conv_id", "turn", "word_edits", "word_units", F.round(T.error_rate(F.col("word_edits"), F.col("word_units")), 9).alias("wer"))


def cer_adjacent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    return rows.select("conv_id", "turn", "char_edits", "char_units", F.round(T.error_rate(F.col("char_edits"), F.col("char_units")), 9).alias("cer"))


def wer_corpus_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n_items"), F.round(M.micro_average("word_edits", "word_units"), 9).alias("wer"), F.round(M.micro_average("char_edits", "char_units"), 9).alias("cer"))


def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.numeric_entities(F.col("text"))).alias("place", "e"))
    return rows.select("doc_id", F.col("place").cast("bigint").alias("place"), "e.canonical", "e.kind")


def entity_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = M.adjacent_turns(table(spark, sf_dir, "conversations"))
    canon = lambda c: F.transform(T.numeric_entities(F.col(c)), lambda e: e["canonical"])
    rows = turns.select("conv_id", "turn", canon("reference").alias("r"), canon("hypothesis").alias("h"))
    scored = rows.select("conv_id", "turn", F.size("r").alias("n_reference"), T.lcs_length(F.col("r"), F.col("h")).alias("n_matches"))
    return scored.withColumn("accuracy", M.ratio(F.col("n_matches"), F.col("n_reference")))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "value")
    rows = events.groupBy("event_type").agg(F.count("value").alias("n"), F.max("value").alias("most"))
    ranks = nearest_ranks(events, ["event_type"], ["value"]).withColumnsRenamed({"value_p50": "p50", "value_p95": "p95"})
    return join_groups(rows, ranks, ["event_type"]).select("event_type", "n", "p50", "p95", "most")


def nullable_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("metric", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_items"), F.count("metric").alias("n_metric"), M.nearest_rank("metric", 50).alias("p50"), F.round(F.avg("metric"), 6).alias("mean"))


def ratio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("double")).alias("a"), F.sum(F.col("l_discount").cast("double")).alias("b"))
    return rows.select("l_returnflag", "l_linestatus", F.round(F.coalesce(M.ratio(F.col("b"), F.col("a")), F.lit(0.0)), 9).alias("rtf"), F.round(M.ratio(F.col("a"), F.col("b")), 4).alias("speed_factor"))


def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.trace(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return rows.select("event_id", F.col("seq").cast("bigint").alias("seq"), F.round("running", 4).alias("running"))


def first_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).where("n > 1")


def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


def gain_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(S.gain_and_clip(F.col("embedding"), 6.0, 0.25)).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))


def pcm16_mu_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", S.pcm16(F.col("embedding")).alias("p"))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip("p", S.mu_law(F.col("p")).alias("m"))).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("bigint").alias("i"), F.col("x.p").alias("pcm"), F.col("x.m").alias("mu"))


def pcma_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", S.a_law(S.pcm16(F.col("embedding"))).alias("c"))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip("c", S.a_law_decode(F.col("c")).alias("d"))).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("bigint").alias("i"), F.col("x.c").alias("code"), F.rint(F.col("x.d").cast("double") * 32768).cast("int").alias("pcm"))


def resample_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(S.resample(F.col("embedding"), F.lit(16000), S.TELEPHONE_RATE)).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("bigint").alias("i"), (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"))


def resample_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 11,025 Hz, as a join: the plan for signals too long for one task."""
    samples = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode("embedding").alias("k", "x"))
    return S.resampled_table(samples, 11025, S.TELEPHONE_RATE, "vec_id").select("vec_id", "i", (F.round("x", 5) + 0.0).alias("x"))


def partial_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as partial transcripts, its last turn as the final one."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))).alias("is_final"))
    return summaries.partial_stability(rows, "conv_id", "turn").select("conv_id", F.round("stability", 9).alias("stability"))


def load_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.lit(1.0).alias("audio_seconds"), F.col("value").alias("latency_seconds"))
    return summaries.load_summary(rows, 60.0, "event_type")


def fingerprint_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document adds to a fingerprint, as a digest; its source stands in for the audio."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("reference"), F.col("lang").alias("language"), F.coalesce("source", F.lit("")).cast("binary").alias("content"))
    return item_bytes(rows, "doc_id").select("doc_id", F.sha2("bytes", 256).alias("digest"))


def frame_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(S.frames(F.col("embedding"), 20)).alias("frame", "x"))
    return rows.select("vec_id", F.col("frame").cast("bigint").alias("frame"), F.size("x").cast("bigint").alias("n"))


def signal_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.rms(F.col("embedding")), 6).alias("rms"))


def channel_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", S.additive_noise(F.col("embedding"), F.col("vec_id"), 10.0).alias("noisy"))


def channel_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", S.mu_law(S.pcm16(F.col("embedding"))).alias("codes"))
    made = S.lossy_channel(rows, "vec_id", "codes", "pcmu", 0.2, 10.0, 15.0, 1)
    return made.select("vec_id", F.hex("payload").alias("payload"))


def loss_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 2 ms of each vector as mu-law codes, a fifth of them lost, all in columns."""
    codes = table(spark, sf_dir, "embeddings").select("vec_id", S.mu_law(S.pcm16(F.col("embedding"))).alias("codes"))
    n = F.ceil(F.size("codes") / F.lit(16.0)).cast("int")
    seed = streams.seed_words([F.lit(3), F.col("vec_id")], 1)[0]
    rows = codes.select("vec_id", F.posexplode(streams.uniforms(seed, n)).alias("frame", "u"))
    return rows.select("vec_id", F.col("frame").cast("bigint").alias("frame"), "u", (F.col("u") < 0.2).alias("lost"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as a trace: event types stand for kinds, the value for seconds of audio, props for text."""
    kinds = F.create_map(*[F.lit(x) for pair in (("signup", "start"), ("view", "frame"), ("error", "end"), ("click", "update"), ("purchase", "update")) for x in pair])
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item"), seq.cast("bigint").alias("seq"), kinds[F.col("event_type")].alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.col("value").alias("audio_seconds"), F.col("props").alias("text"), (F.col("event_type") == "purchase").alias("is_final"),
    )


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(c, 5).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


def stream_file_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(traces.item_metrics(_traces(spark, sf_dir)))


def stream_paced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(traces.item_metrics(_paced_traces(spark, sf_dir), paced=True))


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(traces.summary(written(traces.item_metrics(_traces(spark, sf_dir)))))


def _paced_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, of paced runs: what ended a session ends its input."""
    return _traces(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "end", "input_end").otherwise(F.col("kind")))


def stream_paced_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For even and odd users."""
    items = written(traces.item_metrics(_paced_traces(spark, sf_dir), paced=True).withColumn("odd", F.col("item") % 2))
    return _rounded(traces.summary(items, True, "odd"))


def stream_update_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updates of each user as a result has them, as one digest: text, is_final and when, in microseconds."""
    rows = traces.update_lists(_traces(spark, sf_dir))
    said = F.transform("updates", lambda u: F.concat_ws("|", u["text"], u["is_final"].cast("string"), F.coalesce(F.round(u["observed_seconds"] * 1e6).cast("bigint").cast("string"), F.lit("-"))))
    return rows.select("item", F.size("updates").cast("bigint").alias("n"), F.sha2(F.array_join(said, ";"), 256).alias("digest"))


def stream_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(traces.observed_updates(_traces(spark, sf_dir)).select("item", "seq", "is_final", "observed_seconds"))


def stream_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of event_id the clock goes back; every fourth user has no other breach than its own."""
    rows = _traces(spark, sf_dir).withColumn("t", F.when(F.col("item") % 4 == 1, -F.col("t")).otherwise(F.col("t")))
    return traces.violations(rows, paced=True)


def cumulative_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("delta"))
    return traces.cumulative_text(rows, "conv_id", "turn").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))


def batch_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a batch run, of adjacent turns: a tenth of a second of audio and a hundredth of a second of work a letter."""
    turns = M.adjacent_turns(table(spark, sf_dir, "conversations"))
    n = F.char_length("hypothesis").cast("double")
    canon = lambda c: F.transform(T.numeric_entities(F.col(c)), lambda e: e["canonical"])
    rows = M.scored(turns.withColumn("audio_seconds", n / 10).withColumn("adapter_seconds", n / 100))
    rows = rows.withColumn("r", canon("reference")).withColumn("entity_matches", T.lcs_length(F.col("r"), canon("hypothesis"))).withColumn("entity_count", F.size("r"))
    made = summaries.batch_summary(rows, "role")
    return made.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in made.dtypes])


def channel_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain, clipping and a mu-law trip without loss, all in one pass over the samples."""
    chain = channel.Channel(codec="pcmu", gain_db=6.0, clip_threshold=0.25)

    def run(parts):
        for part in parts:
            pcm = [np.rint(channel.through(v, 8000, int(i), chain)[0].astype(np.float64) * 32768).astype(np.int64) for i, v in zip(part["vec_id"], part["embedding"])]
            yield pd.DataFrame({"vec_id": part["vec_id"], "pcm": pcm})

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, pcm array<bigint>")
    return rows.select("vec_id", F.posexplode("pcm").alias("i", "pcm")).withColumn("i", F.col("i").cast("bigint"))


#: What the events of a user may do, in the order of their log.
SHOP = Machine({"new": {"view": "new", "signup": "open"}, "open": {"view": "open", "click": "open", "error": "open", "purchase": "paid"}, "paid": {"view": "paid", "signup": "open"}}, "paid")


def protocol_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user that the machine above does not allow; chunks are a thousand events of the log."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("text"))
    return run_machine(rows, SHOP, F.expr("seq div 1000"))


def manifest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as lines of a manifest, with ids that come round, sources as audio and one source without a file."""
    docs = table(spark, sf_dir, "documents")
    item = F.to_json(F.struct(F.concat(F.lit("d"), F.col("doc_id") % 900).alias("id"), F.col("source").alias("audio"), F.coalesce("text", F.lit("")).alias("reference"), F.col("lang").alias("language")))
    lines = docs.select((F.col("doc_id") + 1).alias("line_number"), F.col("doc_id").alias("item_index"), item.alias("line"))
    there = docs.select(F.col("source").alias("audio")).where(F.col("source") != docs.agg(F.min("source")).first()[0])
    rows = parse_items(lines, there)
    return rows.select("line_number", "id", "audio", F.sha2("reference", 256).alias("reference"), "language", "problem")


_NORMAL = r"trim(regexp_replace(replace(lower({0}),'ß','ss'),'[\p{{P}}\p{{S}}\s]+',' ','g'))"

_SQL = {
    "normalize_text_rows": f"SELECT conv_id, turn, {_NORMAL.format('text')} AS normal FROM conversations",
    "word_counts": f"SELECT doc_id, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END AS n_words FROM (SELECT doc_id, {_NORMAL.format('text')} AS n FROM documents)",
    "latency_percentiles": "SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1",
    "nullable_metrics": "SELECT user_id, count(*) AS n_items, count(m) AS n_metric, quantile_disc(m, 0.5) AS p50, round(avg(m), 6) AS mean FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS m FROM events) GROUP BY 1",
    "ratio_metrics": "SELECT l_returnflag, l_linestatus, round(coalesce(b / nullif(a, 0), 0), 9) AS rtf, round(a / nullif(b, 0), 4) AS speed_factor FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity::DOUBLE) AS a, sum(l_discount::DOUBLE) AS b FROM lineitem GROUP BY 1, 2)",
    "running_total": "SELECT event_id, row_number() OVER w - 1 AS seq, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "first_event_per_user": "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1",
    "duplicate_ids": "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "missing_labels": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "gain_clip": "SELECT vec_id, i, round(least(greatest(x::DOUBLE * power(10, 0.3), -0.25), 0.25)::FLOAT::DOUBLE, 5) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)",
    "pcm16_mu_law": """
        WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
        q AS (SELECT vec_id, i, least(greatest(round_even(least(greatest(x, -1), 1) * 32768, 0), -32768), 32767)::INT AS pcm FROM p),
        m AS (SELECT *, least(4 * abs(pcm >> 2), 32635) + 132 AS m FROM q),
        s AS (SELECT *, (m > 255)::INT + (m > 511)::INT + (m > 1023)::INT + (m > 2047)::INT + (m > 4095)::INT + (m > 8191)::INT + (m > 16383)::INT AS s FROM m)
        SELECT vec_id, i, pcm, xor(s * 16 + ((m >> (s + 3)) & 15), CASE WHEN pcm < 0 THEN 127 ELSE 255 END) AS mu FROM s""",
    "pcma_round_trip": """
        WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
        q AS (SELECT vec_id, i, least(greatest(round_even(least(greatest(x, -1), 1) * 32768, 0), -32768), 32767)::INT AS pcm FROM p),
        m AS (SELECT vec_id, i, pcm, CASE WHEN pcm < 0 THEN -(pcm >> 3) - 1 ELSE pcm >> 3 END AS m FROM q),
        s AS (SELECT *, (m > 31)::INT + (m > 63)::INT + (m > 127)::INT + (m > 255)::INT + (m > 511)::INT + (m > 1023)::INT + (m > 2047)::INT AS s FROM m),
        c AS (SELECT *, s * 16 + ((m >> greatest(s, 1)) & 15) AS c FROM s)
        SELECT vec_id, i, xor(c, CASE WHEN pcm < 0 THEN 85 ELSE 213 END) AS code,
               (CASE WHEN pcm < 0 THEN -1 ELSE 1 END) * (CASE WHEN s = 0 THEN 16 * (c & 15) + 8 ELSE (16 * (c & 15) + 264) << (s - 1) END) AS pcm FROM c""",
    "load_by_type": "SELECT event_type, count(*) AS item_count, count(*)::DOUBLE AS total_audio_seconds, 60.0::DOUBLE AS wall_seconds, count(*) / 60.0::DOUBLE AS audio_throughput, quantile_disc(value, 0.5) AS latency_p50, quantile_disc(value, 0.95) AS latency_p95, max(value) AS latency_max FROM events GROUP BY 1",
    "fingerprint_items": """
        WITH b AS (SELECT doc_id, encode(doc_id::VARCHAR) AS i, encode(coalesce(text, '')) AS t,
                          CASE WHEN lang IS NULL THEN unhex('00') ELSE unhex('01') || encode(lang) END AS l, unhex(sha256(coalesce(source, ''))) AS a FROM documents)
        SELECT doc_id, sha256(unhex(concat(printf('%016x', octet_length(i)), hex(i), printf('%016x', octet_length(t)), hex(t), printf('%016x', octet_length(l)), hex(l), printf('%016x', octet_length(a)), hex(a)))) AS digest FROM b""",
    "frame_split": "SELECT vec_id, f AS frame, least(20, len(embedding) - 20 * f) AS n FROM (SELECT vec_id, embedding, unnest(range((len(embedding) + 19) // 20)) AS f FROM embeddings)",
    "signal_rms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms FROM embeddings",
}


#: Word and list distances as recursive tables: row i of the table of distances follows from row i - 1; t is the row
#: before the steps to the right, which a running least (or greatest) adds.
_EDITS = """
        {name}(k, i, r, a, b) AS (
            SELECT k, 0, range(len(b) + 1), a, b FROM {pairs}
            UNION ALL
            SELECT k, i + 1, list_transform(range(len(b) + 1), lambda j: j + list_min(list_transform(range(j + 1), lambda m: t[m + 1] - m))), a, b
            FROM (SELECT *, list_transform(range(len(b) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(r[j + 1] + 1, r[j] + (a[i + 1] <> b[j])::INT) END) AS t FROM {name} WHERE i < len(a)))"""
_COMMON = """
        {name}(k, i, r, a, b) AS (
            SELECT k, 0, list_transform(range(len(b) + 1), lambda j: 0), a, b FROM {pairs}
            UNION ALL
            SELECT k, i + 1, list_transform(range(len(b) + 1), lambda j: list_max(t[1:j + 1])), a, b
            FROM (SELECT *, list_transform(range(len(b) + 1), lambda j: CASE WHEN j > 0 AND a[i + 1] = b[j] THEN r[j] + 1 ELSE r[j + 1] END) AS t FROM {name} WHERE i < len(a)))"""
_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
#: DuckDB counts edits in bytes; normalised text has no capitals or signs, so these stand for the other letters.
_ASCII = "translate(replace({0}, ' ', ''), 'äöüéèêàçñáíóúôûîùïëâœæìòõãåøåý', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ[]^{{}}')"
_TURNS = f"""turns AS (
            SELECT conv_id, turn, role, {_NORMAL.format('prior')} AS rn, {_NORMAL.format('text')} AS hn
            FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations) WHERE prior IS NOT NULL),
        pairs AS (SELECT (conv_id, turn) AS k, {_WORDS.format('rn')} AS a, {_WORDS.format('hn')} AS b FROM turns)"""
_SCORED = f"""WITH RECURSIVE {_TURNS}, {_EDITS.format(name='dp', pairs='pairs')},
        scored AS (
            SELECT conv_id, turn, role, r[len(b) + 1] AS word_edits, len(a) AS word_units, levenshtein({_ASCII.format('rn')}, {_ASCII.format('hn')}) AS char_edits, length(replace(rn, ' ', '')) AS char_units
            FROM turns JOIN dp ON k = (conv_id, turn) AND i = len(a))"""
#: Without lookaround, each sign stands twice, so that it can end one match and begin the next.
_ENTITIES = r"""regexp_extract_all(regexp_replace({0}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])(\+?(?:[0-9][\s\p{{Z}}\x{{1c}}-\x{{1f}}()\-]*){{6,}}[0-9]|[0-9]+)(?:[^\p{{L}}\p{{N}}_]|$)', 1)"""
_CANON = "list_transform({0}, lambda s: regexp_replace(s, '[^0-9+]', '', 'g'))"

_SQL |= {
    "wer_adjacent_turns": f"{_SCORED} SELECT conv_id, turn, word_edits::INT AS word_edits, word_units::INT AS word_units, round(word_edits / greatest(1, word_units), 9) AS wer FROM scored",
    "cer_adjacent_turns": f"{_SCORED} SELECT conv_id, turn, char_edits::INT AS char_edits, char_units::INT AS char_units, round(char_edits / greatest(1, char_units), 9) AS cer FROM scored",
    "wer_corpus_by_role": f"""{_SCORED} SELECT role, count(*) AS n_items, round(sum(word_edits) / sum(greatest(1, word_units)), 9) AS wer, round(sum(char_edits) / sum(greatest(1, char_units)), 9) AS cer
        FROM scored GROUP BY role""",
    "entity_extract": f"""
        SELECT doc_id, place, canonical, CASE WHEN length(replace(canonical, '+', '')) >= 7 THEN 'phone' ELSE 'number' END AS kind
        FROM (SELECT doc_id, unnest(c) AS canonical, generate_subscripts(c, 1) - 1 AS place FROM (SELECT doc_id, {_CANON.format(_ENTITIES.format('text'))} AS c FROM documents))""",
    "entity_preservation": f"""WITH RECURSIVE pairs AS (
            SELECT (conv_id, turn) AS k, {_CANON.format(_ENTITIES.format('prior'))} AS a, {_CANON.format(_ENTITIES.format('text'))} AS b
            FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations) WHERE prior IS NOT NULL), {_COMMON.format(name='dp', pairs='pairs')}
        SELECT c.conv_id, c.turn, len(a)::INT AS n_reference, r[len(b) + 1]::INT AS n_matches, r[len(b) + 1] / nullif(len(a), 0) AS accuracy
        FROM dp JOIN conversations c ON k = (c.conv_id, c.turn) WHERE i = len(a)""",
    "partial_stability": f"""WITH RECURSIVE said AS (
            SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS is_final, {_NORMAL.format('text')} AS n FROM conversations),
        spoken AS (SELECT *, lag(n) OVER (PARTITION BY conv_id ORDER BY is_final, turn) AS before FROM said WHERE is_final OR n <> ''),
        states AS (SELECT conv_id, turn, n, lag(n) OVER (PARTITION BY conv_id ORDER BY is_final, turn) AS before FROM spoken WHERE is_final OR before IS NULL OR before <> n),
        pairs AS (SELECT (conv_id, turn) AS k, {_WORDS.format('before')} AS a, {_WORDS.format('n')} AS b FROM states WHERE before IS NOT NULL), {_EDITS.format(name='dp', pairs='pairs')},
        near AS (SELECT k, 1 - r[len(b) + 1] / greatest(len(a), len(b), 1) AS near FROM dp WHERE i = len(a))
        SELECT conv_id, round(avg(near), 9) AS stability FROM states LEFT JOIN near ON k = (conv_id, turn) GROUP BY conv_id""",
}

_TRACES = """tr AS (
            SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) / 1e6 AS t, value AS audio_seconds, props AS text, event_type = 'purchase' AS is_final,
                   CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'frame' WHEN 'error' THEN 'end' ELSE 'update' END AS kind
            FROM events),
        su AS (SELECT *, sum(CASE WHEN kind = 'frame' THEN audio_seconds END) OVER (PARTITION BY item ORDER BY seq) AS submitted, kind = 'update' AND NOT is_final AND trim(text) <> '' AS spoken FROM tr),
        it AS (
            SELECT item, count(*) FILTER (kind = 'frame') AS frame_count, coalesce(sum(audio_seconds) FILTER (kind = 'frame'), 0) AS audio_seconds, arg_min(text, seq) FILTER (kind = 'update' AND is_final) AS final_text,
                   count(*) FILTER (kind = 'update' AND NOT is_final) AS partial_update_count, arg_min(t, seq) FILTER (spoken) AS first_t, arg_min_null(submitted, seq) FILTER (spoken) AS first_s,
                   min(t) FILTER (kind = 'start') AS s, min(t) FILTER (kind = 'frame') AS f, max(t) FILTER (kind = 'frame') AS l, min(t) FILTER (kind = 'update' AND is_final) AS d, max(t) FILTER (kind = 'end') AS e
            FROM su GROUP BY item),
        fi AS (SELECT item, frame_count, round(audio_seconds, 5) AS audio_seconds, final_text, partial_update_count, round(first_t - s, 5) AS time_to_first_partial_seconds,
                      round(d - l, 5) AS finalization_latency_seconds, round(e - s, 5) AS total_streaming_wall_seconds FROM it)"""

#: The taps by their definition: a sinc under a Kaiser window, whose Bessel function is summed as a series.
_LOW_PASS = """w AS (SELECT o, o / greatest({up}, {down})::DOUBLE AS z FROM (SELECT unnest(range(-10 * greatest({up}, {down}), 10 * greatest({up}, {down}) + 1)) AS o)),
        b AS (SELECT o, CASE WHEN z = 0 THEN 1 ELSE sin(pi() * z) / (pi() * z) END * list_sum([power(power(6.25 * (1 - power(z / 10, 2)), k) / power(factorial(k::INT)::DOUBLE, 2), 1) FOR k IN range(0, 25)]) AS t FROM w),
        lp AS (SELECT o, {up} * t / (SELECT sum(t) FROM b) AS tap FROM b)"""

_SQL |= {
    "resample_half": f"""WITH {_LOW_PASS.format(up=1, down=2)}
        SELECT vec_id, i, round(CAST(sum(s * tap) AS FLOAT)::DOUBLE, 5) + 0.0::DOUBLE AS x
        FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS s, len(embedding) AS n FROM embeddings), lp
        JOIN (SELECT unnest(range(100)) AS i) ON 2 * i - k BETWEEN -20 AND 20 AND o = 2 * i - k WHERE i < (n + 1) // 2 GROUP BY vec_id, i""",
    "resample_by_table": f"""WITH {_LOW_PASS.format(up=320, down=441)}
        SELECT vec_id, i, round(sum(s * tap), 5) + 0.0::DOUBLE AS x
        FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS s, len(embedding) AS n FROM embeddings)
        JOIN (SELECT unnest(range(100)) AS i) ON i * 441 - k * 320 BETWEEN -4410 AND 4410 JOIN lp ON o = i * 441 - k * 320 WHERE i < (n * 320 + 440) // 441 GROUP BY vec_id, i""",
    "stream_file_items": f"WITH {_TRACES} SELECT * FROM fi",
    "stream_paced_items": f"""WITH {_TRACES} SELECT item, frame_count, round(audio_seconds, 5) AS audio_seconds, final_text, partial_update_count, round(f - s, 5) AS session_setup_seconds,
        round(first_t - f, 5) AS time_to_first_partial_seconds, round(first_s, 5) AS audio_submitted_seconds_at_first_partial, round(e - f, 5) AS audio_submission_wall_seconds,
        round(d - e, 5) AS finalization_latency_seconds, NULL::DOUBLE AS total_session_wall_seconds FROM it""",
    "stream_summary": f"""WITH {_TRACES} SELECT count(*) AS item_count, count(*) AS completed_items, 0::BIGINT AS failed_items, round(sum(audio_seconds), 5) AS total_audio_seconds,
        count(time_to_first_partial_seconds) AS time_to_first_partial_count, quantile_disc(time_to_first_partial_seconds, 0.5) AS time_to_first_partial_p50_seconds,
        quantile_disc(time_to_first_partial_seconds, 0.95) AS time_to_first_partial_p95_seconds,
        quantile_disc(finalization_latency_seconds, 0.5) AS finalization_latency_p50_seconds, quantile_disc(finalization_latency_seconds, 0.95) AS finalization_latency_p95_seconds, max(finalization_latency_seconds) AS finalization_latency_max_seconds,
        quantile_disc(total_streaming_wall_seconds, 0.5) AS streaming_wall_p50_seconds, quantile_disc(total_streaming_wall_seconds, 0.95) AS streaming_wall_p95_seconds, max(total_streaming_wall_seconds) AS streaming_wall_max_seconds FROM fi""",
    "stream_paced_summary": f"""WITH {_TRACES}, pa AS (SELECT item % 2 AS odd, audio_seconds, f - s AS a, first_t - f AS b, first_s AS c, e - f AS d, d - e AS g FROM it)
        SELECT odd, count(*) AS item_count, count(*) AS completed_items, 0::BIGINT AS failed_items, round(sum(audio_seconds), 5) AS total_audio_seconds,
        count(b) AS time_to_first_partial_count, round(quantile_disc(b, 0.5), 5) AS time_to_first_partial_p50_seconds, round(quantile_disc(b, 0.95), 5) AS time_to_first_partial_p95_seconds,
        count(c) AS audio_submitted_at_first_partial_count, round(quantile_disc(c, 0.5), 5) AS audio_submitted_at_first_partial_p50_seconds, round(quantile_disc(c, 0.95), 5) AS audio_submitted_at_first_partial_p95_seconds,
        round(quantile_disc(a, 0.5), 5) AS session_setup_p50_seconds, round(quantile_disc(a, 0.95), 5) AS session_setup_p95_seconds, round(max(a), 5) AS session_setup_max_seconds,
        round(quantile_disc(d, 0.5), 5) AS audio_submission_wall_p50_seconds, round(quantile_disc(d, 0.95), 5) AS audio_submission_wall_p95_seconds, round(max(d), 5) AS audio_submission_wall_max_seconds,
        round(quantile_disc(g, 0.5), 5) AS finalization_latency_p50_seconds, round(quantile_disc(g, 0.95), 5) AS finalization_latency_p95_seconds, round(max(g), 5) AS finalization_latency_max_seconds,
        NULL::DOUBLE AS total_session_wall_p50_seconds, NULL::DOUBLE AS total_session_wall_p95_seconds, NULL::DOUBLE AS total_session_wall_max_seconds FROM pa GROUP BY odd""",
    "stream_update_lists": f"""WITH {_TRACES}, ob AS (SELECT item, seq, text, is_final, t - min(CASE WHEN kind = 'start' THEN t END) OVER (PARTITION BY item) AS o FROM tr QUALIFY kind = 'update')
        SELECT item, count(*) AS n, sha256(string_agg(concat_ws('|', text, is_final::VARCHAR, coalesce(round(o * 1000000)::BIGINT::VARCHAR, '-')), ';' ORDER BY seq)) AS digest FROM ob GROUP BY item""",
    "protocol_sessions": """WITH RECURSIVE m(state, kind, next) AS (VALUES ('new', 'view', 'new'), ('new', 'signup', 'open'), ('open', 'view', 'open'), ('open', 'click', 'open'), ('open', 'error', 'open'),
            ('open', 'purchase', 'paid'), ('paid', 'view', 'paid'), ('paid', 'signup', 'open')),
        e AS (SELECT user_id AS item, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        w(item, rn, state, at_seq, k) AS (
            SELECT DISTINCT item, 0::BIGINT, 'new', NULL::BIGINT, NULL::VARCHAR FROM e
            UNION ALL
            SELECT w.item, e.rn, CASE WHEN w.at_seq IS NULL THEN coalesce(m.next, w.state) ELSE w.state END, CASE WHEN w.at_seq IS NULL AND m.next IS NULL THEN e.event_id ELSE w.at_seq END,
                   CASE WHEN w.at_seq IS NULL AND m.next IS NULL THEN e.event_type ELSE w.k END
            FROM w JOIN e ON e.item = w.item AND e.rn = w.rn + 1 LEFT JOIN m ON m.state = w.state AND m.kind = e.event_type)
        SELECT w.item, e.n AS n_events, state, at_seq, k || ' is not allowed when ' || state AS problem, at_seq IS NULL AND state = 'paid' AS finished FROM w JOIN e ON e.item = w.item AND e.rn = w.rn WHERE w.rn = e.n""",
    "manifest_items": """WITH i AS (SELECT doc_id + 1 AS line_number, 'd' || (doc_id % 900) AS id, source AS audio, coalesce(text, '') AS t, lang FROM documents),
        p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY line_number) > 1 THEN concat('duplicate id ', chr(39), id, chr(39))
                             WHEN audio = (SELECT min(source) FROM documents) THEN 'audio file does not exist: ' || audio END AS problem FROM i)
        SELECT line_number, id, audio, sha256(t) AS reference, lang AS language, problem FROM p""",
    "stream_observed": f"WITH {_TRACES} SELECT item, seq, is_final, round(t - min(CASE WHEN kind = 'start' THEN t END) OVER (PARTITION BY item), 5) AS observed_seconds FROM tr QUALIFY kind = 'update'",
    "stream_violations": f"""WITH {_TRACES}, ne AS (SELECT item, seq, kind, text, is_final, CASE WHEN item % 4 = 1 THEN -t ELSE t END AS t FROM tr),
        w AS (SELECT *, t < lag(t) OVER (PARTITION BY item ORDER BY seq) AS back, kind = 'update' AS u, max((kind = 'update' AND is_final)::INT) OVER b AS done, max((kind = 'frame')::INT) OVER b AS began
              FROM ne WINDOW b AS (PARTITION BY item ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        p AS (SELECT *, CASE WHEN back THEN 'clock must be monotonic' WHEN u AND coalesce(began, 0) = 0 THEN 'update before the first frame was submitted'
                             WHEN u AND done = 1 THEN 'update after the final update' WHEN u AND text IS NULL THEN 'update text must be a string' END AS problem FROM w),
        g AS (SELECT item, min(seq) FILTER (problem IS NOT NULL) AS seq, arg_min(problem, seq) FILTER (problem IS NOT NULL) AS problem FROM p GROUP BY item)
        SELECT item, seq, coalesce(problem, 'input must be exhausted') AS problem FROM g""",
    "cumulative_turns": "SELECT conv_id, turn, sha256(string_agg(text, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn)) AS digest FROM conversations",
    "batch_by_role": f"""{_SCORED}, ents AS (
            SELECT (conv_id, turn) AS k, role, length(text) AS n, {_CANON.format(_ENTITIES.format('prior'))} AS a, {_CANON.format(_ENTITIES.format('text'))} AS b
            FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations) WHERE prior IS NOT NULL), {_COMMON.format(name='lc', pairs='ents')},
        found AS (SELECT k, r[len(b) + 1] AS m, len(a) AS c FROM lc WHERE i = len(a))
        SELECT s.role, count(*) AS item_count, round(sum(n / 10), 6) AS total_audio_seconds, round(sum(n / 100), 6) AS adapter_seconds, round(sum(n / 100) / sum(n / 10), 6) AS rtf, round(sum(n / 10) / sum(n / 100), 6) AS speed_factor,
               round(sum(word_edits) / sum(greatest(1, word_units)), 6) AS wer, round(sum(char_edits) / sum(greatest(1, char_units)), 6) AS cer, round(sum(m) / nullif(sum(c), 0), 6) AS numeric_entity_accuracy
        FROM scored s JOIN ents ON ents.k = (s.conv_id, s.turn) JOIN found ON found.k = ents.k GROUP BY s.role""",
    "channel_chain": """
        WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, least(greatest(unnest(embedding)::DOUBLE * power(10, 0.3), -0.25), 0.25)::FLOAT::DOUBLE AS x FROM embeddings),
        q AS (SELECT vec_id, i, least(greatest(round_even(least(greatest(x, -1), 1) * 32768, 0), -32768), 32767)::INT AS pcm FROM p),
        m AS (SELECT *, least(4 * abs(pcm >> 2), 32635) + 132 AS m FROM q),
        s AS (SELECT *, (m > 255)::INT + (m > 511)::INT + (m > 1023)::INT + (m > 2047)::INT + (m > 4095)::INT + (m > 8191)::INT + (m > 16383)::INT AS s FROM m)
        SELECT vec_id, i, (CASE WHEN pcm < 0 THEN -1 ELSE 1 END) * (((((m >> (s + 3)) & 15) * 8 + 132) << s) - 132)::BIGINT AS pcm FROM s""",
}


def _seed_sequence(name: str, source: str, words: list[str], n: int) -> str:
    """CTEs that end in `name`: the rows of source with g0, g1, .., the words of the seed sequence of `words`."""
    w, steps, at = streams.WORD, [], 0

    def cte(select: str) -> None:
        nonlocal at
        steps.append(f"{name}_{at} AS (SELECT {select} FROM {f'{name}_{at - 1}' if at else source})")
        at += 1

    def hashed(x: str, before: int, after: int, name: str) -> str:
        return f"(xor({x}, {before}::UBIGINT) * {after}::UBIGINT) & {w}::UBIGINT AS {name}"

    start = streams.hash_constants(streams.INIT_A, streams.MULT_A, 4)
    cte("*, " + ", ".join(hashed(f"({words[i] if i < len(words) else 0})::UBIGINT", *start[i], f"p{i}") for i in range(4)))
    fold = lambda c: f"xor({c}, {c} >> 16) AS {c}"
    cte("* REPLACE (" + ", ".join(fold(f"p{i}") for i in range(4)) + ")")
    for i, j, before, after in streams.pool_steps():
        cte(f"*, {hashed(f'p{i}', before, after, 'h')}")
        cte(f"* EXCLUDE (h) REPLACE ((((p{j} * {streams.MIX_L}::UBIGINT) & {w}::UBIGINT) + {w + 1}::UBIGINT - ((xor(h, h >> 16) * {streams.MIX_R}::UBIGINT) & {w}::UBIGINT)) & {w}::UBIGINT AS p{j})")
        cte(f"* REPLACE ({fold(f'p{j}')})")
    cte("* EXCLUDE (p0, p1, p2, p3), " + ", ".join(hashed(f"p{k % 4}", *c, f"g{k}") for k, c in enumerate(streams.hash_constants(streams.INIT_B, streams.MULT_B, n))))
    steps.append(f"{name} AS (SELECT * REPLACE ({', '.join(fold(f'g{k}') for k in range(n))}) FROM {name}_{at - 1})")
    return ",\n".join(steps)


def _loss_sql() -> str:
    """The same stream with numbers of 128 bits: s is the state and c its increment, as halves of 64 bits."""
    low = "18446744073709551615::HUGEINT"
    m = streams.limbs(streams.MULTIPLIER)

    def product(k: int) -> str:  # the k-th limb of state * multiplier + increment, not yet carried
        limb = lambda x, i: f"(({x}{'l' if i < 4 else 'h'} >> {16 * (i % 4)}) & 65535)"
        return "(" + " + ".join([limb("c", k)] + [f"{limb('s', i)} * {m[k - i]}" for i in range(k + 1)]) + ")"

    half = lambda a: " + ".join(f"({product(a + k)} << {16 * k})" for k in range(4))
    move = lambda rest, source: f"SELECT {rest}, cl, ch, lo & {low} AS sl, (hi + (lo >> 64)) & {low} AS sh FROM (SELECT *, {half(0)} AS lo, {half(4)} AS hi FROM {source})"
    pair = lambda a, b: f"(g{b}::HUGEINT << 32) + g{a}::HUGEINT"
    return f"""WITH RECURSIVE v AS (SELECT vec_id, (len(embedding) + 15) // 16 AS n FROM embeddings),
        {_seed_sequence("a", "v", ["3", "vec_id"], 1)},
        b0 AS (SELECT vec_id, n, g0 AS seed FROM a),
        {_seed_sequence("b", "b0", ["seed"], 8)},
        i0 AS (SELECT vec_id, n, {pair(0, 1)} AS th, {pair(2, 3)} AS tl, {pair(4, 5)} AS qh, {pair(6, 7)} AS ql FROM b),
        i1 AS (SELECT vec_id, n, tl, th, ((ql << 1) & {low}) + 1 AS cl, ((qh << 1) & {low}) + (ql >> 63) AS ch FROM i0),
        i2 AS (SELECT vec_id, n, cl, ch, (cl + tl) & {low} AS sl, (ch + th + ((cl + tl) >> 64)) & {low} AS sh FROM i1),
        d(vec_id, n, k, cl, ch, sl, sh) AS (
            {move("vec_id, n, 0::BIGINT AS k", "i2")}
            UNION ALL
            {move("vec_id, n, k + 1 AS k", "(SELECT * FROM d WHERE k < n)")}),
        x AS (SELECT vec_id, k - 1 AS frame, xor(sl, sh) AS x, (sh >> 58)::INT AS t FROM d WHERE k > 0),
        u AS (SELECT vec_id, frame, ((((x >> t) | (x << ((64 - t) % 64))) & {low}) >> 11)::DOUBLE / 9007199254740992::DOUBLE AS u FROM x)
        SELECT vec_id, frame, u, u < 0.2 AS lost FROM u"""


_SQL["loss_frames"] = _loss_sql()


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            normalize_text_rows, word_counts, wer_adjacent_turns, cer_adjacent_turns, wer_corpus_by_role, entity_extract, entity_preservation, latency_percentiles, nullable_metrics, ratio_metrics,
            running_total, first_event_per_user, duplicate_ids, missing_labels, gain_clip, pcm16_mu_law, pcma_round_trip, resample_half, partial_stability, load_by_type, fingerprint_items, frame_split, resample_by_table, signal_rms, channel_noise, channel_loss, loss_frames,
            stream_file_items, stream_paced_items, stream_summary, stream_paced_summary, stream_update_lists, stream_observed, stream_violations, cumulative_turns, batch_by_role, channel_chain,
            protocol_sessions, manifest_items,
        )
    }


def oracle_sql() -> dict:
    return dict(_SQL)
