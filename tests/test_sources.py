import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirescore.functions import signal as S
from wirescore.operators import summaries
from wirescore.sources import manifest, wav


def wav_bytes(payload, width, channels=1):
    with wave.open(out := io.BytesIO(), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(16000)
        w.writeframes(payload)
    return out.getvalue()


def test_manifest_keeps_order_and_line_numbers(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('\n{"id":"q2","audio":"k.wav","reference":""}\n  \n{"id":"q1","audio":"m.wav","reference":"ja","language":"de"}\n', encoding="utf-8")
    rows = manifest.read_manifest(spark, str(path)).orderBy("item_index").collect()
    assert [(r["line_number"], r["item_index"], r["id"], r["reference"], r["language"]) for r in rows] == [(2, 0, "q2", "", None), (4, 1, "q1", "ja", "de")]


@pytest.fixture
def small_blocks(spark):
    """Cuts files into blocks of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def cut(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")

    yield cut
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 61, 1000])
def test_lines_are_numbered_at_every_block_size(spark, tmp_path, small_blocks, size):
    text = "one\r\n\r\ntwo\rthree\n \n\u2028four\x0bfive\x0c\x0c six\x1c\x1d\x1eseven\x85\r\r\n\nei\u2029ght é ñ\n\n\nnine\n"
    (tmp_path / "m.jsonl").write_bytes(text.encode())
    small_blocks(size)
    rows = manifest.numbered_lines(spark, str(tmp_path / "m.jsonl"))
    want = [(n, line) for n, line in enumerate(text.splitlines(), 1) if line.strip()]
    assert [tuple(r) for r in rows.orderBy("line_number").collect()] == [(n, i, line) for i, (n, line) in enumerate(want)]


def test_many_lines_in_many_blocks(spark, tmp_path, small_blocks):
    lines = [f"line {i} " + "é" * (i % 90) if i % 11 else " " for i in range(4000)]
    (tmp_path / "m.jsonl").write_text("\n".join(lines), encoding="utf-8")
    small_blocks(5000)
    rows = manifest.numbered_lines(spark, str(tmp_path / "m.jsonl"))
    assert rows.rdd.getNumPartitions() > 10
    want = [(n, line) for n, line in enumerate(lines, 1) if line.strip()]
    assert [tuple(r) for r in rows.orderBy("item_index").collect()] == [(n, i, line) for i, (n, line) in enumerate(want)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan.split("BroadcastExchange")[0]


GOOD = {"id": "a", "audio": "x.wav", "reference": "r"}


@pytest.mark.parametrize(
    ("line", "message"),
    [
        ("[]", "must be a JSON object"), ("{", "invalid JSON"), (json.dumps(GOOD | {"speaker": 1, "channel": 2}), "unknown field 'channel'"), ('{"id":"q"}', "missing required field 'audio'"),
        (json.dumps(GOOD | {"id": " "}), "id must be"), (json.dumps(GOOD), "duplicate id 'a'"), (json.dumps(GOOD | {"id": "b", "audio": 3}), "audio must be"),
        (json.dumps(GOOD | {"id": "b", "audio": "no.wav"}), "does not exist: no.wav"), (json.dumps(GOOD | {"id": "b", "reference": ["r"]}), "reference must be"),
        (json.dumps(GOOD | {"id": "b", "language": None}), "lowercase ISO"), (json.dumps(GOOD | {"id": "b", "language": "deu"}), "lowercase ISO"), (json.dumps(GOOD | {"id": "b", "language": "d\n"}), "lowercase ISO"),
    ],
)
def test_manifest_problems(spark, tmp_path, line, message):
    path = tmp_path / "m.jsonl"
    path.write_text(json.dumps(GOOD) + "\n" + line + "\n")
    with pytest.raises(ValueError, match=f":2: .*{message}"):
        manifest.read_manifest(spark, str(path), spark.createDataFrame([("x.wav",)], "audio string"))


def test_wav(spark, tmp_path):
    for width, low, top in ((1, b"\x00", b"\xff"), (2, b"\x00\x80", b"\xff\x7f"), (3, b"\x00\x00\x80", b"\xff\xff\x7f"), (4, b"\x00\x00\x00\x80", b"\xff\xff\xff\x7f")):
        (tmp_path / f"{width}.wav").write_bytes(wav_bytes(low + top, width))
    (tmp_path / "stereo.wav").write_bytes(wav_bytes(b"\0" * 8, 2, 2))
    (tmp_path / "text.wav").write_bytes(b"no sound")
    (tmp_path / "cut.wav").write_bytes(wav_bytes(b"\0" * 80, 2)[:-10])
    (tmp_path / "none.wav").write_bytes(wav_bytes(b"", 2))
    got = {r["path"].rsplit("/", 1)[1].split(".")[0]: r for r in wav.read_wav(spark, str(tmp_path)).collect()}
    for width in range(1, 5):
        scale = 1 << (8 * width - 1)
        assert got[str(width)]["samples"] == [-1.0, np.float32((scale - 1) / scale)] and got[str(width)]["sample_rate"] == 16000
    assert "mono" in got["stereo"]["problem"] and "PCM" in got["text"]["problem"] and "truncated" in got["cut"]["problem"] and "empty" in got["none"]["problem"]


def test_resampling(spark):
    t = np.arange(2200) / 16000
    tone = (0.7 * np.cos(2 * np.pi * 310 * t)).astype(np.float32)
    out = S.resampled(tone, 16000, 8000)
    assert len(out) == 1100 and np.abs(out[50:-50] - tone[::2][50:-50]).max() < 0.01
    assert len(S.resampled(tone, 11025, 8000)) == -(-2200 * 320 // 441)
    assert len(spark.createDataFrame([([0.5] * 10, 16000)], "s array<float>, r int").select(S.resample(F.col("s"), F.col("r"), 8000)).first()[0]) == 5


@pytest.mark.parametrize(
    ("partials", "final", "want"),
    [(["red green"], "Red, green.", 1.0), (["p q r", "p s r", "p s"], "p s t u", (2 / 3 + 2 / 3 + 0.5) / 3), (["so", "So?", "so it"], "so it goes", 7 / 12), ([], "y", None), (["...", ""], "y", None)],
)
def test_stability(spark, partials, final, want):
    rows = [(1, i, t, False) for i, t in enumerate(partials)] + [(1, len(partials), final, True)]
    got = summaries.partial_stability(spark.createDataFrame(rows, "item int, seq int, text string, is_final boolean")).first()["stability"]
    assert got == want or abs(got - want) < 1e-12


def test_summaries(spark):
    load = spark.createDataFrame([(4.0, 0.7), (1.0, 0.2), (3.0, 0.4)], "audio_seconds double, latency_seconds double")
    row = summaries.load_summary(load, 2.0).first()
    assert (row["item_count"], row["latency_p50"], row["latency_p95"], row["latency_max"]) == (3, 0.4, 0.7, 0.7) and row["audio_throughput"] == 4.0
    empty = spark.createDataFrame([], "audio_seconds double, adapter_seconds double, word_edits int, word_units int, char_edits int, char_units int, entity_matches int, entity_count int")
    row = summaries.batch_summary(empty).first()
    assert (row["item_count"], row["rtf"], row["speed_factor"], row["wer"], row["numeric_entity_accuracy"]) == (0, 0.0, None, 0.0, None)
