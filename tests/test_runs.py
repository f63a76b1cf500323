import json
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyspark import cloudpickle

from wirescore import adapters, cli
from wirescore.functions import channel
from wirescore.functions.channel import Channel, ConfigurationError
from wirescore.plans import runs, sessions
from wirescore.sources import artifacts, writers

# Tasks cannot import this file, so what it defines travels with the functions that use it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def manifest(folder, seconds=(0.5, 0.25, 1.0), rate=16000):
    lines = []
    for i, s in enumerate(seconds):
        wave = 0.4 * np.sin(2 * np.pi * (300 + 50 * i) * np.arange(int(s * rate)) / rate)
        (folder / f"clip{i}.wav").write_bytes(adapters.wav_bytes(wave, rate))
        item = {"id": f"n{i}", "audio": f"clip{i}.wav", "reference": f"audio of {round(100 * s)}" if i else "sound of 51"}
        lines.append(json.dumps(item | ({"language": "en"} if i else {})))
    path = folder / "items.jsonl"
    path.write_text("\n\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_batch_run(spark, tmp_path):
    made = runs.run_batch(spark, manifest(tmp_path), adapters.LengthAdapter, Channel(codec="pcma", gain_db=-3.0, additive_noise_snr_db=20.0, jitter_std_ms=5.0, playout_buffer_ms=30.0, packet_loss_rate=0.1, seed=4))
    got = made.read()
    assert [i["id"] for i in got["items"]] == ["n0", "n1", "n2"] and [i["language"] for i in got["items"]] == [None, "en", "en"]
    assert [i["hypothesis"] for i in got["items"]] == ["audio of 50", "audio of 25", "audio of 100"]
    assert [round(i["wer"], 6) for i in got["items"]] == [round(2 / 3, 6), 0, 0] and got["summary"]["wer"] == 2 / 9
    assert got["items"][0]["numeric_entities"]["accuracy"] == 0.0 and got["items"][1]["numeric_entities"]["accuracy"] == 1.0
    assert got["summary"]["numeric_entity_accuracy"] == pytest.approx(2 / 3) and got["summary"]["total_audio_seconds"] == pytest.approx(1.75)
    assert got["schema_version"] == 6 and got["dataset"]["item_count"] == 3 and got["dataset"]["fingerprint"].startswith("sha256:")
    assert got["channel"]["codec"] == "pcma" and got["created_at"].endswith("+00:00")
    made.write(str(tmp_path / "deep" / "out.json"))
    assert (tmp_path / "deep" / "out.json").read_text(encoding="utf-8") == json.dumps(got, indent=2, ensure_ascii=False) + "\n"
    assert artifacts.compare(spark, [str(tmp_path / "deep" / "out.json")])[0]["item_count"] == 3
    assert os.listdir(tmp_path / "deep") == ["out.json"]


def test_empty_and_wrong_manifests(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("\n")
    got = runs.run_batch(spark, str(tmp_path / "none.jsonl"), adapters.LengthAdapter)
    got.write(str(tmp_path / "none.json"))
    got = got.read()
    assert json.loads((tmp_path / "none.json").read_text()) == got
    assert got["items"] == [] and got["summary"]["wer"] == 0.0 and got["summary"]["speed_factor"] is None and got["dataset"]["item_count"] == 0
    (tmp_path / "gone.jsonl").write_text('{"id": "a", "audio": "no.wav", "reference": ""}\n')
    with pytest.raises(runs.RunError, match="gone.jsonl:1: audio file does not exist: no.wav"):
        runs.run_batch(spark, str(tmp_path / "gone.jsonl"), adapters.LengthAdapter)
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "audio": "bad.wav", "reference": ""}\n')
    with pytest.raises(runs.RunError, match="bad.jsonl:1: bad.wav: only uncompressed PCM"):
        runs.run_batch(spark, str(tmp_path / "bad.jsonl"), adapters.LengthAdapter)
    with pytest.raises(runs.RunError, match="at least one item"):
        runs.run_load(spark, str(tmp_path / "none.jsonl"), adapters.LengthAdapter, 2)


class Ticks:
    """A clock that gives the times of a script, one for each reading."""

    def __init__(self, *times):
        self.times = list(times)

    def __call__(self):
        return self.times.pop(0)


def test_load_run(spark, tmp_path):
    path = manifest(tmp_path)
    got = runs.run_load(spark, path, adapters.LengthAdapter, 2).read()
    assert [i["id"] for i in got["items"]] == ["n0", "n1", "n2"] and got["load"] == {"concurrency": 2}
    assert list(got) == ["kind", "schema_version", "created_at", "dataset", "adapter", "load", "summary", "items"]
    assert list(got["dataset"]) == ["path", "item_count", "fingerprint"] and list(got["adapter"]) == ["name", "model", "device", "compute_type", "options"]
    assert list(got["items"][0]) == ["id", "audio", "audio_seconds", "latency_seconds", "hypothesis"]
    assert got["summary"]["completed_items"] == 3 and got["summary"]["latency_max_seconds"] == max(i["latency_seconds"] for i in got["items"])
    assert got["kind"] == "concurrent" and got["schema_version"] == 1 and got["created_at"].endswith("Z")
    with pytest.raises(ConfigurationError):
        runs.run_load(spark, path, adapters.LengthAdapter, True)


def test_load_by_a_script(spark, tmp_path):
    """The wall is from the worker's first reading to its last, without what Spark takes to start."""
    path = manifest(tmp_path, (0.5, 1.0))
    got = runs.run_load(spark, path, adapters.LengthAdapter, 1, Ticks(5.0, 5.25, 5.75, 6.0, 7.0, 7.5)).read()["summary"]
    assert (got["latency_p50_seconds"], got["latency_p95_seconds"], got["latency_max_seconds"]) == (0.5, 1.0, 1.0)
    assert (got["total_wall_seconds"], got["total_audio_seconds"], got["throughput_speed_factor"]) == (2.5, 1.5, 0.6)


def slow_factory(folder, seconds=0.3, bad=()):
    """An adapter that notes when it is made and when each call begins and ends."""

    def make():
        import time
        import uuid

        class Noting(adapters.LengthAdapter):
            def transcribe(self, samples, sample_rate, language):
                n, began = len(samples), time.time()
                time.sleep(seconds)
                with open(f"{folder}/{uuid.uuid4().hex}.call", "w") as out:
                    out.write(json.dumps([id(self), os.getpid(), began, time.time(), n]))
                if n in bad:
                    raise adapters.AdapterError(f"refused {n}")
                return "x"

        return Noting()

    return make


def calls(folder):
    return [json.loads(p.read_text()) for p in folder.glob("*.call")]


def test_as_many_calls_at_once_as_asked_for(spark, tmp_path):
    (notes := tmp_path / "notes").mkdir()
    path = manifest(tmp_path, [0.1 + 0.01 * i for i in range(12)])
    got = runs.run_load(spark, path, slow_factory(str(notes), 0.5), 6).read()  # six workers in four tasks
    made = calls(notes)
    assert len(made) == 12 and len({c[4] for c in made}) == 12 and len({tuple(c[:2]) for c in made}) <= 6
    edges = sorted([(c[2], 1) for c in made] + [(c[3], -1) for c in made])
    under_way, most = 0, 0
    for _, step in edges:
        under_way += step
        most = max(most, under_way)
    assert most == 6
    assert max(c[3] for c in made) - min(c[2] for c in made) <= got["summary"]["total_wall_seconds"] < 10


def test_first_failure_of_a_load_ends_it(spark, tmp_path):
    (notes := tmp_path / "notes").mkdir()
    path = manifest(tmp_path, [0.1] * 10 + [0.2, 0.3] + [0.1] * 30)
    with pytest.raises(adapters.AdapterError, match="^refused 3200$"):
        runs.run_load(spark, path, slow_factory(str(notes), 0.1, (3200, 4800)), 2)
    assert sum(c[4] in (3200, 4800) for c in calls(notes)) in (1, 2) and len(calls(notes)) <= 13
    (once := tmp_path / "once").mkdir()
    with pytest.raises(adapters.AdapterError, match="refused"):
        runs.run_batch(spark, path, slow_factory(str(once), 0.0, (3200,)))
    assert sum(c[4] == 3200 for c in calls(once)) == 1

    def unmade():
        if os.path.exists(notes):  # made once on the driver, for its name
            raise KeyError("no model")

    with pytest.raises(KeyError):
        runs.run_load(spark, path, unmade, 2)


FILE_SUMMARY = (
    "item_count completed_items failed_items total_audio_seconds time_to_first_partial_count time_to_first_partial_p50_seconds time_to_first_partial_p95_seconds finalization_latency_p50_seconds "
    "finalization_latency_p95_seconds finalization_latency_max_seconds streaming_wall_p50_seconds streaming_wall_p95_seconds streaming_wall_max_seconds partial_stability_count partial_stability_mean"
).split()
PACED_SUMMARY = (
    "item_count completed_items failed_items total_audio_seconds time_to_first_partial_count time_to_first_partial_p50_seconds time_to_first_partial_p95_seconds audio_submitted_at_first_partial_count "
    "audio_submitted_at_first_partial_p50_seconds audio_submitted_at_first_partial_p95_seconds session_setup_p50_seconds session_setup_p95_seconds session_setup_max_seconds audio_submission_wall_p50_seconds "
    "audio_submission_wall_p95_seconds audio_submission_wall_max_seconds finalization_latency_p50_seconds finalization_latency_p95_seconds finalization_latency_max_seconds total_session_wall_p50_seconds "
    "total_session_wall_p95_seconds total_session_wall_max_seconds partial_stability_count partial_stability_mean"
).split()
HEAD = ["kind", "schema_version", "timing_mode", "created_at", "dataset", "adapter", "streaming", "summary", "items"]


class Hand:
    """A clock that stands still until it is moved; a sleeper that moves it."""

    now = 64.0

    def __call__(self):
        return self.now

    def move(self, seconds):
        self.now += seconds

    async def sleep(self, seconds):
        self.move(seconds)


class Scripted(adapters.LengthAdapter):
    """Says of each item, in turn, what a script has: pauses, partial texts and a final one."""

    def __init__(self, clock, script):
        super().__init__()
        self.clock, self.script = clock, list(script)

    def stream(self, frames, sample_rate, language):
        list(frames)
        for pause, text, final in self.script.pop(0):
            self.clock.move(pause)
            if text is not None:
                yield text, final

    async def stream_duplex(self, frames, sample_rate, language):
        it = aiter(frames)
        for pause, text, final in self.script.pop(0):
            self.clock.move(pause)
            if text == "<frame>":
                await anext(it, None)
            elif text == "<rest>":
                async for _ in it:
                    pass
            elif text is not None:
                yield text, final


def one_task(spark, run):
    """run with all items in one task, so that one clock serves them in turn."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_file_upload_by_a_script(spark, tmp_path):
    path = manifest(tmp_path, (0.5, 0.5, 0.5))
    clock = Hand()
    adapter = Scripted(clock, [[(0.25, "red", False), (0.5, "red fox", True), (0.125, None, None)], [(0.5, "so", True)], [(0.125, "  ", False), (0.125, "an ox", False), (0.25, "An ox!", True), (1.0, None, None)]])
    made = one_task(spark, lambda: runs.run_streaming(spark, path, lambda a=adapter: a, 100, clock=clock))
    got = made.read()
    made.write(str(tmp_path / "s.json"))
    assert (tmp_path / "s.json").read_text(encoding="utf-8") == json.dumps(got, indent=2, ensure_ascii=False) + "\n"
    assert list(got) == HEAD and got["schema_version"] == 1 and got["timing_mode"] == "file_upload" and got["streaming"] == {"frame_duration_ms": 100, "language_mode": "manifest"}
    assert list(got["summary"]) == FILE_SUMMARY and list(got["adapter"]) == ["name", "model", "device", "compute_type", "options"] and got["dataset"]["fingerprint"].startswith("sha256:")
    assert list(got["items"][0]) == [
        "id", "audio", "audio_seconds", "frame_count", "final_text", "partial_update_count", "time_to_first_partial_seconds", "finalization_latency_seconds", "total_streaming_wall_seconds", "partial_stability", "updates",
    ]
    pick = lambda c: [i[c] for i in got["items"]]
    assert pick("time_to_first_partial_seconds") == [0.25, None, 0.25] and pick("finalization_latency_seconds") == [0.75, 0.5, 0.5] and pick("total_streaming_wall_seconds") == [0.875, 0.5, 1.5]
    assert pick("partial_stability") == [0.5, None, 1.0] and pick("frame_count") == [5, 5, 5] and pick("partial_update_count") == [1, 0, 2]
    assert got["items"][2]["updates"] == [{"text": "  ", "is_final": False, "observed_seconds": 0.125}, {"text": "an ox", "is_final": False, "observed_seconds": 0.25}, {"text": "An ox!", "is_final": True, "observed_seconds": 0.5}]
    assert [got["summary"][c] for c in FILE_SUMMARY] == [3, 3, 0, 1.5, 2, 0.25, 0.25, 0.5, 0.75, 0.75, 0.875, 1.5, 1.5, 2, 0.75]


def test_paced_by_a_script(spark, tmp_path):
    path = manifest(tmp_path, (0.25, 0.375, 0.25))
    clock = Hand()
    script = [
        [(0.5, "<frame>", None), (0.0625, "", False), (0.0625, "aye", False), (0.0, "<rest>", None), (0.25, "aye aye", True), (0.125, None, None)],
        [(0.0, "<rest>", None), (0.5, "no", True)],
        [(0.0, "<frame>", None), (0.0, "<frame>", None), (0.125, "up", False), (0.0, "<rest>", None), (0.0, "up", True)],
    ]
    adapter = Scripted(clock, script)
    made = one_task(spark, lambda: runs.run_streaming(spark, path, lambda a=adapter: a, 125, "paced", 2.0, "autodetect", clock=clock, sleep=clock.sleep))
    got = made.read()
    made.close()
    assert list(got) == HEAD and got["schema_version"] == 2 and got["streaming"] == {"frame_duration_ms": 125, "realtime_factor": 2.0, "language_mode": "autodetect"}
    assert list(got["summary"]) == PACED_SUMMARY
    pick = lambda c: [i[c] for i in got["items"]]
    # A frame of 0.125 s takes half of that to pace; what the adapter does meanwhile moves the same clock.
    assert pick("session_setup_seconds") == [0.5, 0.0, 0.0] and pick("time_to_first_partial_seconds") == [0.125, None, 0.1875]
    assert pick("audio_submitted_seconds_at_first_partial") == [0.125, None, 0.25] and pick("audio_submission_wall_seconds") == [0.25, 0.1875, 0.25]
    assert pick("finalization_latency_seconds") == [0.25, 0.5, 0.0] and pick("total_session_wall_seconds") == [1.125, 0.6875, 0.25] and pick("partial_stability") == [0.5, None, 1.0]
    assert [u["observed_seconds"] for u in got["items"][0]["updates"]] == [0.0625, 0.125, 0.5]
    assert [got["summary"][c] for c in PACED_SUMMARY] == [3, 3, 0, 0.875, 2, 0.125, 0.1875, 2, 0.125, 0.25, 0.0, 0.5, 0.5, 0.25, 0.25, 0.25, 0.25, 0.5, 0.5, 0.6875, 1.125, 1.125, 2, 0.75]


def test_tones_make_a_run(spark, tmp_path):
    from wirescore.sources import tones

    path = tones.write_tones(tones.square_waves(spark, (500, 800), 1600), str(tmp_path / "t"))
    got = runs.run_batch(spark, path, adapters.LengthAdapter).read()
    assert [(i["id"], i["hypothesis"]) for i in got["items"]] == [("tone-500", "audio of 10"), ("tone-800", "audio of 10")]
    pcm = tones.square_waves(spark, (500,), 64).first()["pcm"]
    assert pcm == [8192] * 16 + [-8192] * 16 + [8192] * 16 + [-8192] * 16


def test_streaming_failures(spark, tmp_path):
    path = manifest(tmp_path)

    class Early(adapters.LengthAdapter):
        async def stream_duplex(self, frames, sample_rate, language):
            yield "soon", True

    with pytest.raises(runs.RunError, match="item 0: update before the first frame"):
        runs.run_streaming(spark, path, Early, 100, "paced", 50.0)

    class Broken(adapters.LengthAdapter):
        def stream(self, frames, sample_rate, language):
            yield "a", False
            raise adapters.AdapterError("gone away")

    with pytest.raises(adapters.AdapterError, match="^gone away$"):
        runs.run_streaming(spark, path, Broken, 100)

    class Plain:
        name, model, device, compute_type, decoding_options = "p", "m", "cpu", "none", {}
        takes_languages = False

    with pytest.raises(ConfigurationError, match="takes no languages"):
        runs.run_streaming(spark, path, Plain, 100)
    with pytest.raises(ConfigurationError, match="stream_duplex"):
        runs.run_streaming(spark, path, Plain, 100, "paced", language_mode="autodetect")
    for wrong in ({"factor": 2.0}, {"timing_mode": "slow"}, {"language_mode": "none"}):
        with pytest.raises(ConfigurationError):
            runs.run_streaming(spark, path, adapters.LengthAdapter, 100, **wrong)
    with pytest.raises(TypeError):
        writers.streaming_head(1, "paced", {}, {}, {}, {})


def test_sessions_share_a_task(spark, tmp_path):
    """Eight sessions of a second of audio each, all under way at once in one task, take little more than one."""
    path = manifest(tmp_path, [1.0] * 8)
    items = runs.manifest_audio(spark, path).coalesce(1)
    events = sessions.duplexed(items, adapters.LengthAdapter, 100, 1.0, True, 8)
    spans = events.groupBy("item").agg(F.min("t").alias("a"), F.max("t").alias("b")).agg(F.min("a"), F.max("b"), F.count("*")).first()
    assert spans[2] == 8 and 1.0 <= spans[1] - spans[0] < 3.0
    orders = events.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("seq", "t"))).alias("e")).collect()
    assert all([x["t"] for x in r["e"]] == sorted(x["t"] for x in r["e"]) for r in orders)


def test_commands(spark, tmp_path, capsys):
    path, out = manifest(tmp_path), str(tmp_path / "r.json")
    assert cli.main(["run", path, "--output", out, "--codec", "pcmu", "--packet-loss-rate", "0.2"]) == 0
    assert cli.main(["compare", out, out]) == 0
    assert capsys.readouterr().out.count("| r.json |") == 2
    assert cli.main(["run", path, "--output", out, "--packet-loss-rate", "0.2"]) == 2
    assert "packet loss needs a codec" in capsys.readouterr().err
    assert cli.main(["run", str(tmp_path / "missing.jsonl"), "--output", out]) == 2
    assert cli.main(["concurrent", path, "--output", str(tmp_path / "l.json"), "--concurrency", "2"]) == 0
    assert cli.main(["streaming", path, "--output", str(tmp_path / "s.json"), "--frame-duration-ms", "50"]) == 0
    assert json.loads((tmp_path / "s.json").read_text())["schema_version"] == 1
    assert cli.main(["streaming", path, "--output", str(tmp_path / "p.json"), "--timing-mode", "paced", "--realtime-factor", "40"]) == 0
    assert json.loads((tmp_path / "p.json").read_text())["timing_mode"] == "paced"
    assert cli.main(["streaming", path, "--output", str(tmp_path / "p.json"), "--realtime-factor", "40"]) == 2
    assert cli.main(["compare", str(tmp_path / "l.json")]) == 2
    assert cli.main(["run", path, "--output", out, "--adapter", "no.such:thing"]) == 2
    assert cli.main(["run", path, "--output", out, "--adapter-option", "model=tiny", "--adapter-option", "device=2"]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["adapter"] | {"compute_type": "", "decoding_options": {}} == {"name": "length", "model": "tiny", "device": 2, "compute_type": "", "decoding_options": {}}
    for option in ("colour=red", "=x", "model"):
        assert cli.main(["run", path, "--output", out, "--adapter-option", option]) == 2
    for wrong in (["--packet-loss-rate", "1.5"], ["--gain-db", "nan"], ["--clip-threshold", "0"], ["--frame-duration-ms", "0"], ["--seed", "-1"]):
        with pytest.raises(SystemExit) as end:
            cli.main(["run", path, "--output", out, *wrong])
        assert end.value.code == 2


def test_failed_write_leaves_nothing(tmp_path):
    target = tmp_path / "a.json"
    target.write_text("old")
    with pytest.raises(TypeError):
        writers.write_json({"x": object()}, str(target))
    assert target.read_text() == "old" and os.listdir(tmp_path) == ["a.json"]
    writers.write_json({"é": [1, None]}, str(target))
    assert target.read_text(encoding="utf-8") == '{\n  "é": [\n    1,\n    null\n  ]\n}\n'


def test_channel_checks():
    for wrong in ({"codec": "opus"}, {"packet_loss_rate": 0.1}, {"codec": "pcmu", "packet_loss_rate": 1.1}, {"codec": "pcmu", "jitter_std_ms": 1.0}, {"jitter_std_ms": 1.0, "playout_buffer_ms": 1.0}, {"gain_db": float("nan")}, {"clip_threshold": 0.0}, {"frame_duration_ms": 0}):
        with pytest.raises(ConfigurationError):
            Channel(**wrong)
    for samples, rate in (([], 8000), ([[0.1]], 8000), ([float("inf")], 8000), ([0.1], 0), ([0.1], True)):
        with pytest.raises(ConfigurationError):
            channel.checked(samples, rate)
    with pytest.raises(ConfigurationError):
        channel.frame_samples(22050, 3)
    with pytest.raises(ConfigurationError):
        channel.decode(b"\0", "g722")
    assert channel.frame_samples(16000, 25) == 400 and channel.realtime_factor(2) == 2.0
    with pytest.raises(ConfigurationError):
        channel.realtime_factor(True)


@pytest.mark.parametrize("codec", ["pcmu", "pcma"])
def test_codec_agrees_with_the_columns(spark, codec):
    from pyspark.sql import functions as F

    from wirescore.functions import signal as S

    x = np.linspace(-1.1, 1.1, 4001).astype(np.float32)
    frame = spark.createDataFrame([(x.tolist(),)], "v array<float>")
    code = S.mu_law(S.pcm16(F.col("v"))) if codec == "pcmu" else S.a_law(S.pcm16(F.col("v")))
    back = S.mu_law_decode if codec == "pcmu" else S.a_law_decode
    row = frame.select(code.alias("c")).select("c", back(F.col("c")).alias("d")).first()
    assert bytes(row["c"]) == channel.encode(x, codec) and np.array_equal(np.array(row["d"], np.float32), channel.decode(bytes(row["c"]), codec))
    twice = channel.encode(channel.decode(bytes(range(256)), codec), codec)
    assert sum(a != b for a, b in zip(twice, range(256))) <= 1  # minus zero has no sign


def test_channel_streams_depend_on_seed_and_item():
    x = np.sin(np.arange(8000) / 9).astype(np.float32) * 0.5
    lossy = Channel(codec="pcmu", packet_loss_rate=0.3, seed=2)
    a, rate = channel.through(x, 16000, 5, lossy)
    assert rate == 8000 and len(a) == 4000 and np.array_equal(a, channel.through(x, 16000, 5, lossy)[0])
    assert not np.array_equal(a, channel.through(x, 16000, 6, lossy)[0])
    clean, rate = channel.through(x, 16000, 5, Channel())
    assert rate == 16000 and np.array_equal(clean, x)
    late = channel.through(x, 16000, 5, Channel(codec="pcma", jitter_std_ms=10.0, playout_buffer_ms=0.0))[0]
    silent = channel.decode(b"\xd5", "pcma")[0]
    assert 0.3 < (late.reshape(-1, 160) == silent).all(1).mean() < 0.7


def test_options():
    texts = {"a=1": 1, "a=1.5": 1.5, "a=true": True, "a=yes": "yes", "a=NaN": "NaN", "a=": "", 'a="q"': '"q"', "a=x=y": "x=y", "a=null": "null"}
    assert {t: adapters.parse_option(t)[1] for t in texts} == texts


def test_protocol_pieces():
    assert adapters.base_url(" https://host:8/v1/ ") == "https://host:8/v1" and adapters.socket_url("https://host/v1", "/live") == "wss://host/v1/live"
    for wrong in ("ftp://h", "https://u:p@h", "http://h?x=1", "http://", "https://h#a"):
        with pytest.raises(ConfigurationError):
            adapters.base_url(wrong)
    assert adapters.decode_event('{"type": "x", "n": 1}') == {"type": "x", "n": 1}
    for wrong in ("[]", "{", '{"type": 1}', b"\xff"):
        with pytest.raises(adapters.AdapterError):
            adapters.decode_event(wrong)
    assert adapters.pcm16_base64([1.0, -1.0, 2.0, 0.0]) == "/38BgP9/AAA="
