import hashlib
import json

import pytest

from wirescore.operators.fingerprint import dataset_fingerprint
from wirescore.sources.artifacts import ArtifactError, check_artifact, compare, markdown


def artifact(version=6, **changes):
    channel = {"codec": "pcmu", "packet_loss_rate": 0.1, "gain_db": 0.0, "clip_threshold": None, "additive_noise_snr_db": None, "jitter_std_ms": 5, "playout_buffer_ms": 20.0}
    summary = {"wer": 0.0, "cer": 1 / 3, "rtf": 0.25, "speed_factor": None, "numeric_entity_accuracy": None}
    made = {"schema_version": version, "dataset": {"item_count": 2, "fingerprint": "sha256:" + "a" * 64}, "adapter": {"name": "a|b", "model": "m\nn"}, "channel": channel, "summary": summary}
    for path, value in changes.items():
        section, _, name = path.partition("__")
        (made[section] if name else made).__setitem__(name or section, value)
    return made


def test_compare(spark, tmp_path):
    paths = []
    for i, made in enumerate((artifact(), artifact(1), artifact(5))):
        paths.append(tmp_path / f"r{9 - i}.json")
        paths[-1].write_text(json.dumps(made))
    rows = compare(spark, [*paths, paths[0]])
    assert [r["artifact"] for r in rows] == ["r9.json", "r8.json", "r7.json", "r9.json"]
    assert rows[1]["jitter_std_ms"] is None and rows[1]["fingerprint"] is None and rows[2]["gain_db"] is None
    lines = markdown(rows).split("\n")
    assert lines[2] == "| r9.json | 6 | a\\|b | m<br>n | pcmu | 0.1 | 0 | — | — | 5/20 | 0 | 0.333333 | 0.25 | — | — | 2 |"
    paths[2].write_text(json.dumps(artifact(5, dataset__fingerprint="sha256:" + "b" * 64)))
    with pytest.raises(ArtifactError, match="mismatch between r9.json and r7.json"):
        compare(spark, paths)
    paths[1].write_text("[]")
    with pytest.raises(ArtifactError, match="r8.json: artifact must be a JSON object"):
        compare(spark, paths)
    assert compare(spark, []) == []


@pytest.mark.parametrize(
    "change, message",
    [
        ({"kind": "streaming"}, "streaming artifacts"),
        ({"schema_version": True}, "unsupported schema_version"),
        ({"channel": []}, "channel must be an object"),
        ({"channel__packet_loss_rate": 1.5}, "packet_loss_rate must be at most 1"),
        ({"channel__clip_threshold": 0}, "clip_threshold must be a positive"),
        ({"channel__jitter_std_ms": None}, "both set or both null"),
        ({"summary__wer": float("nan")}, "wer must be a finite number"),
        ({"summary__cer": False}, "cer must be a finite number"),
        ({"dataset__fingerprint": "sha256:" + "a" * 64 + "\n"}, "dataset fingerprint must be"),
        ({"dataset__item_count": -1}, "item_count must be"),
        ({"channel__codec": "opus"}, "codec must be one of"),
    ],
)
def test_faults(change, message):
    with pytest.raises(ArtifactError, match=message):
        check_artifact(json.dumps(artifact(**change)).encode())


def test_fingerprint(spark):
    items = [(0, "é", "", None, b"x" * 300), (1, "b", "text", "en", b"")]
    want = hashlib.sha256(b"d\0" + (2).to_bytes(8, "big"))
    for _, name, reference, language, content in items:
        for part in (name.encode(), reference.encode(), b"\0" if language is None else b"\1" + language.encode(), hashlib.sha256(content).digest()):
            want.update(len(part).to_bytes(8, "big") + part)
    made = lambda rows: dataset_fingerprint(spark.createDataFrame(rows, "item_index int, id string, reference string, language string, content binary"), b"d\0")
    assert made(items[::-1]) == "sha256:" + want.hexdigest()
    assert made([(1, *items[0][1:]), (0, *items[1][1:])]) != made(items)
    assert made([]) == "sha256:" + hashlib.sha256(b"d\0" + bytes(8)).hexdigest()
