"""Heads of result documents, and small JSON files written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import datetime, timezone


def write_json(payload: dict, path: str) -> None:
    """Into a temporary file beside the target, synced and then renamed; missing folders are made."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder, prefix=".", suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(payload, out, indent=2, ensure_ascii=False)
            out.write("\n")
            out.flush()
            os.fsync(out.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def now(zulu: bool = True) -> str:
    stamp = datetime.now(timezone.utc).isoformat()
    return stamp.replace("+00:00", "Z") if zulu else stamp


def batch_head(dataset: dict, adapter: dict, channel: dict, summary: dict) -> dict:
    return {"schema_version": 6, "created_at": now(False), "dataset": dataset, "adapter": adapter, "channel": channel, "summary": summary}


def concurrent_head(dataset: dict, adapter: dict, load: dict, summary: dict) -> dict:
    return {"kind": "concurrent", "schema_version": 1, "created_at": now(), "dataset": dataset, "adapter": adapter, "load": load, "summary": summary}


def streaming_head(version: int, timing_mode: str, dataset: dict, adapter: dict, streaming: dict, summary: dict) -> dict:
    """Version 1 holds file uploads only."""
    if version not in (1, 2):
        raise ValueError(f"unknown version of a streaming result: {version}")
    if version == 1 and timing_mode != "file_upload":
        raise TypeError("version 1 holds file uploads only")
    return {"kind": "streaming", "schema_version": version, "timing_mode": timing_mode, "created_at": now(), "dataset": dataset, "adapter": adapter, "streaming": streaming, "summary": summary}
