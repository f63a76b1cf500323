"""The boundary to transcribers, and the small protocol pieces around it."""

from __future__ import annotations

import base64
import functools
import importlib
import inspect
import io
import json
import math
import wave
from collections.abc import AsyncIterable, AsyncIterator, Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlsplit, urlunsplit

import numpy as np

from .functions.channel import ConfigurationError


class AdapterError(RuntimeError):
    pass


class Adapter(Protocol):
    """Made on an executor by a factory without arguments, once for each task that it serves."""

    name: str
    model: str
    device: str
    compute_type: str
    decoding_options: dict

    def transcribe(self, samples: np.ndarray, sample_rate: int, language: str | None) -> str: ...


class StreamingAdapter(Protocol):
    name: str
    model: str

    def stream(self, frames: Iterable[np.ndarray], sample_rate: int, language: str | None) -> Iterable[tuple[str, bool]]: ...


class PacedAdapter(Protocol):
    """Takes frames as they come and gives updates when it has them: the two go on side by side."""

    name: str
    model: str

    def stream_duplex(self, frames: AsyncIterable[np.ndarray], sample_rate: int, language: str | None) -> AsyncIterator[tuple[str, bool]]: ...


@dataclass
class LengthAdapter:
    """Needs no model: says how long the audio is, in hundredths of a second. For tests and dry runs."""

    name: str = "length"
    model: str = "none"
    device: str = "cpu"
    compute_type: str = "none"
    decoding_options: dict = field(default_factory=dict)

    def transcribe(self, samples: np.ndarray, sample_rate: int, language: str | None) -> str:
        return f"audio of {round(100 * len(samples) / sample_rate)}"

    def stream(self, frames: Iterable[np.ndarray], sample_rate: int, language: str | None) -> Iterable[tuple[str, bool]]:
        n = 0
        for frame in frames:
            n += len(frame)
            yield "audio", False
        yield f"audio of {round(100 * n / sample_rate)}", True

    async def stream_duplex(self, frames: AsyncIterable[np.ndarray], sample_rate: int, language: str | None) -> AsyncIterator[tuple[str, bool]]:
        n = 0
        async for frame in frames:
            n += len(frame)
            yield "audio", False
        yield f"audio of {round(100 * n / sample_rate)}", True


def load_factory(name: str, options: dict[str, bool | int | float | str] | None = None) -> Callable[[], Adapter]:
    """The factory named by `module:attribute`, with these options; ones that it has no parameter for are refused at once,
    before anything runs."""
    module, _, attribute = name.partition(":")
    try:
        found = getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError, ValueError) as wrong:
        raise ConfigurationError(f"no adapter factory {name}: {wrong}") from wrong
    if not callable(found):
        raise ConfigurationError(f"{name} is not callable")
    if not options:
        return found
    try:
        inspect.signature(found).bind(**options)
    except TypeError as wrong:
        raise ConfigurationError(f"{name}: {wrong}") from wrong
    return functools.partial(found, **options)


def parse_option(text: str) -> tuple[str, bool | int | float | str]:
    """`name=value`; the value is a JSON boolean or number, or else the text itself."""
    name, equals, value = text.partition("=")
    if not equals or not name.isidentifier():
        raise ConfigurationError(f"an adapter option is name=value: {text}")
    try:
        known = json.loads(value, parse_constant=lambda c: None)
    except ValueError:
        return name, value
    if isinstance(known, (bool, int)) or (isinstance(known, float) and math.isfinite(known)):
        return name, known
    return name, value


def pcm16_bytes(samples) -> bytes:
    """Little-endian 16-bit samples, full scale at 32767 as transports have it."""
    return np.rint(np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).astype("<i2").tobytes()


def wav_bytes(samples, sample_rate: int) -> bytes:
    """A mono 16-bit WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as writer:
        writer.setnchannels(1)
        writer.setsampwidth(2)
        writer.setframerate(sample_rate)
        writer.writeframes(pcm16_bytes(samples))
    return out.getvalue()


def pcm16_base64(samples) -> str:
    return base64.b64encode(pcm16_bytes(samples)).decode("ascii")


def base_url(url: str) -> str:
    """An http(s) address without trailing slash; credentials, queries and fragments are refused."""
    parts = urlsplit(url.strip())
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ConfigurationError("the address must be http or https with a host")
    if parts.username is not None or parts.password is not None:
        raise ConfigurationError("the address must not hold credentials")
    if parts.query or parts.fragment:
        raise ConfigurationError("the address must have no query or fragment")
    return urlunsplit((parts.scheme, parts.netloc, parts.path.rstrip("/"), "", ""))


def socket_url(url: str, path: str) -> str:
    """The web socket address of a path under an http(s) address."""
    parts = urlsplit(base_url(url))
    return urlunsplit(("wss" if parts.scheme == "https" else "ws", parts.netloc, f"{parts.path}/{path.lstrip('/')}", "", ""))


def decode_event(message: str | bytes) -> dict:
    """A protocol message: a JSON object with a type."""
    try:
        event = json.loads(message)
    except (ValueError, UnicodeDecodeError) as wrong:
        raise AdapterError("event is not JSON") from wrong
    if not isinstance(event, dict) or not isinstance(event.get("type"), str):
        raise AdapterError("event must be an object with a type")
    return event
