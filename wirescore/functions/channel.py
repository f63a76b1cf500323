"""The telephone channel as one pass over samples, with its checks.

The array functions of `signal` give each stage as a plan; a run that wants all of them does one trip through Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import signal as S

CODECS = ("none", "pcmu", "pcma")


class ConfigurationError(ValueError):
    pass


def checked(samples, sample_rate: int) -> np.ndarray:
    """Samples as 32-bit floats: one finite row that is not empty, at a whole positive rate."""
    x = np.asarray(samples)
    if isinstance(sample_rate, bool) or not isinstance(sample_rate, (int, np.integer)) or sample_rate <= 0:
        raise ConfigurationError("sample rate must be a positive integer")
    if x.ndim != 1 or not x.size:
        raise ConfigurationError("samples must be one row that is not empty")
    if not np.isfinite(x).all():
        raise ConfigurationError("samples must be finite")
    return x.astype(np.float32)


def frame_samples(sample_rate: int, frame_ms: int) -> int:
    """Samples in a frame, which must be a whole number."""
    if isinstance(frame_ms, bool) or not isinstance(frame_ms, int) or frame_ms <= 0 or sample_rate * frame_ms % 1000:
        raise ConfigurationError("a frame must be a whole number of samples")
    return sample_rate * frame_ms // 1000


def realtime_factor(value) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not np.isfinite(value) or value <= 0:
        raise ConfigurationError("realtime factor must be finite and positive")
    return float(value)


@dataclass(frozen=True)
class Channel:
    """What is done to the audio of a run, in this order: gain and clipping, noise, telephone codec with loss."""

    codec: str = "none"
    packet_loss_rate: float = 0.0
    frame_duration_ms: int = 20
    seed: int = 0
    gain_db: float = 0.0
    clip_threshold: float | None = None
    additive_noise_snr_db: float | None = None
    jitter_std_ms: float | None = None
    playout_buffer_ms: float | None = None

    def __post_init__(self) -> None:
        if self.codec not in CODECS:
            raise ConfigurationError(f"unknown codec: {self.codec}")
        if not 0 <= self.packet_loss_rate <= 1:
            raise ConfigurationError("packet loss rate must be from 0 to 1")
        if self.codec == "none" and self.packet_loss_rate:
            raise ConfigurationError("packet loss needs a codec")
        if (self.jitter_std_ms is None) != (self.playout_buffer_ms is None):
            raise ConfigurationError("jitter deviation and playout buffer belong together")
        if self.jitter_std_ms is not None and (self.codec == "none" or not 0 <= self.jitter_std_ms < np.inf or not 0 <= self.playout_buffer_ms < np.inf):
            raise ConfigurationError("jitter needs a codec and finite times that are not negative")
        if self.clip_threshold is not None and not 0 < self.clip_threshold < np.inf:
            raise ConfigurationError("clip threshold must be finite and positive")
        if not np.isfinite(self.gain_db) or (self.additive_noise_snr_db is not None and not np.isfinite(self.additive_noise_snr_db)):
            raise ConfigurationError("decibels must be finite")
        frame_samples(S.TELEPHONE_RATE, self.frame_duration_ms)


def to_pcm16(samples: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.clip(samples.astype(np.float64), -1, 1) * 32768), -32768, 32767).astype(np.int32)


def encode(samples: np.ndarray, codec: str) -> bytes:
    """G.711 bytes of samples, by the segments of each law."""
    pcm = to_pcm16(samples)
    if codec == "pcmu":
        size = np.minimum(4 * np.abs(pcm >> 2), S.MU_CLIP) + S.MU_BIAS
        segment = np.searchsorted(np.array(S.MU_ENDS[:-1]), size)
        code = (segment << 4 | size >> (segment + 3) & 15) ^ np.where(pcm < 0, 0x7F, 0xFF)
    elif codec == "pcma":
        size = np.where(pcm < 0, -(pcm >> 3) - 1, pcm >> 3)
        segment = np.searchsorted(np.array(S.A_ENDS[:-1]), size)
        code = (segment << 4 | size >> np.maximum(segment, 1) & 15) ^ np.where(pcm < 0, 0x55, 0xD5)
    else:
        raise ConfigurationError(f"unknown codec: {codec}")
    return code.astype(np.uint8).tobytes()


def decode(payload: bytes, codec: str) -> np.ndarray:
    if codec not in CODECS[1:]:
        raise ConfigurationError(f"unknown codec: {codec}")
    code = np.frombuffer(payload, np.uint8).astype(np.int64) ^ (0xFF if codec == "pcmu" else 0x55)
    segment, low = code >> 4 & 7, code & 15
    if codec == "pcmu":
        size = (((low << 3) + S.MU_BIAS) << segment) - S.MU_BIAS
        size = np.where(code & 0x80, -size, size)
    else:
        size = np.where(segment == 0, (2 * low + 1) * 8, (2 * low + 33) * 8 << np.maximum(segment - 1, 0))
        size = np.where(code & 0x80, size, -size)
    return (size / 32768).astype(np.float32)


def through(samples, sample_rate: int, item_index: int, channel: Channel) -> tuple[np.ndarray, int]:
    """Samples and rate behind the channel; every random stream depends on the run's seed and the item alone."""
    x, rate = checked(samples, sample_rate), int(sample_rate)
    if channel.gain_db or channel.clip_threshold is not None:
        y = x.astype(np.float64) * 10 ** (channel.gain_db / 20)
        x = (y if channel.clip_threshold is None else np.clip(y, -channel.clip_threshold, channel.clip_threshold)).astype(np.float32)
    if channel.additive_noise_snr_db is not None:
        x = S.noisy(x, channel.additive_noise_snr_db, S.stream_seed(channel.seed, item_index, 1))
    if channel.codec != "none":
        payload = encode(S.resampled(x, rate, S.TELEPHONE_RATE), channel.codec)
        payload = S.lost(payload, channel.codec, channel.packet_loss_rate, channel.frame_duration_ms, S.stream_seed(channel.seed, item_index))
        if channel.jitter_std_ms is not None:
            payload = S.late(payload, channel.codec, channel.jitter_std_ms, channel.playout_buffer_ms, channel.frame_duration_ms, S.stream_seed(channel.seed, item_index, 2))
        x, rate = decode(payload, channel.codec), S.TELEPHONE_RATE
    return x, rate
