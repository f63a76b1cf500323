"""PCM WAV files as rows of samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import filesystem

SCHEMA = "path string, sample_rate int, samples array<float>, problem string"


def decode_pcm(payload: bytes, width: int) -> np.ndarray:
    """Integers of 1 to 4 bytes, the first kind unsigned, as floats from -1 up to 1."""
    if width == 1:
        whole = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    elif width == 3:
        parts = np.frombuffer(payload, np.uint8).reshape(-1, 3).astype(np.int64)
        whole = parts @ np.array([1, 1 << 8, 1 << 16])
        whole -= (whole >> 23) << 24
    else:
        whole = np.frombuffer(payload, f"<i{width}").astype(np.int64)
    return (whole / float(1 << (8 * width - 1))).astype(np.float32)


def decode_wav(content: bytes) -> tuple[int | None, np.ndarray | None, str | None]:
    """(sample rate, samples, problem) of one file."""
    try:
        with wave.open(io.BytesIO(content), "rb") as reader:
            if reader.getnchannels() != 1:
                return None, None, "WAV audio must be mono"
            width, n = reader.getsampwidth(), reader.getnframes()
            if not 1 <= width <= 4:
                return None, None, f"unsupported PCM sample width: {width} bytes"
            if not n:
                return None, None, "WAV audio must not be empty"
            payload = reader.readframes(n)
            if len(payload) != n * width:
                return None, None, "WAV data is truncated"
            return reader.getframerate(), decode_pcm(payload, width), None
    except (wave.Error, EOFError) as wrong:
        return None, None, f"only uncompressed PCM WAV is supported ({wrong})"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rate, samples, problem = decode_wav(content)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([rate], pa.int32()), pa.array([samples], pa.list_(pa.float32())), pa.array([problem], pa.string())], names=["path", "sample_rate", "samples", "problem"]
            )


def decode_files(files: DataFrame) -> DataFrame:
    """files (path, content): path, sample_rate, samples, problem; a file with a problem has no samples."""
    return files.select("path", "content").mapInArrow(_decoded, SCHEMA)


AUDIO = "there boolean, content binary, sample_rate int, samples array<float>, wrong string"


def audio_of(items: DataFrame) -> DataFrame:
    """items (path, ...) with the audio that each path names: whether it is there, the bytes, rate and samples, and what is
    wrong with it. Each file is looked for and read in the task that has its row; a null path is there, without audio."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", " + AUDIO

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                path = batch.column("path")[0].as_py()
                there, content, rate, samples, wrong = True, None, None, None, None
                if path is not None:
                    fs, inner = filesystem(path)
                    there = fs.get_file_info(inner).is_file
                    if there:
                        with fs.open_input_stream(inner) as file:
                            content = file.read()
                        rate, samples, wrong = decode_wav(content)
                values = [pa.array([there]), pa.array([content], pa.binary()), pa.array([rate], pa.int32()), pa.array([samples], pa.list_(pa.float32())), pa.array([wrong], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *values], names=[*batch.schema.names, "there", "content", "sample_rate", "samples", "wrong"])

    return items.mapInArrow(read, schema)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    return decode_files(spark.read.format("binaryFile").load(path))
