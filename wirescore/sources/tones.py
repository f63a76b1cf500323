"""Square waves as WAV files: audio to try a run on, without a recording.

    python -m wirescore.sources.tones FOLDER
"""

from __future__ import annotations

import io
import json
import os
import sys
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem

#: The rate, length, amplitude and pitches of the files.
RATE, LENGTH, AMPLITUDE, PITCHES = 16_000, 4_000, 8_192, (440, 660)


def square_waves(spark: SparkSession, pitches: tuple[int, ...] = PITCHES, n: int = LENGTH, rate: int = RATE, amplitude: int = AMPLITUDE) -> DataFrame:
    """Rows pitch, pcm: 16-bit samples, high in the first half of each period, by whole numbers alone."""
    level = lambda i: F.when(i * F.col("pitch") % rate * 2 < rate, amplitude).otherwise(-amplitude)
    rows = spark.createDataFrame([(p,) for p in pitches], "pitch int")
    return rows.select("pitch", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), level).alias("pcm"))


def write_tones(waves: DataFrame, folder: str, rate: int = RATE) -> str:
    """A file <pitch>.wav for each row, written in the tasks, and a manifest of them; its path."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, inner = filesystem(folder)
        fs.create_dir(inner)
        for part in parts:
            for pitch, pcm in zip(part["pitch"], part["pcm"]):
                with wave.open(out := io.BytesIO(), "wb") as file:
                    file.setnchannels(1)
                    file.setsampwidth(2)
                    file.setframerate(rate)
                    file.writeframes(np.asarray(pcm, "<i2").tobytes())
                with fs.open_output_stream(f"{inner}/{pitch}.wav") as target:
                    target.write(out.getvalue())
            yield part[["pitch"]]

    made = sorted(r["pitch"] for r in waves.select("pitch", "pcm").mapInPandas(write, "pitch int").collect())
    path = f"{folder}/tones.jsonl"
    fs, inner = filesystem(path)
    with fs.open_output_stream(inner) as target:
        target.write("".join(json.dumps({"id": f"tone-{p}", "audio": f"{p}.wav", "reference": f"tone {p}"}) + "\n" for p in made).encode())
    return path


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    print(write_tones(square_waves(session), os.path.abspath(sys.argv[1])))
