"""Commands over the plans: run, concurrent, streaming, compare. Expected errors end with status 2."""

from __future__ import annotations

import argparse
import math
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .adapters import AdapterError, load_factory, parse_option
from .functions.channel import CODECS, Channel, ConfigurationError, realtime_factor
from .plans import runs
from .sources import artifacts

EXPECTED = (ConfigurationError, AdapterError, runs.RunError, artifacts.ArtifactError, OSError)


def _number(low: float | None = None, high: float | None = None, above: float | None = None):
    def parse(text: str) -> float:
        value = float(text)
        if not math.isfinite(value) or (low is not None and value < low) or (high is not None and value > high) or (above is not None and value <= above):
            raise argparse.ArgumentTypeError(f"{text} is out of range")
        return value

    return parse


def _count(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise argparse.ArgumentTypeError(f"{text} is not positive")
    return value


def _seed(text: str) -> int:
    value = int(text)
    if value < 0:
        raise argparse.ArgumentTypeError(f"{text} is negative")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wirescore")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="score a manifest behind a channel")
    load = commands.add_parser("concurrent", help="measure latency under load")
    stream = commands.add_parser("streaming", help="measure streaming transcription")
    for one in (run, load, stream):
        one.add_argument("manifest")
        one.add_argument("--output", required=True)
        one.add_argument("--adapter", default="wirescore.adapters:LengthAdapter", help="module:factory")
        one.add_argument("--adapter-option", action="append", default=[], metavar="NAME=VALUE", help="passed to the factory; may be repeated")
    run.add_argument("--codec", choices=CODECS, default="none")
    run.add_argument("--packet-loss-rate", type=_number(0, 1), default=0.0)
    run.add_argument("--gain-db", type=_number(), default=0.0)
    run.add_argument("--clip-threshold", type=_number(above=0))
    run.add_argument("--snr-db", dest="additive_noise_snr_db", type=_number())
    run.add_argument("--jitter-std-ms", type=_number(0))
    run.add_argument("--playout-buffer-ms", type=_number(0))
    run.add_argument("--seed", type=_seed, default=0)
    run.add_argument("--frame-duration-ms", type=_count, default=20)
    load.add_argument("--concurrency", type=_count, required=True)
    stream.add_argument("--frame-duration-ms", type=_count, default=20)
    stream.add_argument("--timing-mode", choices=("file_upload", "paced"), default="file_upload")
    stream.add_argument("--realtime-factor", type=_number(above=0), help="of paced runs; 1 if not given")
    stream.add_argument("--language-mode", choices=("manifest", "autodetect"), default="manifest")
    compare = commands.add_parser("compare", help="print a table of batch results")
    compare.add_argument("results", nargs="+")
    return top


def main(arguments: Sequence[str] | None = None) -> int:
    given = vars(parser().parse_args(arguments))
    command = given.pop("command")
    spark = SparkSession.builder.getOrCreate()
    try:
        if command == "compare":
            print(artifacts.markdown(artifacts.compare(spark, given["results"])))
            return 0
        manifest, output, factory = given.pop("manifest"), given.pop("output"), load_factory(given.pop("adapter"), dict(map(parse_option, given.pop("adapter_option"))))
        if command == "run":
            made = runs.run_batch(spark, manifest, factory, Channel(**given))
        elif command == "concurrent":
            made = runs.run_load(spark, manifest, factory, given["concurrency"])
        else:
            factor = given["realtime_factor"]
            made = runs.run_streaming(
                spark, manifest, factory, given["frame_duration_ms"], given["timing_mode"], None if factor is None else realtime_factor(factor), given["language_mode"]
            )
        with made:
            made.write(output)
    except EXPECTED as wrong:
        print(f"error: {wrong}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
