"""What the jobs share: their command line, their settings and their log."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from dendra.sources.readers import settings


def command(name: str, run: Callable[..., dict], paths: dict[str, str], defaults: dict, argv: list[str] | None = None) -> dict:
    """Runs a job from the command line: `--<path>` for each of its paths, `--config` for its settings file, `--set name=value` over that.

    Starts a session and stops it at the end; run() itself takes one.
    """
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for path, what in paths.items():
        parser.add_argument(f"--{path.replace('_', '-')}", dest=path, required=True, help=what)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.yaml")), help="settings file (YAML)")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting that overrides the file's")
    given = parser.parse_args(argv)
    over = {k: type(defaults[k])(v) for k, _, v in (s.partition("=") for s in given.set)}
    chosen = settings(given.config, over, defaults)
    unknown = set(chosen) - set(defaults)
    if unknown:
        parser.error(f"unknown settings {sorted(unknown)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        return run(spark, **{p: getattr(given, p) for p in paths}, **chosen)
    finally:
        spark.stop()
