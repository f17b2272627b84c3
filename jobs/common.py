"""What the command lines of the jobs share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from skyloom.session import ship_package

log = logging.getLogger("jobs")


def settings(defaults: dict, path: str | None) -> dict:
    """The defaults with what a config file changes; unknown names are errors."""
    given = json.loads(Path(path).read_text()) if path else {}
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return {**defaults, **given}


def command_line(name: str, paths: dict[str, str], defaults: dict, run: Callable[..., dict]) -> None:
    """Parse path arguments and a config file, run the job in a session of its own, and stop it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    for path, text in paths.items():
        parser.add_argument(f"--{path}", required=True, help=text)
    parser.add_argument("--config", help="JSON file with settings")
    given = vars(parser.parse_args())
    chosen = settings(defaults, given.pop("config"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        ship_package(spark)
        run(spark, **given, settings=chosen)
    finally:
        spark.stop()
