"""What both jobs' command lines share: a configuration file, overridden by arguments, and a session around the work."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

from tessera import runtime


def load_config(path: str, given: dict[str, str | None], known: dict[str, object]) -> dict:
    """The file's values over the defaults ``known``, arguments over both; unknown and missing keys are errors."""
    with open(path, encoding="utf-8") as f:
        values = json.load(f)
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    merged = known | values | {k: v for k, v in given.items() if v is not None}
    if missing := [k for k, v in merged.items() if v == ""]:
        raise ValueError(f"settings without a value: {', '.join(missing)}")
    return merged


def main(name: str, config: str, known: dict[str, object], paths: tuple[str, ...], run: Callable[[SparkSession, dict], dict], argv: list[str] | None = None) -> dict:
    """Parse arguments, run the job in a session of its own, and stop it."""
    parser = argparse.ArgumentParser(prog=name)
    parser.add_argument("--config", default=config)
    for p in paths:
        parser.add_argument(f"--{p}", help=f"overrides {p} of the configuration")
    args = vars(parser.parse_args(argv))
    settings = load_config(args.pop("config"), args, known)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        runtime.ship(spark)
        return run(spark, settings)
    finally:
        spark.stop()
