"""What the jobs share: config files, reading a table that may not be there yet, the command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("kinfold.jobs")


def checked(config: dict, required: dict[str, type], optional: dict[str, object]) -> dict:
    """``config`` with defaults; unknown, missing and mistyped entries are errors that name the entry."""
    if unknown := sorted(config.keys() - required.keys() - optional.keys()):
        raise ValueError(f"unknown entries in the config: {', '.join(unknown)}")
    for name, kind in required.items():
        if not isinstance(config.get(name), kind):
            raise ValueError(f"config entry {name!r} must be given as {kind.__name__}")
    return {**optional, **config}


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one if nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def main(run: Callable[[SparkSession, dict], dict], name: str) -> None:
    """The command line: a config file, and entries of it to set, as in ``out=/data/out``."""
    parser = argparse.ArgumentParser(description=sys.modules[run.__module__].__doc__)
    parser.add_argument("config", help="a JSON file")
    parser.add_argument("entries", nargs="*", metavar="name=value", help="entries in place of the file's, values as JSON or text")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s", stream=sys.stderr)
    with open(args.config) as f:
        config = json.load(f)
    for entry in args.entries:
        key, _, value = entry.partition("=")
        try:
            config[key] = json.loads(value)
        except ValueError:
            config[key] = value
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        print(json.dumps(run(spark, config)))
    finally:
        spark.stop()
