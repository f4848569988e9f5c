"""What the jobs share: their command line, their configuration and their log."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def log_of(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def settings(given: dict, known: dict) -> dict:
    """``known`` settings with those ``given``; a name that is not known raises ValueError."""
    odd = set(given) - set(known)
    if odd:
        raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
    return known | given


def ready(spark: SparkSession, path: str, schema: str, *by: str) -> None:
    """Makes the folder of a table that may get no rows, so that it can be read."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)


def overwrite(rows: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that ``rows`` has; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def main(name: str, run: Callable[[SparkSession, dict], DataFrame], config: str) -> None:
    """The command line of a job: a configuration file and settings that replace its own, as name=value with JSON values or plain text."""
    parser = argparse.ArgumentParser(name)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), config))
    parser.add_argument("settings", nargs="*", metavar="name=value")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    with open(given.config, encoding="utf-8") as file:
        config_ = json.load(file)
    for s in given.settings:
        key, _, value = s.partition("=")
        try:
            config_[key] = json.loads(value)
        except json.JSONDecodeError:
            config_[key] = value
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, config_)
    finally:
        spark.stop()
