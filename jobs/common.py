"""What the jobs share: configurations, command lines, and a log of what was read and written."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def read_config(spark: SparkSession, default: str, path: str | None, allowed: set[str]) -> dict:
    """The configuration that ships with a job, with the keys of the JSON at ``path`` (any path that Spark can read) over it."""
    config = json.loads((Path(__file__).parent / default).read_text(encoding="utf-8"))
    if path:
        config |= json.loads(spark.read.text(path, wholetext=True).first()[0])
    if unknown := sorted(set(config) - allowed):
        raise ValueError(f"unknown keys: {unknown}")
    return config


def command_line(about: str, run: Callable[..., dict], *folders: str) -> None:
    """Parse plain paths, start a session, run, stop the session."""
    p = argparse.ArgumentParser(description=about)
    for f in folders:
        p.add_argument(f"--{f}", required=True)
    p.add_argument("--config")
    args = vars(p.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **args)
    finally:
        spark.stop()
