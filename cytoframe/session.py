"""Spark session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic, UTC, adaptive plans with skew handling, Arrow transfer.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "cytoframe", **settings: str) -> SparkSession:
    """A session with the settings above; ``settings`` come on top."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()
