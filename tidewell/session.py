"""Spark settings that the engine's SQL dialect relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Static and runtime settings of a session made here. Each is a default: what a cluster sets stays.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("tidewell")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | conf).getOrCreate()
