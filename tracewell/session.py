"""Session defaults: UTC, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tracewell", **conf: str) -> SparkSession:
    """The running session, or a new one with the engine's defaults.

    Timestamps are naive UTC throughout, so the session's zone must be UTC.  Partition
    counts are left to adaptive execution.
    """
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    return SparkSession.builder.appName(app).config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
