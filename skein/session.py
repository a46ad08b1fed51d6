"""Session defaults: UTC, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def get_session(app: str = "skein", **conf: str) -> SparkSession:
    """The running session, or a new one with these defaults; ``conf`` has further settings."""
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
