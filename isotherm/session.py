"""Session with the settings that the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, app: str = "isotherm") -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow; ``partitions`` only where the cluster's own default won't do."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
