"""A session with the settings the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tarn", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC times, adaptive plans, skewed joins split; the rest is the cluster's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
