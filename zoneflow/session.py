"""Session settings the package is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Calendar fields and the date partition are those of UTC.
    "spark.sql.session.timeZone": "UTC",
    # Merge small and split large shuffle partitions at run time; zone files of ~128 MB.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    # A task that writes many small directories is bound by files, not bytes.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.parquet.compression.codec": "snappy",
}


def build_session(app_name: str = "zoneflow", **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; ``settings`` given as ``spark_sql_x="y"`` win."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
