"""What has landed: files per batch, and which months can be processed."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow import storage
from zoneflow.config import LANDING, SourceConfig, split_month
from zoneflow.sources.survey import survey
from zoneflow.sources.zones import batch_month

READY, SKIP, FAILED = "ready", "skip", "failed"
_UNREADABLE = (PySparkException, Py4JError)
MANIFEST = (
    "date_param string, source_file string, file_size_bytes bigint, ingestion_timestamp timestamp"
)


def _landed_paths(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str] | None
) -> list[str]:
    landed = storage.batch_months(spark, cfg, LANDING)
    wanted = set(landed if months is None else months)
    return [cfg.batch_path(LANDING, month) for month in landed if month in wanted]


def landing_manifest(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str] | None = None
) -> DataFrame:
    """One row per landed file: batch, path, size and load time. Reads no content."""
    paths = _landed_paths(spark, cfg, months)
    if not paths:
        return spark.createDataFrame([], MANIFEST)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(paths)
        .select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    )
    return files.select(
        F.concat_ws(
            "-",
            F.regexp_extract("file_path", r"/year=(\d+)/", 1),
            F.regexp_extract("file_path", r"/month=(\d+)/", 1),
        ).alias("date_param"),
        F.col("file_path").alias("source_file"),
        F.col("file_size").alias("file_size_bytes"),
        F.col("file_modification_time").alias("ingestion_timestamp"),
    )


def _rows(spark: SparkSession, cfg: SourceConfig, months: Sequence[str]) -> dict[str, int]:
    """Rows per month. Every file is opened, and one that cannot be is an error.

    No data column is asked for, so a Parquet file costs its footer alone.
    """
    rows = (
        spark.read.format(cfg.fmt)
        .schema("_none string, year int, month int")
        .option("ignoreCorruptFiles", False)
        .option("header", cfg.fmt == "csv")
        .option("basePath", cfg.zone_root(LANDING))
        .load([cfg.batch_path(LANDING, month) for month in months])
    )
    counted = rows.groupBy(batch_month().alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()
    return dict.fromkeys(months, 0) | {row["m"]: row["n"] for row in counted}


def _sound_rows(spark: SparkSession, cfg: SourceConfig, months: Sequence[str]) -> dict[str, int | None]:
    """Rows per month, None where a file cannot be read: one pass, by month if it fails."""
    if not months:
        return {}
    try:
        return dict(_rows(spark, cfg, months))
    except _UNREADABLE:
        pass

    def alone(month: str) -> int | None:
        try:
            return _rows(spark, cfg, [month])[month]
        except _UNREADABLE:
            return None

    with ThreadPoolExecutor(storage.THREADS) as pool:
        return dict(zip(months, pool.map(alone, months), strict=True))


def batch_status(spark: SparkSession, cfg: SourceConfig, months: Sequence[str]) -> DataFrame:
    """``ready``, ``skip`` or ``failed`` for every wanted month, with files and rows.

    A month nothing has landed for is skipped. A month with a file that cannot be
    opened has failed: that is not a month without data. An empty file is sound.
    ``broken`` names the files that cannot be opened. One pass over all footers tells;
    text files, and those that only Spark can open, are read.
    """
    for month in months:
        split_month(month)
    known = set(storage.batch_months(spark, cfg, LANDING))
    facts = survey(spark, cfg, [month for month in months if month in known])
    found = {month: landed for month, landed in facts.items() if landed.files}
    unknown = [month for month, landed in found.items() if not landed.reached]
    read = _sound_rows(spark, cfg, unknown)

    def row(month: str) -> tuple[str, str, int, int, list[str]]:
        landed = found.get(month)
        if landed is None:
            return month, SKIP, 0, 0, []
        rows = landed.rows if landed.reached else read[month]
        if rows is None or landed.errors:
            return month, FAILED, len(landed.files), 0, sorted(landed.errors)
        return month, READY, len(landed.files), rows, []

    schema = "batch_month string, status string, files bigint, rows bigint, broken array<string>"
    return spark.createDataFrame([row(month) for month in months], schema)
