"""Lakes for the queries that read or write zones, built from all of ``lineitem``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.trips import derive_trips
from zoneflow import paths, storage
from zoneflow.config import LANDING, SourceConfig, months_between
from zoneflow.plans.pipeline import run_range
from zoneflow.sources.sinks import files_kept_open
from zoneflow.sources.zones import read_landing

SOURCE = "yellow-trips"
RETYPED = "1998-07"
TEXT_ROWS = 500_000
RUN_TS = datetime(2002, 2, 1, tzinfo=UTC)

_built: dict[tuple[str, str, str], SourceConfig] = {}


def empty_lake(
    spark: SparkSession, label: str, fmt: str = "parquet", columns: Mapping[str, str] | None = None
) -> SourceConfig:
    root = storage.scratch_dir(spark, label)
    return SourceConfig(root=root, source=SOURCE, fmt=fmt, columns=columns or {})


def land(df: DataFrame, cfg: SourceConfig) -> None:
    """Deliver trips to the landing zone, in the directory of their batch month.

    No shuffle: the rows of a month should lie together, as landed ones do and derived
    ones that were gathered.
    """
    month = F.split("batch_month", "-")
    parts = df.withColumns({"year": month[0], "month": month[1]}).drop("batch_month")
    writer = parts.write.mode("append").format(cfg.fmt).option("header", cfg.fmt == "csv")
    if cfg.fmt != "parquet":
        # Packed text cannot be split, so a file is no more than a task can take.
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", TEXT_ROWS)
    with files_kept_open(df.sparkSession):
        writer.partitionBy("year", "month").save(cfg.zone_root(LANDING))


def deliver_again(spark: SparkSession, files: Sequence[str], aside: str) -> None:
    """Put files that have landed there once more, under the names they have."""
    conf = spark._jsc.hadoopConfiguration()
    copy = spark._jvm.org.apache.hadoop.fs.FileUtil.copy

    def again(at: int) -> None:
        (fs, file), (_, kept) = (paths.open_path(spark, p) for p in (files[at], f"{aside}/{at}"))
        copy(fs, file, fs, kept, False, True, conf)
        copy(fs, kept, fs, file, False, True, conf)

    with ThreadPoolExecutor(paths.THREADS) as pool:
        list(pool.map(again, range(len(files))))


def landed(spark: SparkSession, sf_dir: str) -> SourceConfig:
    """A lake whose landing zone holds all trips; built once per session, only read."""
    key = ("landed", spark.sparkContext.applicationId, sf_dir)
    if key not in _built or not storage.exists(spark, _built[key].root):
        cfg = empty_lake(spark, "landed")
        land(derive_trips(spark, sf_dir, gather=True), cfg)
        _built[key] = cfg
    return _built[key]


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trips, as they landed."""
    return read_landing(spark, landed(spark, sf_dir))


def fresh_lake(spark: SparkSession, sf_dir: str, label: str) -> SourceConfig:
    """The same landing zone with all other zones still empty."""
    return replace(empty_lake(spark, label), landing_root=landed(spark, sf_dir).root)


def span(spark: SparkSession, cfg: SourceConfig) -> list[str]:
    """The landed months, those between them and one on either side."""
    landed_months = storage.batch_months(spark, cfg, LANDING)
    (y0, m0), (y1, m1) = (map(int, m.split("-")) for m in (landed_months[0], landed_months[-1]))
    before, after = y0 * 12 + m0 - 2, y1 * 12 + m1
    ends = [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in (before, after)]
    return months_between(*ends)


def full_lake(spark: SparkSession, sf_dir: str) -> SourceConfig:
    """A lake in which all months were processed; built once per session, only read."""
    key = ("full", spark.sparkContext.applicationId, sf_dir)
    if key not in _built or not storage.exists(spark, _built[key].root):
        cfg = fresh_lake(spark, sf_dir, "full")
        months = span(spark, cfg)
        run_range(spark, cfg, months[0], months[-1], RUN_TS)
        _built[key] = cfg
    return _built[key]


def retyped_lake(spark: SparkSession, sf_dir: str) -> SourceConfig:
    """A lake whose source writes a column of its own as a number first, then as text."""
    key = ("retyped", spark.sparkContext.applicationId, sf_dir)
    if key not in _built or not storage.exists(spark, _built[key].root):
        cfg = empty_lake(spark, "retyped")
        all_trips = trips(spark, sf_dir)
        early = F.col("batch_month") < RETYPED
        zone = F.col("PULocationID")
        land(all_trips.filter(early).withColumn("zone_code", zone), cfg)
        text = F.concat(F.lit("Z"), F.lpad(zone.cast("string"), 4, "0"))
        land(all_trips.filter(~early).withColumn("zone_code", text), cfg)
        months = span(spark, cfg)
        run_range(spark, cfg, months[0], months[-1], RUN_TS)
        _built[key] = cfg
    return _built[key]
