"""Quality of the batches over time.

What a run read and kept is written down beside the zones when it happens, so that
files that land later, or are cleared, change nothing. Row counts of a zone come from
Parquet footers and path columns: they cost no data and stay exact however often a
task of the writing job was retried.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow import storage
from zoneflow.config import (
    COPIES,
    METRICS,
    PROMOTED,
    QUARANTINE,
    RAW,
    STRUCTURED,
    QualityTargets,
    SourceConfig,
)
from zoneflow.functions.numeric import percentage
from zoneflow.operators.enrich import batch_stats
from zoneflow.operators.quality import rates
from zoneflow.sources.sinks import write_batches
from zoneflow.sources.zones import batch_month, read_batches, read_structured

MONTHLY = "batch_month string, rows bigint"


def _zone_rows(
    spark: SparkSession, cfg: SourceConfig, zone: str, months: Sequence[str]
) -> DataFrame:
    """Rows per month of a zone, without reading a data column."""
    if zone == STRUCTURED:
        trips = read_structured(spark, cfg, months)
        return trips.groupBy("batch_month").agg(F.count(F.lit(1)).alias("rows"))
    known = set(storage.batch_months(spark, cfg, zone))
    present = [month for month in months if month in known]
    if not present:
        return spark.createDataFrame([], MONTHLY)
    rows = read_batches(spark, cfg, zone, present)
    return rows.groupBy(batch_month().alias("batch_month")).agg(F.count(F.lit(1)).alias("rows"))


def _side_by_side(counts: dict[str, DataFrame]) -> DataFrame:
    """One row per month with one column per named count; 0 where a month is absent."""
    tall = [
        df.select(
            "batch_month",
            *(F.when(F.lit(name == other), F.col("rows")).alias(other) for other in counts),
        )
        for name, df in counts.items()
    ]
    return (
        reduce(DataFrame.unionByName, tall)
        .groupBy("batch_month")
        .agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts))
    )


def rows_by_zone(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str], **zones: str
) -> DataFrame:
    """Rows per batch month, one column per named zone."""
    return _side_by_side({n: _zone_rows(spark, cfg, zone, months) for n, zone in zones.items()})


FIGURES = "year int, month int, input_rows bigint, passed_rows bigint, valid_rows bigint, invalid_rows bigint"


def write_metrics(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str], landed: DataFrame | None = None
) -> None:
    """Write down a run's figures, one row per month: the one place they come from.

    They follow from the zones just written: what was kept is there, and every rejected
    row says how many it stands for. Only where equal valid rows were dropped is the
    number of rows read needed too: ``landed`` then are those rows, as the run read them.
    """
    raw = _zone_rows(spark, cfg, RAW, months)
    quarantine = read_batches(spark, cfg, QUARANTINE, months).groupBy(batch_month().alias("batch_month"))
    quarantine = quarantine.agg(F.count(F.lit(1)).alias("n"), F.sum(COPIES).alias("copies"))
    valid = {row["batch_month"]: row["rows"] for row in raw.collect()}
    rejected = {row["batch_month"]: (row["n"], row["copies"]) for row in quarantine.collect()}
    read: dict[str, int] = {}
    if landed is not None:
        counted = landed.groupBy(batch_month().alias("m")).agg(F.count(F.lit(1)).alias("n"))
        read = {row["m"]: row["n"] for row in counted.collect()}
    rows = []
    for month in months:
        kept, (distinct, copies) = valid.get(month, 0), rejected.get(month, (0, 0))
        passed = kept if landed is None else read.get(month, 0) - copies
        rows.append((*map(int, month.split("-")), passed + copies, passed, kept, distinct))
    write_batches(spark.createDataFrame(rows, FIGURES).coalesce(1), cfg, METRICS, months, gather=False)


def quality_over_time(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str] | None = None
) -> DataFrame:
    """Per batch month: rows in, valid, rejected (distinct too), rates and status.

    All of it as the month's last run had it. Valid rows are those kept; rates count
    what held the rules before equal valid rows were dropped, and rejected rows before
    equal ones were.
    """
    known = storage.batch_months(spark, cfg, METRICS)
    wanted = [m for m in known if months is None or m in set(months)]
    if wanted:
        figures = read_batches(spark, cfg, METRICS, wanted)
    else:
        figures = spark.createDataFrame([], FIGURES)
    counts = figures.select(
        batch_month().alias("batch_month"), "input_rows", "passed_rows", "valid_rows", "invalid_rows"
    )
    return _with_rates(counts, cfg.targets)


def _with_rates(counts: DataFrame, targets: QualityTargets) -> DataFrame:
    rejected = F.col("input_rows") - F.col("passed_rows")
    return counts.withColumns(
        {
            "rejected_rows": rejected,
            "quarantine_rate": percentage(rejected, F.col("input_rows")),
            **rates(F.col("input_rows"), F.col("passed_rows"), targets),
        }
    ).drop("passed_rows")


def quality_alerts(quality: DataFrame, targets: QualityTargets = QualityTargets()) -> DataFrame:
    """One row per month and broken target."""
    alerts = F.array_compact(
        F.array(
            F.when(F.col("quarantine_rate") > targets.max_quarantine, "quarantine_rate"),
            F.when(F.col("quality_rate") < targets.min_quality, "quality_rate"),
        )
    )
    return quality.select(
        "batch_month",
        F.explode(alerts).alias("alert"),
        "input_rows",
        "quality_rate",
        "quarantine_rate",
    )


def structured_over_time(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str]
) -> DataFrame:
    """Per batch month: rows taken in, outliers removed and statistics of the rest.

    Taken in are raw and promoted rows. One scan of structured, and none of its data
    columns if only the counts are selected.
    """
    taken_in = _zone_rows(spark, cfg, RAW, months).unionByName(
        _zone_rows(spark, cfg, PROMOTED, months)
    )
    taken_in = taken_in.groupBy("batch_month").agg(F.sum("rows").alias("input_rows"))
    structured = read_structured(spark, cfg, months)
    clean_rows = F.coalesce("total_trips", F.lit(0))
    removed = F.col("input_rows") - clean_rows
    return taken_in.join(batch_stats(structured, "batch_month"), "batch_month", "left").withColumns(
        {
            "clean_rows": clean_rows,
            "outliers_removed": removed,
            "outlier_pct": percentage(removed, F.col("input_rows")),
        }
    )


def outliers_over_time(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str]
) -> DataFrame:
    return structured_over_time(spark, cfg, months).select(
        "batch_month", "input_rows", "clean_rows", "outliers_removed", "outlier_pct"
    )


def statistics_over_time(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str]
) -> DataFrame:
    structured = read_structured(spark, cfg, months)
    return batch_stats(structured, "batch_month")
