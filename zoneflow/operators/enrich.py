"""Feature columns, outlier removal and the statistics of a cleaned batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.config import PICKUP, OutlierLimits
from zoneflow.functions.features import time_features, trip_metrics
from zoneflow.functions.numeric import exact_sums, percentage
from zoneflow.operators.casts import cast_trips


def add_time_features(df: DataFrame, ts: str = PICKUP) -> DataFrame:
    return df.withColumns(time_features(ts))


def add_trip_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns(trip_metrics())


def _inside(name: str, low: float, high: float) -> Column:
    return (F.col(name) > low) & (F.col(name) < high)


def within_limits(limits: OutlierLimits = OutlierLimits()) -> Column:
    """A row without a speed is judged by the other limits alone."""
    speed = _inside("avg_speed_mph", limits.min_speed, limits.max_speed)
    return (
        _inside("trip_duration_minutes", limits.min_minutes, limits.max_minutes)
        & _inside("trip_distance", limits.min_distance, limits.max_distance)
        & _inside("fare_amount", limits.min_fare, limits.max_fare)
        & F.coalesce(speed, F.lit(True))
    )


def remove_outliers(df: DataFrame, limits: OutlierLimits = OutlierLimits()) -> DataFrame:
    return df.filter(within_limits(limits))


def enrich(df: DataFrame) -> DataFrame:
    """Cast, then add all feature columns."""
    return add_time_features(add_trip_metrics(cast_trips(df)))


def structure(df: DataFrame, limits: OutlierLimits = OutlierLimits()) -> DataFrame:
    """From raw rows to rows of the structured zone."""
    return remove_outliers(enrich(df), limits)


def outlier_breakdown(enriched: DataFrame, limits: OutlierLimits = OutlierLimits()) -> DataFrame:
    """Outliers by the first limit they break; ``none_decided`` if only NULLs do."""
    checks = (
        ("distance", "low", F.col("trip_distance") <= limits.min_distance),
        ("distance", "high", F.col("trip_distance") >= limits.max_distance),
        ("fare", "low", F.col("fare_amount") <= limits.min_fare),
        ("fare", "high", F.col("fare_amount") >= limits.max_fare),
        ("duration", "low", F.col("trip_duration_minutes") <= limits.min_minutes),
        ("duration", "high", F.col("trip_duration_minutes") >= limits.max_minutes),
        ("speed", "low", F.col("avg_speed_mph") <= limits.min_speed),
        ("speed", "high", F.col("avg_speed_mph") >= limits.max_speed),
    )
    first = F.coalesce(
        *(F.when(broken, f"{measure}_too_{side}") for measure, side, broken in checks),
        F.lit("none_decided"),
    )
    outliers = enriched.filter(~F.coalesce(within_limits(limits), F.lit(False)))
    return outliers.groupBy(first.alias("broken_limit")).agg(F.count(F.lit(1)).alias("rows"))


def outlier_metrics(enriched: DataFrame, limits: OutlierLimits = OutlierLimits()) -> DataFrame:
    """Rows before and after outlier removal, and the share removed."""
    counts = enriched.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(within_limits(limits)).alias("clean_rows"),
    )
    removed = F.col("input_rows") - F.col("clean_rows")
    return counts.withColumns(
        {
            "outliers_removed": removed,
            "outlier_pct": percentage(removed, F.col("input_rows")),
        }
    )


def batch_stats(clean: DataFrame, *keys: str) -> DataFrame:
    """Statistics of cleaned trips, overall or per ``keys``; NULL where none is left."""
    measures = ("fare_amount", "trip_distance", "trip_duration_minutes", "avg_speed_mph", "fare_per_mile")
    return exact_sums(clean, keys, measures).select(
        *keys,
        F.col("rows").alias("total_trips"),
        F.col("sum_fare_amount").alias("total_fare"),
        F.col("avg_trip_distance").alias("avg_distance"),
        F.col("avg_trip_duration_minutes").alias("avg_duration"),
        F.col("avg_avg_speed_mph").alias("avg_speed"),
        F.col("avg_fare_per_mile").alias("avg_fare_per_mile"),
    )
