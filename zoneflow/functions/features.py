"""Columns derived from a typed trip row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zoneflow.config import DROPOFF, PICKUP

# Spark's day numbers of Sunday and Saturday, and the card payment code.
WEEKEND_DAYS = (1, 7)
CARD_PAYMENT = 1


def minutes_between(start: str, end: str) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 60


def _where(condition: Column, value: Column) -> Column:
    """``value`` where the condition is TRUE, else NULL."""
    return F.when(condition, value)


def time_features(ts: str = PICKUP) -> dict[str, Column]:
    day = F.dayofweek(ts)
    return {
        "pickup_date": F.to_date(ts),
        "pickup_year": F.year(ts),
        "pickup_month": F.month(ts),
        "pickup_day": F.dayofmonth(ts),
        "pickup_hour": F.hour(ts),
        "pickup_dayofweek": day,
        "pickup_week": F.weekofyear(ts),
        "is_weekend": F.when(day.isin(*WEEKEND_DAYS), 1).otherwise(0),
        "ds": F.date_format(ts, "yyyy-MM-dd"),
    }


def trip_metrics() -> dict[str, Column]:
    minutes = minutes_between(PICKUP, DROPOFF)
    distance, fare, tip, total, passengers = (
        F.col(name)
        for name in (
            "trip_distance",
            "fare_amount",
            "tip_amount",
            "total_amount",
            "passenger_count",
        )
    )
    paid_by_card = F.col("payment_type") == CARD_PAYMENT
    return {
        "trip_duration_minutes": minutes,
        "avg_speed_mph": _where((minutes > 0) & (distance > 0), distance / minutes * 60),
        "fare_per_mile": _where(distance > 0, fare / distance),
        "tip_percentage": _where(paid_by_card & (fare > 0), tip / fare * 100),
        "cost_per_passenger": _where(passengers > 0, total / passengers),
    }
