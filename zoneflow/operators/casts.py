"""Bring landing columns to the types of the structured zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow.config import DROPOFF, PICKUP, TRIP_TYPES


def to_type(column: Column, found: T.DataType, wanted: str) -> Column:
    """Cast that gives NULL, not an error, where the value does not fit.

    Text is read as a number first, so ``'1.0'`` is a whole number too; fractions
    are cut off toward zero.
    """
    if wanted == "int" and isinstance(found, T.StringType):
        column = column.try_cast("double")
    return column.try_cast(wanted)


def cast_trips(df: DataFrame) -> DataFrame:
    """All contract columns that are present, cast; other columns pass through."""
    return df.withColumns(
        {
            name: to_type(F.col(name), df.schema[name].dataType, wanted)
            for name, wanted in TRIP_TYPES.items()
            if name in df.columns
        }
    )


def split_datetimes(df: DataFrame) -> DataFrame:
    """Date and time-of-day columns of the pickup and the dropoff."""
    parts = {}
    for stem, ts in (("pickup", PICKUP), ("dropoff", DROPOFF)):
        parts[f"{stem}_date"] = F.to_date(ts)
        parts[f"{stem}_time"] = F.date_format(ts, "HH:mm:ss")
    return df.withColumns(parts)
