"""The reports on the structured trips and on the quarantine, as SQL.

``{trips}`` and ``{quarantine}`` stand for a DataFrame with the columns of the
structured or the quarantine zone. ``{sums}`` stands for the trips added up by the keys and
columns of ``SUMS``, in a way that no order of rows changes (see ``functions.numeric``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.functions.numeric import exact_sums

SUMS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "trips_by_month": (("pickup_year", "pickup_month"), ("fare_amount", "trip_distance")),
    "trips_by_hour": (("pickup_hour",), ("fare_amount",)),
}

TRIP_REPORTS: dict[str, str] = {
    "total_trips": "SELECT count(*) AS total_trips FROM {trips}",
    "trips_by_ds": """
        SELECT ds, count(*) AS trip_count
        FROM {trips}
        GROUP BY ds
        ORDER BY ds DESC""",
    "trips_by_month": """
        SELECT pickup_year, pickup_month, rows AS trip_count,
               round(sum_fare_amount, 2) AS total_fare,
               round(avg_trip_distance, 2) AS avg_distance
        FROM {sums}
        ORDER BY pickup_year DESC, pickup_month DESC""",
    "trips_by_hour": """
        SELECT pickup_hour, rows AS trips, avg_fare_amount AS avg_fare
        FROM {sums}
        ORDER BY pickup_hour""",
    "trips_by_payment_type": """
        SELECT payment_type, count(*) AS trips
        FROM {trips}
        GROUP BY payment_type""",
    "max_distance_by_year": """
        SELECT pickup_year, max(trip_distance) AS max_dist
        FROM {trips}
        GROUP BY pickup_year""",
    "partition_row_counts": """
        SELECT batch_month, ds, count(*) AS trip_count
        FROM {trips}
        GROUP BY batch_month, ds""",
    "out_of_batch_rows": """
        SELECT batch_month, substr(ds, 1, 7) AS ds_month, count(*) AS trip_count
        FROM {trips}
        WHERE batch_month <> substr(ds, 1, 7)
        GROUP BY batch_month, substr(ds, 1, 7)""",
}

QUARANTINE_REPORTS: dict[str, str] = {
    "quarantine_by_reason": """
        SELECT quarantine_reason, count(*) AS count
        FROM {quarantine}
        GROUP BY quarantine_reason
        ORDER BY count DESC, quarantine_reason""",
    "quarantine_by_ds": """
        SELECT ds, count(*) AS quarantine_count
        FROM {quarantine}
        GROUP BY ds
        ORDER BY ds""",
}


def trip_report(name: str, trips: DataFrame) -> DataFrame:
    if name in SUMS:
        return trips.sparkSession.sql(TRIP_REPORTS[name], sums=exact_sums(trips, *SUMS[name]))
    return trips.sparkSession.sql(TRIP_REPORTS[name], trips=trips)


def quarantine_report(name: str, quarantine: DataFrame) -> DataFrame:
    return quarantine.sparkSession.sql(QUARANTINE_REPORTS[name], quarantine=quarantine)


def null_audit(df: DataFrame) -> DataFrame:
    """Rows and NULLs per column, all columns in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count_if(F.col(name).isNull()).alias(name) for name in df.columns),
    )
    audit = F.array(
        *(
            F.struct(
                F.lit(name).alias("column_name"),
                F.col("_rows").alias("total"),
                F.col(name).alias("nulls"),
            )
            for name in df.columns
        )
    )
    return counts.select(F.inline(audit))
