"""The answers to ``checks.queries`` as DuckDB SQL over the given tables.

Written from the rules, not from the Spark code: every query starts at ``lineitem``
and never at something Spark produced.
"""

from __future__ import annotations

from checks.trips import DUCKDB_TRIPS

TRIP_COLUMNS = """VendorID, tpep_pickup_datetime, tpep_dropoff_datetime, passenger_count,
  trip_distance, RatecodeID, PULocationID, DOLocationID, payment_type, fare_amount, extra,
  mta_tax, tip_amount, tolls_amount, improvement_surcharge, total_amount,
  congestion_surcharge, airport_fee, batch_month"""

_REASON = """CASE
    WHEN tpep_pickup_datetime IS NULL THEN 'null_pickup_datetime'
    WHEN tpep_dropoff_datetime IS NULL THEN 'null_dropoff_datetime'
    WHEN fare_amount IS NULL THEN 'null_fare'
    WHEN trip_distance IS NULL THEN 'null_distance'
    WHEN fare_amount < 0 THEN 'negative_fare'
    WHEN trip_distance < 0 THEN 'negative_distance'
    WHEN passenger_count <= 0 THEN 'invalid_passenger_count'
    WHEN tpep_dropoff_datetime <= tpep_pickup_datetime THEN 'temporal_inconsistency'
    WHEN trip_distance >= 500 THEN 'excessive_distance'
    WHEN fare_amount >= 1000 THEN 'excessive_fare'
    WHEN PULocationID NOT BETWEEN 1 AND 263 THEN 'invalid_pickup_location'
    WHEN DOLocationID NOT BETWEEN 1 AND 263 THEN 'invalid_dropoff_location'
    ELSE 'multiple_issues' END"""

_VALID = """(tpep_pickup_datetime IS NOT NULL AND tpep_dropoff_datetime IS NOT NULL
    AND fare_amount IS NOT NULL AND trip_distance IS NOT NULL
    AND fare_amount >= 0 AND trip_distance >= 0 AND passenger_count > 0
    AND tpep_dropoff_datetime > tpep_pickup_datetime
    AND passenger_count <= 8 AND trip_distance < 500 AND fare_amount < 1000
    AND PULocationID BETWEEN 1 AND 263 AND DOLocationID BETWEEN 1 AND 263)"""

RULES = {
    "pickup_present": ("nulls", "tpep_pickup_datetime IS NOT NULL"),
    "dropoff_present": ("nulls", "tpep_dropoff_datetime IS NOT NULL"),
    "fare_present": ("nulls", "fare_amount IS NOT NULL"),
    "distance_present": ("nulls", "trip_distance IS NOT NULL"),
    "fare_sign": ("non_negative", "fare_amount >= 0"),
    "distance_sign": ("non_negative", "trip_distance >= 0"),
    "passengers_sign": ("non_negative", "passenger_count > 0"),
    "time_order": ("temporal", "tpep_dropoff_datetime > tpep_pickup_datetime"),
    "passengers_range": ("range", "passenger_count <= 8"),
    "distance_range": ("range", "trip_distance < 500"),
    "fare_range": ("range", "fare_amount < 1000"),
    "pickup_zone": ("location", "PULocationID BETWEEN 1 AND 263"),
    "dropoff_zone": ("location", "DOLocationID BETWEEN 1 AND 263"),
}


def _retyped(table: str) -> str:
    return f"""SELECT CAST(VendorID AS INTEGER) AS VendorID, tpep_pickup_datetime,
    tpep_dropoff_datetime, CAST(trunc(passenger_count) AS INTEGER) AS passenger_count,
    trip_distance, CAST(trunc(RatecodeID) AS INTEGER) AS RatecodeID,
    CAST(PULocationID AS INTEGER) AS PULocationID, CAST(DOLocationID AS INTEGER) AS DOLocationID,
    CAST(payment_type AS INTEGER) AS payment_type, fare_amount, extra, mta_tax, tip_amount,
    tolls_amount, improvement_surcharge, total_amount, congestion_surcharge, airport_fee,
    batch_month
  FROM {table}"""


def _featured(table: str) -> str:
    return f"""SELECT *,
    CAST(tpep_pickup_datetime AS DATE) AS pickup_date,
    CAST(year(tpep_pickup_datetime) AS INTEGER) AS pickup_year,
    CAST(month(tpep_pickup_datetime) AS INTEGER) AS pickup_month,
    CAST(day(tpep_pickup_datetime) AS INTEGER) AS pickup_day,
    CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
    CAST(dayofweek(tpep_pickup_datetime) + 1 AS INTEGER) AS pickup_dayofweek,
    CAST(weekofyear(tpep_pickup_datetime) AS INTEGER) AS pickup_week,
    CAST(CASE WHEN dayofweek(tpep_pickup_datetime) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER)
      AS is_weekend,
    strftime(tpep_pickup_datetime, '%Y-%m-%d') AS ds,
    minutes AS trip_duration_minutes,
    CASE WHEN minutes > 0 AND trip_distance > 0 THEN trip_distance / minutes * 60 END
      AS avg_speed_mph,
    CASE WHEN trip_distance > 0 THEN fare_amount / trip_distance END AS fare_per_mile,
    CASE WHEN payment_type = 1 AND fare_amount > 0 THEN tip_amount / fare_amount * 100 END
      AS tip_percentage,
    CASE WHEN passenger_count > 0 THEN total_amount / passenger_count END AS cost_per_passenger
  FROM (SELECT *, (epoch(tpep_dropoff_datetime) - epoch(tpep_pickup_datetime)) / 60 AS minutes
        FROM ({_retyped(table)}))"""


_INLIERS = """trip_duration_minutes > 0 AND trip_duration_minutes < 1440
    AND trip_distance > 0 AND trip_distance < 100 AND fare_amount > 0 AND fare_amount < 500
    AND (avg_speed_mph IS NULL OR (avg_speed_mph > 0 AND avg_speed_mph < 100))"""

_FAILED_LIST = "[x FOR x IN [" + ", ".join(
    f"CASE WHEN coalesce({holds}, FALSE) THEN NULL ELSE '{name}' END"
    for name, (_, holds) in RULES.items()
) + "] IF x IS NOT NULL]"

# The repairs, on rejected rows: no passengers, swapped times, odd payment codes.
_REPAIRED = """SELECT quarantine_reason AS original_reason, VendorID,
    CASE WHEN tpep_dropoff_datetime < tpep_pickup_datetime THEN tpep_dropoff_datetime
         ELSE tpep_pickup_datetime END AS tpep_pickup_datetime,
    CASE WHEN tpep_dropoff_datetime < tpep_pickup_datetime THEN tpep_pickup_datetime
         ELSE tpep_dropoff_datetime END AS tpep_dropoff_datetime,
    CASE WHEN passenger_count IS NULL OR passenger_count = 0 THEN 1.0::DOUBLE
         ELSE passenger_count END AS passenger_count,
    trip_distance, RatecodeID, PULocationID, DOLocationID,
    CASE WHEN payment_type BETWEEN 1 AND 6 THEN payment_type ELSE 5 END AS payment_type,
    fare_amount, extra, mta_tax, tip_amount, tolls_amount, improvement_surcharge, total_amount,
    congestion_surcharge, airport_fee, batch_month,
    concat_ws(',',
      CASE WHEN passenger_count IS NULL OR passenger_count = 0 THEN 'default_passengers' END,
      CASE WHEN tpep_dropoff_datetime < tpep_pickup_datetime THEN 'swapped_times' END,
      CASE WHEN payment_type NOT BETWEEN 1 AND 6 THEN 'unknown_payment' END) AS repairs
  FROM rejected_once"""

_CTES = {
    "trips": DUCKDB_TRIPS,
    "valid": f"SELECT * FROM trips WHERE {_VALID}",
    "rejected": f"""SELECT *, {_REASON} AS quarantine_reason FROM trips
  WHERE NOT coalesce({_VALID}, FALSE)""",
    "rejected_once": "SELECT DISTINCT * FROM rejected",
    "featured": _featured("valid"),
    "clean": f"SELECT * FROM featured WHERE {_INLIERS}",
    "repaired": _REPAIRED,
    "promoted": f"SELECT {TRIP_COLUMNS} FROM repaired WHERE {_VALID}",
    "clean_promoted": f"SELECT * FROM ({_featured('promoted')}) WHERE {_INLIERS}",
    "monthly": """SELECT batch_month, count(*) AS input_rows,
    count(*) FILTER (WHERE quarantine_reason IS NULL) AS valid_rows,
    count(*) FILTER (WHERE quarantine_reason IS NOT NULL) AS rejected_rows
  FROM (SELECT batch_month, NULL AS quarantine_reason FROM valid
        UNION ALL SELECT batch_month, quarantine_reason FROM rejected)
  GROUP BY batch_month""",
    "monthly_once": "SELECT batch_month, count(*) AS invalid_rows FROM rejected_once GROUP BY 1",
    "quality": """SELECT batch_month, input_rows, valid_rows, rejected_rows,
    coalesce(invalid_rows, 0) AS invalid_rows,
    rejected_rows / input_rows * 100 AS quarantine_rate,
    valid_rows / input_rows * 100 AS quality_rate,
    100 - valid_rows / input_rows * 100 AS invalid_rate,
    CASE WHEN valid_rows / input_rows * 100 >= 95 THEN 'SUCCESS' ELSE 'WARNING' END AS status
  FROM monthly LEFT JOIN monthly_once USING (batch_month)""",
}


def _with(body: str) -> str:
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in _CTES.items())
    return f"WITH {ctes}\n{body}"


def _total(column: str) -> str:
    return f"round(fsum({column}), 6)"


def _mean(column: str) -> str:
    return f"round(fsum({column}) / count({column}), 6)"


def _statistics(table: str, keys: str = "") -> str:
    grouped = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {keys + ',' if keys else ''} count(*) AS total_trips,
  {_total("fare_amount")} AS total_fare, {_mean("trip_distance")} AS avg_distance,
  {_mean("trip_duration_minutes")} AS avg_duration, {_mean("avg_speed_mph")} AS avg_speed,
  {_mean("fare_per_mile")} AS avg_fare_per_mile FROM {table}{grouped}"""


def _rule_results(group: str | None) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{g}' AS rule_group, '{name}' AS rule,
  count(*) FILTER (WHERE {holds}) AS passed, count(*) FILTER (WHERE NOT ({holds})) AS broken,
  count(*) FILTER (WHERE ({holds}) IS NULL) AS undecided FROM trips"""
        for name, (g, holds) in RULES.items()
        if group in (None, g)
    )


def _alerts(min_quality: float, max_quarantine: float) -> str:
    return f"""SELECT batch_month, alert, input_rows, quality_rate, quarantine_rate
  FROM (SELECT *, unnest(['quarantine_rate', 'quality_rate']) AS alert FROM quality)
  WHERE CASE alert WHEN 'quarantine_rate' THEN quarantine_rate > {max_quarantine}
                   ELSE quality_rate < {min_quality} END"""


_FILLED = (
    "VendorID",
    "tpep_pickup_datetime",
    "tpep_dropoff_datetime",
    "passenger_count",
    "trip_distance",
    "fare_amount",
    "PULocationID",
    "DOLocationID",
)
_COLUMN_LIST = [name.strip() for name in TRIP_COLUMNS.split(",")]

_PER_MONTH_VALID = "SELECT batch_month, count(*) AS rows FROM valid GROUP BY batch_month"
_REJECTED_ROWS = f"SELECT {TRIP_COLUMNS}, quarantine_reason FROM rejected_once"
_FEATURES = """pickup_year, pickup_month, pickup_day, pickup_hour, pickup_dayofweek, pickup_week,
  is_weekend, ds"""
_METRICS = """trip_duration_minutes, avg_speed_mph, fare_per_mile, tip_percentage,
  cost_per_passenger"""
_CLEAN_ROWS = f"""SELECT {TRIP_COLUMNS}, strftime(pickup_date, '%Y-%m-%d') AS pickup_date,
  {_FEATURES}, {_METRICS} FROM clean"""

_BODIES: dict[str, str] = {
    # scans and sources
    "landing_read": f"SELECT {TRIP_COLUMNS} FROM trips",
    "landing_read_csv": f"SELECT {TRIP_COLUMNS} FROM ({_retyped('trips')})",
    "landing_read_json": f"SELECT {TRIP_COLUMNS} FROM ({_retyped('trips')})",
    "raw_read": f"SELECT {TRIP_COLUMNS} FROM valid",
    "landing_trace": """SELECT batch_month, count(*) AS rows, count(*) AS traced_rows,
  CAST(1 AS BIGINT) AS run_times FROM trips GROUP BY batch_month""",
    "landing_manifest": """SELECT batch_month AS date_param, count(*) AS rows,
  TRUE AS has_bytes FROM trips GROUP BY batch_month""",
    "landing_mixed_files": """SELECT batch_month, count(*) AS rows,
  count(airport_fee) FILTER (WHERE coalesce(payment_type % 2 <> 0, TRUE)) AS fees,
  count(*) FILTER (WHERE coalesce(payment_type % 2 <> 0, TRUE)) AS notes
  FROM trips GROUP BY batch_month""",
    "landing_csv_reordered": f"SELECT {TRIP_COLUMNS} FROM ({_retyped('trips')})",
    "landing_json_broken": """SELECT batch_month, count(*) + 1 AS rows, count(*) AS notes,
  '{"VendorID": ' || batch_month AS line, 'multiple_issues' AS reason
  FROM trips GROUP BY batch_month""",
    "batch_status": """SELECT strftime(m, '%Y-%m') AS batch_month,
  CASE WHEN m = last THEN 'failed' WHEN rows IS NULL THEN 'skip' ELSE 'ready' END AS status,
  coalesce(rows, 0) AS rows
  FROM (SELECT unnest(generate_series(first, last, INTERVAL 1 MONTH)) AS m, last
        FROM (SELECT CAST(min(batch_month) || '-01' AS TIMESTAMP) - INTERVAL 1 MONTH AS first,
                     CAST(max(batch_month) || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH AS last
              FROM trips))
  LEFT JOIN (SELECT batch_month, count(*) AS rows FROM trips GROUP BY batch_month)
    ON strftime(m, '%Y-%m') = batch_month""",
    "arrival_once": """SELECT batch_month, input_rows, valid_rows,
  CASE WHEN batch_month < '1998-07' THEN 1 ELSE 2 END AS arrival FROM monthly""",
    "arrival_changes": """SELECT batch_month, input_rows, valid_rows,
  CASE WHEN batch_month < '1998-07' THEN 2 ELSE 1 END AS arrival FROM monthly
  UNION ALL SELECT '2030-01', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0""",
    "partition_pruned_scan": """SELECT ds, count(*) AS trip_count FROM clean
  WHERE ds BETWEEN '1995-02-01' AND '2001-09-30' GROUP BY ds""",
    # sinks and catalog
    "raw_zone_roundtrip": f"SELECT {TRIP_COLUMNS} FROM valid",
    "quarantine_zone_roundtrip": f"{_REJECTED_ROWS.replace('FROM', ', strftime(tpep_pickup_datetime, $$%Y-%m-%d$$) AS ds FROM')}",
    "quarantine_missing_columns": """SELECT 'missing_columns' AS quarantine_reason, batch_month,
  count(*) AS rows, CAST(0 AS BIGINT) AS raw_rows, TRUE AS raised FROM trips
  GROUP BY batch_month""",
    "quarantine_table": """SELECT quarantine_reason, count(*) AS count FROM rejected_once
  GROUP BY quarantine_reason""",
    "structured_added_column": """SELECT batch_month, count(*) AS rows,
  CASE WHEN batch_month >= '1998-07' THEN count(*) ELSE 0 END AS fees FROM clean
  GROUP BY batch_month""",
    "structured_retyped_column": """SELECT batch_month, count(*) AS rows, count(*) AS codes,
  min(code) AS first_code, max(code) AS last_code FROM (SELECT batch_month,
    CASE WHEN batch_month < '1998-07' THEN CAST(PULocationID AS VARCHAR)
         ELSE 'Z' || lpad(CAST(PULocationID AS VARCHAR), 4, '0') END AS code FROM clean)
  GROUP BY batch_month""",
    "structured_drift": """SELECT 'zone_code' AS column_name, 'retyped' AS kind,
  count(*) AS filled_rows, 'bigint,string' AS types FROM clean""",
    "raw_retyped_column": """SELECT CAST(CASE WHEN batch_month < '1998-07'
      THEN length(CAST(PULocationID AS VARCHAR)) ELSE 5 END AS INTEGER) AS digits, count(*) AS rows
  FROM valid GROUP BY 1""",
    "structured_append_batches": """SELECT batch_month, ds, 2 * count(*) AS trip_count FROM clean
  GROUP BY batch_month, ds""",
    "structured_append": "SELECT ds, 2 * count(*) AS trip_count FROM clean GROUP BY ds",
    "structured_replace": """SELECT batch_month, ds, count(*) AS trip_count FROM clean
  GROUP BY batch_month, ds""",
    "sized_write": """SELECT batch_month, count(*) AS rows, TRUE AS within_size,
  count(*) > 100 AS was_split FROM clean GROUP BY batch_month""",
    "catalog_repair": """SELECT 'before' AS moment, count(*) FILTER (WHERE batch_month < '1998-07')
  AS trips FROM clean UNION ALL SELECT 'after', count(*) FROM clean""",
    "schema_drift": """SELECT 'cbd_congestion_fee' AS column_name, 'added' AS kind,
  count(*) FILTER (WHERE batch_month >= '1998-07') AS filled_rows FROM trips
  UNION ALL SELECT 'airport_fee', 'missing', 0 UNION ALL """
    + " UNION ALL ".join(
        f"SELECT '{name}', 'retyped', count({name}) FROM trips"
        for name in "passenger_count RatecodeID PULocationID DOLocationID payment_type "
        "tpep_pickup_datetime tpep_dropoff_datetime".split()
    ),
    # projections
    "typed_trips": f"""SELECT * EXCLUDE (congestion_surcharge, airport_fee)
  FROM ({_retyped('trips')})""",
    "typed_trips_optional": f"""SELECT VendorID, tpep_pickup_datetime, airport_fee, batch_month
  FROM ({_retyped('trips')})""",
    "split_datetime": """SELECT VendorID, payment_type, fare_amount,
  strftime(tpep_pickup_datetime, '%Y-%m-%d') AS pickup_date,
  strftime(tpep_pickup_datetime, '%H:%M:%S') AS pickup_time,
  strftime(tpep_dropoff_datetime, '%Y-%m-%d') AS dropoff_date,
  strftime(tpep_dropoff_datetime, '%H:%M:%S') AS dropoff_time FROM trips""",
    # quality
    "schema_check": " UNION ALL ".join(
        f"""SELECT '{name}' AS column_name, {str(name != 'fare_amount').upper()} AS present,
  {'CAST(0 AS BIGINT)' if name == 'fare_amount' else f'count({name})'} AS filled_rows,
  count(*) AS rows FROM trips"""
        for name in _FILLED
    ),
    "rule_nulls": _rule_results("nulls"),
    "rule_non_negative": _rule_results("non_negative"),
    "rule_temporal": _rule_results("temporal"),
    "rule_range": _rule_results("range"),
    "rule_location": _rule_results("location"),
    "valid_trips": f"SELECT {TRIP_COLUMNS} FROM valid",
    "invalid_trips": f"SELECT {TRIP_COLUMNS} FROM rejected_once",
    "invalid_trips_maps": f"""SELECT {TRIP_COLUMNS}, fare_amount AS charged_fare,
  extra AS charged_extra FROM rejected_once""",
    "invalid_trips_maps_except": "SELECT CAST(2 AS INTEGER) AS entries, count(*) AS rows FROM rejected_once",
    "invalid_trips_except": f"SELECT {TRIP_COLUMNS} FROM trips EXCEPT SELECT {TRIP_COLUMNS} FROM valid",
    "quarantine_reason": f"SELECT {TRIP_COLUMNS}, quarantine_reason FROM rejected",
    "failed_rules": f"""SELECT VendorID, batch_month, quarantine_reason,
  unnest({_FAILED_LIST}) AS rule FROM rejected""",
    "quality_metrics": """SELECT input_rows, valid_rows, rejected_rows, invalid_rows,
  valid_rows / input_rows * 100 AS quality_rate, 100 - valid_rows / input_rows * 100 AS invalid_rate,
  CASE WHEN valid_rows / input_rows * 100 >= 95 THEN 'SUCCESS' ELSE 'WARNING' END AS status
  FROM (SELECT (SELECT count(*) FROM trips) AS input_rows, (SELECT count(*) FROM valid) AS valid_rows,
    (SELECT count(*) FROM rejected) AS rejected_rows,
    (SELECT count(*) FROM rejected_once) AS invalid_rows)""",
    "quarantine_by_reason": """SELECT quarantine_reason, count(*) AS count FROM rejected_once
  GROUP BY quarantine_reason""",
    "quarantine_reason_share": """SELECT quarantine_reason, count(*) AS count,
  count(*) / (SELECT count(*) FROM rejected_once) * 100 AS share_pct FROM rejected_once
  GROUP BY quarantine_reason""",
    "failures_by_rule": " UNION ALL ".join(
        f"""SELECT '{name}' AS rule,
  count(*) FILTER (WHERE NOT coalesce({holds}, FALSE)) AS failures FROM trips"""
        for name, (_, holds) in RULES.items()
    ),
    "quarantine_by_ds": """SELECT strftime(tpep_pickup_datetime, '%Y-%m-%d') AS ds,
  count(*) AS quarantine_count FROM rejected_once GROUP BY 1""",
    # features and outliers
    "time_features": f"""SELECT VendorID, tpep_pickup_datetime,
  strftime(pickup_date, '%Y-%m-%d') AS pickup_date, {_FEATURES} FROM featured""",
    "trip_metrics": f"SELECT VendorID, fare_amount, trip_distance, {_METRICS} FROM featured",
    "clean_trips": _CLEAN_ROWS,
    "outlier_breakdown": f"""SELECT CASE
    WHEN trip_distance <= 0 THEN 'distance_too_low' WHEN trip_distance >= 100 THEN 'distance_too_high'
    WHEN fare_amount <= 0 THEN 'fare_too_low' WHEN fare_amount >= 500 THEN 'fare_too_high'
    WHEN trip_duration_minutes <= 0 THEN 'duration_too_low'
    WHEN trip_duration_minutes >= 1440 THEN 'duration_too_high'
    WHEN avg_speed_mph <= 0 THEN 'speed_too_low' WHEN avg_speed_mph >= 100 THEN 'speed_too_high'
    END AS broken_limit, count(*) AS rows FROM featured WHERE NOT ({_INLIERS}) GROUP BY 1""",
    "outlier_metrics": """SELECT input_rows, clean_rows, input_rows - clean_rows AS outliers_removed,
  (input_rows - clean_rows) / input_rows * 100 AS outlier_pct
  FROM (SELECT (SELECT count(*) FROM featured) AS input_rows,
               (SELECT count(*) FROM clean) AS clean_rows)""",
    "batch_stats": _statistics("clean"),
    # reports
    "total_trips": "SELECT count(*) AS total_trips FROM clean",
    "trips_by_ds": "SELECT ds, count(*) AS trip_count FROM clean GROUP BY ds",
    "trips_by_month": f"""SELECT pickup_year, pickup_month, count(*) AS trip_count,
  round({_total("fare_amount")}, 2) AS total_fare, round({_mean("trip_distance")}, 2) AS avg_distance
  FROM clean GROUP BY pickup_year, pickup_month""",
    "trips_by_hour": f"""SELECT pickup_hour, count(*) AS trips, {_mean("fare_amount")} AS avg_fare
  FROM clean GROUP BY pickup_hour""",
    "trips_by_payment_type": """SELECT payment_type, count(*) AS trips FROM clean
  GROUP BY payment_type""",
    "max_distance_by_year": """SELECT pickup_year, max(trip_distance) AS max_dist FROM clean
  GROUP BY pickup_year""",
    "null_audit": " UNION ALL ".join(
        f"""SELECT '{name}' AS column_name, count(*) AS total,
  count(*) FILTER (WHERE {name} IS NULL) AS nulls FROM clean"""
        for name in [*_COLUMN_LIST, "pickup_hour", "ds", "avg_speed_mph", "tip_percentage"]
    ),
    "partition_row_counts": """SELECT batch_month, ds, count(*) AS trip_count FROM clean
  GROUP BY batch_month, ds""",
    "out_of_batch_rows": """SELECT batch_month, ds[1:7] AS ds_month, count(*) AS trip_count
  FROM clean WHERE batch_month <> ds[1:7] GROUP BY 1, 2""",
    "quality_over_time": "SELECT * FROM quality",
    "quality_after_late_file": "SELECT * FROM quality",
    "quality_alerts": _alerts(95, 5),
    "quality_alerts_tight": _alerts(98, 2.5),
    # jobs
    "job_landing_to_raw": "SELECT * FROM quality",
    "job_raw_to_structured": _statistics("clean", "batch_month"),
    "run_month": """SELECT '2001-12' AS batch_month, ds, count(*) AS trip_count
  FROM clean GROUP BY ds""",
    "run_range": """SELECT batch_month, input_rows, clean_rows,
  input_rows - clean_rows AS outliers_removed,
  (input_rows - clean_rows) / input_rows * 100 AS outlier_pct
  FROM (SELECT batch_month, count(*) AS input_rows FROM featured GROUP BY 1)
  JOIN (SELECT batch_month, count(*) AS clean_rows FROM clean GROUP BY 1) USING (batch_month)""",
    "second_source": _CLEAN_ROWS,
    # remediation
    "remediate_types": f"""SELECT CAST(VendorID AS INTEGER) AS VendorID, tpep_pickup_datetime,
  tpep_dropoff_datetime, CAST(trunc(passenger_count) AS INTEGER) AS passenger_count, trip_distance,
  CAST(PULocationID AS INTEGER) AS PULocationID, CAST(DOLocationID AS INTEGER) AS DOLocationID,
  fare_amount, batch_month,
  CASE WHEN DOLocationID % 3 <> 0 THEN ''
       WHEN fare_amount IS NULL THEN
         CASE WHEN coalesce(tpep_pickup_datetime, tpep_dropoff_datetime) IS NULL THEN ''
              ELSE 'time_format' END
       WHEN coalesce(tpep_pickup_datetime, tpep_dropoff_datetime) IS NULL THEN 'number_format'
       ELSE 'number_format,time_format' END AS repairs FROM trips""",
    "remediate_values": "SELECT * FROM repaired",
    "remediate_promote": """SELECT batch_month, promoted_rows, remaining_rows, clean_rows FROM
  (SELECT batch_month, count(*) AS clean_rows FROM
    (SELECT batch_month FROM clean UNION ALL SELECT batch_month FROM clean_promoted) GROUP BY 1)
  LEFT JOIN (SELECT batch_month, count(*) AS all_repaired FROM repaired GROUP BY 1) USING (batch_month)
  LEFT JOIN (SELECT batch_month, count(*) AS some_promoted FROM promoted GROUP BY 1)
    USING (batch_month),
  LATERAL (SELECT coalesce(some_promoted, 0) AS promoted_rows,
                  coalesce(all_repaired, 0) - coalesce(some_promoted, 0) AS remaining_rows)""",
    "remediation_report": f"""SELECT original_reason,
  count(*) FILTER (WHERE coalesce({_VALID}, FALSE)) AS recovered,
  count(*) FILTER (WHERE NOT coalesce({_VALID}, FALSE)) AS remaining
  FROM repaired GROUP BY original_reason""",
}

# Queries with whole rows, where the numbers a rejected row may lack go as doubles.
_WHOLE_ROWS = (
    "landing_read landing_read_csv landing_csv_reordered landing_read_json raw_read raw_zone_roundtrip "
    "quarantine_zone_roundtrip typed_trips valid_trips invalid_trips invalid_trips_maps "
    "invalid_trips_except "
    "quarantine_reason clean_trips second_source remediate_types remediate_values"
).split()
for _name in _WHOLE_ROWS:
    _BODIES[_name] = f"""SELECT * REPLACE (CAST(passenger_count AS DOUBLE) AS passenger_count,
  CAST(PULocationID AS DOUBLE) AS PULocationID) FROM ({_BODIES[_name]})"""

ORACLE: dict[str, str] = {name: _with(body) for name, body in _BODIES.items()}
