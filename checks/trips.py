"""Trip records with a fixed share of faults, derived from every row of ``lineitem``.

One SQL text serves Spark and DuckDB. ``m`` numbers the fault of a row (see
FIXTURES.md); the rows with m in (4, 100) appear twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.sources.sinks import size_for_write

_READ = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_tax l_shipdate".split()

_TRIPS = """
SELECT
  1 + l_linenumber % 2 AS VendorID,
  CASE WHEN m = 0 THEN NULL ELSE pu0 END AS tpep_pickup_datetime,
  pu0 + dur_s * INTERVAL '1' SECOND AS tpep_dropoff_datetime,
  CAST(CASE WHEN m = 15 THEN NULL WHEN m IN (6, 7, 18) THEN 0 WHEN m = 16 THEN 9
            ELSE 1 + CAST(l_quantity AS BIGINT) % 6 END AS DOUBLE) AS passenger_count,
  CAST(dist_t AS DOUBLE) / 10 AS trip_distance,
  CAST(1 + l_orderkey % 6 AS DOUBLE) AS RatecodeID,
  CASE WHEN m = 17 THEN NULL WHEN m = 13 THEN 264 ELSE 1 + l_partkey % 263 END AS PULocationID,
  CASE WHEN m = 14 THEN 0 ELSE 1 + l_suppkey % 263 END AS DOLocationID,
  1 + l_orderkey % 4 AS payment_type,
  CAST(fare_c AS DOUBLE) / 100 AS fare_amount,
  CAST(extra_c AS DOUBLE) / 100 AS extra,
  CAST(0.5 AS DOUBLE) AS mta_tax,
  CAST(fare_c * tip_pct AS DOUBLE) / 10000 AS tip_amount,
  CAST(toll_c AS DOUBLE) / 100 AS tolls_amount,
  CAST(1.0 AS DOUBLE) AS improvement_surcharge,
  CAST(fare_c * (100 + tip_pct) + 100 * (extra_c + 400 + toll_c + air_c) AS DOUBLE) / 10000
    AS total_amount,
  CAST(2.5 AS DOUBLE) AS congestion_surcharge,
  CAST(air_c AS DOUBLE) / 100 AS airport_fee,
  {month} AS batch_month
FROM (
  SELECT *,
    CASE WHEN m = 2 THEN NULL WHEN m IN (4, 18) THEN -250 WHEN m = 12 THEN 100000
         WHEN m = 21 THEN 60000 WHEN m = 24 THEN 0
         ELSE 300 + 25 * pk + l_suppkey % 100 END AS fare_c,
    CASE WHEN m = 3 THEN NULL WHEN m = 5 THEN -10 WHEN m = 11 THEN 5000 WHEN m = 19 THEN 0
         WHEN m = 20 THEN 1500 ELSE 5 + pk END AS dist_t,
    CASE WHEN m = 1 THEN NULL WHEN m = 8 THEN 0 WHEN m IN (9, 10) THEN -600
         WHEN m = 22 THEN 90000 WHEN m = 23 THEN 10
         ELSE 390 + 18 * pk + l_suppkey % 60 END AS dur_s,
    CASE WHEN m = 25 THEN l_shipdate + INTERVAL '40' DAY
         ELSE l_shipdate + (l_orderkey % 1440) * INTERVAL '1' MINUTE END AS pu0,
    CAST(l_tax * 100 + 10 AS BIGINT) AS tip_pct,
    50 * (l_orderkey % 3) AS extra_c,
    CASE WHEN l_partkey % 10 = 0 THEN 694 ELSE 0 END AS toll_c,
    CASE WHEN l_suppkey % 20 = 0 THEN 175 ELSE 0 END AS air_c,
    {copies} AS copy
  FROM (
    SELECT *,
      (l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber) % 1000 AS m,
      l_partkey % 300 AS pk
    FROM {lineitem}
  ) numbered
) helped
"""

SPARK_TRIPS = _TRIPS.replace("{month}", "date_format(l_shipdate, 'yyyy-MM')").replace(
    "{copies}", "explode(sequence(1, CASE WHEN m IN (4, 100) THEN 2 ELSE 1 END))"
)
DUCKDB_TRIPS = (
    _TRIPS.replace("{month}", "strftime(l_shipdate, '%Y-%m')")
    .replace("{copies}", "unnest(generate_series(1, CASE WHEN m IN (4, 100) THEN 2 ELSE 1 END))")
    .replace("{lineitem}", "lineitem")
)


def derive_trips(spark: SparkSession, sf_dir: str, gather: bool = False) -> DataFrame:
    """All trips, in landing types, with their ``batch_month``.

    ``gather`` brings the rows of a month together, before most columns are there.
    """
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_READ)
    if gather:
        lineitem = size_for_write(lineitem.withColumn("ship_month", F.trunc("l_shipdate", "month")), "ship_month")
    return spark.sql(SPARK_TRIPS, lineitem=lineitem)


def text_trips(df: DataFrame) -> DataFrame:
    """The trips as text, a part of them in formats a strict cast does not read.

    Every third drop-off zone writes fares as ``$1,234.50`` and times the US way;
    every fifth pickup zone pads its distances.
    """
    odd_format = F.col("DOLocationID") % 3 == 0
    padded = F.coalesce(F.col("PULocationID") % 5 == 0, F.lit(False))
    plain = {name: F.col(name).cast("string") for name in df.columns}
    us_time = {
        name: F.when(odd_format, F.date_format(name, "MM/dd/yyyy HH:mm:ss")).otherwise(plain[name])
        for name in ("tpep_pickup_datetime", "tpep_dropoff_datetime")
    }
    money = F.concat(F.lit("$"), F.format_number("fare_amount", 2))
    return df.withColumns(
        {
            **plain,
            **us_time,
            "fare_amount": F.when(odd_format, money).otherwise(plain["fare_amount"]),
            "trip_distance": F.when(
                padded, F.concat(F.lit("  "), plain["trip_distance"], F.lit(" "))
            ).otherwise(plain["trip_distance"]),
        }
    )
