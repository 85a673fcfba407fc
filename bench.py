"""Time the jobs and reports; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. With
``BENCH_BASELINE=1`` the line also has ``baseline``: the same two jobs written the
plain way, with one action per figure and per output. The ``job_`` keys run over all
monthly files at once, the ``one_month_`` keys over all trips delivered as one file.
Every query runs twice and the second run counts.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.lake import RUN_TS, empty_lake, fresh_lake, land
from checks.queries import QUERIES
from checks.trips import derive_trips
from zoneflow import storage
from zoneflow.config import LANDING, QUARANTINE, RAW, STRUCTURED, SourceConfig
from zoneflow.functions.rules import reason, trip_rules
from zoneflow.operators.enrich import enrich, remove_outliers
from zoneflow.operators.quality import valid_rows
from zoneflow.plans import reports
from zoneflow.plans.pipeline import landing_to_raw, raw_to_structured
from zoneflow.session import SETTINGS
from zoneflow.sources.zones import batch_month, read_batches, read_structured, with_trace

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
OPERATORS = (
    "quality_metrics quarantine_by_reason quarantine_reason_share failures_by_rule "
    "invalid_trips outlier_metrics batch_stats null_audit remediation_report"
).split()


def build() -> SparkSession:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("zoneflow-bench")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(run: Callable[[], object]) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def second_run(run: Callable[[], object]) -> float:
    run()
    return round(seconds(run), 3)


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def plain_landing_to_raw(spark: SparkSession, cfg: SourceConfig) -> None:
    """Six actions over the landing zone, rejected rows by EXCEPT."""
    landed_rows = with_trace(read_batches(spark, cfg, LANDING), RUN_TS)
    landed_rows.count()
    valid = valid_rows(landed_rows)
    invalid = landed_rows.subtract(valid)
    valid.count()
    invalid.count()
    labelled = invalid.withColumn("quarantine_reason", reason(trip_rules(invalid.schema)))
    labelled.groupBy("quarantine_reason").count().collect()
    for rows, zone in ((labelled, QUARANTINE), (valid, RAW)):
        rows.write.mode("overwrite").partitionBy("year", "month").parquet(cfg.zone_root(zone))


def plain_raw_to_structured(spark: SparkSession, cfg: SourceConfig) -> None:
    """Four actions over the raw zone, output coalesced by its row count."""
    raw = spark.read.parquet(cfg.zone_root(RAW)).withColumn("batch_month", batch_month())
    raw.count()
    clean = remove_outliers(enrich(raw.drop("year", "month")))
    files = max(1, clean.count() // 100_000)
    clean.coalesce(files).write.mode("overwrite").partitionBy("ds").parquet(
        cfg.zone_root(STRUCTURED)
    )
    clean.agg(
        F.count("*"),
        F.sum("fare_amount"),
        F.avg("trip_distance"),
        F.avg("trip_duration_minutes"),
        F.avg("avg_speed_mph"),
        F.avg("fare_per_mile"),
    ).collect()


def one_month_lake(spark: SparkSession, label: str) -> SourceConfig:
    """All trips delivered as one month: what a single run of the jobs is made for."""
    cfg = empty_lake(spark, label)
    land(derive_trips(spark, SF_DIR).withColumn("batch_month", F.lit("2001-12")), cfg)
    return cfg


def time_jobs(spark: SparkSession, cfg: SourceConfig) -> dict[str, float]:
    months = storage.batch_months(spark, cfg, LANDING)
    return {
        "landing_to_raw": second_run(
            lambda: landing_to_raw(spark, cfg, months, RUN_TS).quality().collect()
        ),
        "raw_to_structured": second_run(
            lambda: raw_to_structured(spark, cfg, months).structured().collect()
        ),
    }


def time_plain_jobs(spark: SparkSession, cfg: SourceConfig) -> dict[str, float]:
    return {
        "landing_to_raw": second_run(lambda: plain_landing_to_raw(spark, cfg)),
        "raw_to_structured": second_run(lambda: plain_raw_to_structured(spark, cfg)),
    }


def main() -> None:
    spark = build()
    cfg = fresh_lake(spark, SF_DIR, "bench")
    month = one_month_lake(spark, "bench-month")
    times = {
        **{f"job_{name}": took for name, took in time_jobs(spark, cfg).items()},
        **{f"one_month_{name}": took for name, took in time_jobs(spark, month).items()},
    }
    structured = read_structured(spark, month)
    for name in ("trips_by_month", "trips_by_hour"):
        times[name] = second_run(lambda name=name: reports.trip_report(name, structured).collect())
    for name in OPERATORS:
        times[name] = second_run(lambda name=name: consume(QUERIES[name](spark, SF_DIR)))

    extra: dict[str, object] = {}
    if os.environ.get("BENCH_BASELINE") == "1":
        plain = fresh_lake(spark, SF_DIR, "bench-plain")
        single = replace(empty_lake(spark, "plain-month"), landing_root=month.root)
        extra["baseline"] = {
            **{f"job_{name}": took for name, took in time_plain_jobs(spark, plain).items()},
            **{f"one_month_{name}": took for name, took in time_plain_jobs(spark, single).items()},
        }
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")),
                **extra,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
