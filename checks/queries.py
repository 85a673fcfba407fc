"""One query per operator, each over all rows of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.lake import (
    RUN_TS,
    deliver_again,
    empty_lake,
    fresh_lake,
    full_lake,
    land,
    landed,
    retyped_lake,
    span,
    trips,
)
from checks.trips import derive_trips, text_trips
from zoneflow import storage
from zoneflow.config import (
    DROPOFF,
    LANDING,
    MALFORMED,
    PICKUP,
    PROMOTED,
    QUARANTINE,
    RAW,
    STRUCTURED,
    UNRESOLVED,
    QualityTargets,
)
from zoneflow.operators import casts, contract, enrich, quality, remediation
from zoneflow.plans import monitoring, pipeline, reports
from zoneflow.plans.remediation import promote
from zoneflow.sources import manifest, sinks, zones
from zoneflow.streaming.arrivals import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HALFWAY = "1998-07"
ROWLESS = "2030-01"
ROWS_PER_FILE = 100
LATER = RUN_TS + timedelta(days=1)


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


MAYBE_NULL_IDS = ("passenger_count", "PULocationID")


def comparable(df: DataFrame) -> DataFrame:
    """Plain types, so that any engine's result compares.

    Times go without zone, dates as text, and the numbers a rejected row may lack
    as doubles, since a client may show an integer column with NULLs either way.
    """
    plain: dict[str, Column] = {}
    for field in df.schema:
        if field.name in MAYBE_NULL_IDS:
            plain[field.name] = F.col(field.name).cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            plain[field.name] = F.col(field.name).cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DateType):
            plain[field.name] = F.col(field.name).cast("string")
    return df.withColumns(plain) if plain else df


def untraced(df: DataFrame) -> DataFrame:
    return df.drop("ingestion_timestamp", "source_file", "failed_rules")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Averages and sums to a stated precision, so that any engine's result compares."""
    return df.withColumns(
        {f.name: F.round(f.name, digits) for f in df.schema if f.dataType == T.DoubleType()}
    )


def rows_by(df: DataFrame, *keys: str, name: str = "rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.valid_rows(trips(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.structure(raw_trips(spark, sf_dir))


def clean_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, brought together for a write by day."""
    directories = sinks.DAYS_PER_MONTH * len(_months_of(spark, sf_dir))
    return enrich.structure(sinks.gather_days(raw_trips(spark, sf_dir), directories))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.split_quality(trips(spark, sf_dir))[1]


# --- scans and sources ---------------------------------------------------------------


@query
def landing_read(spark, sf_dir):
    return comparable(zones.read_landing(spark, landed(spark, sf_dir)))


@query
def landing_read_csv(spark, sf_dir):
    cfg = empty_lake(spark, "csv", "csv")
    land(derive_trips(spark, sf_dir, gather=True), cfg)
    return comparable(casts.cast_trips(zones.read_landing(spark, cfg).drop(MALFORMED)))


@query
def landing_read_json(spark, sf_dir):
    cfg = empty_lake(spark, "json", "json")
    land(derive_trips(spark, sf_dir, gather=True), cfg)
    return comparable(casts.cast_trips(zones.read_landing(spark, cfg).drop(MALFORMED)))


@query
def raw_read(spark, sf_dir):
    return comparable(untraced(zones.read_raw(spark, full_lake(spark, sf_dir))))


@query
def landing_trace(spark, sf_dir):
    traced = zones.read_landing(spark, landed(spark, sf_dir), run_ts=RUN_TS)
    own_file = F.col("source_file").contains(
        F.concat(F.lit("/year="), F.replace("batch_month", F.lit("-"), F.lit("/month=")))
    )
    return traced.groupBy("batch_month").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(own_file).alias("traced_rows"),
        F.count_distinct("ingestion_timestamp").alias("run_times"),
    )


@query
def landing_manifest(spark, sf_dir):
    """Rows of the listed files, by month; a file left out would be missed here."""
    cfg = landed(spark, sf_dir)
    files = manifest.landing_manifest(spark, cfg)
    traced = rows_by(zones.read_landing(spark, cfg, run_ts=RUN_TS), "source_file")
    return (
        files.join(traced, "source_file", "left")
        .groupBy("date_param")
        .agg(F.sum("rows").alias("rows"), (F.min("file_size_bytes") > 0).alias("has_bytes"))
    )


@query
def batch_status(spark, sf_dir):
    """All landed months, one before them, and one after with a file that is none."""
    cfg = empty_lake(spark, "status")
    land(trips(spark, sf_dir), cfg)
    months = span(spark, cfg)
    rubbish = spark.createDataFrame([("rubbish rubbish PAR1",)], "value string")
    rubbish.write.text(cfg.batch_path(LANDING, months[-1]))
    return manifest.batch_status(spark, cfg, months).drop("files", "broken")


@query
def landing_mixed_files(spark, sf_dir):
    """Files of one month that each lack a column of the other."""
    cfg = empty_lake(spark, "mixed")
    all_trips = trips(spark, sf_dir)
    even = F.coalesce(F.col("payment_type") % 2 == 0, F.lit(False))
    land(all_trips.filter(even).drop("airport_fee"), cfg)
    land(all_trips.filter(~even).withColumn("note", F.lit("odd")), cfg)
    return zones.read_landing(spark, cfg).groupBy("batch_month").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("airport_fee").alias("fees"),
        F.count("note").alias("notes"),
    )


@query
def landing_csv_reordered(spark, sf_dir):
    """CSV files of one month with their columns in another order."""
    cfg = empty_lake(spark, "reordered", "csv")
    all_trips = derive_trips(spark, sf_dir, gather=True)
    even = F.coalesce(F.col("payment_type") % 2 == 0, F.lit(False))
    land(all_trips.filter(even), cfg)
    land(all_trips.filter(~even).select(*reversed(all_trips.columns)), cfg)
    typed = casts.cast_trips(zones.read_landing(spark, cfg).drop(MALFORMED))
    return comparable(typed.select(*trips(spark, sf_dir).columns))


@query
def landing_json_broken(spark, sf_dir):
    """JSON with a key outside the contract, and a broken line for every month."""
    cfg = empty_lake(spark, "broken", "json")
    all_trips = derive_trips(spark, sf_dir)
    land(derive_trips(spark, sf_dir, gather=True).withColumn("note", F.lit("kept")), cfg)
    broken = all_trips.select("batch_month").distinct()
    lines = broken.select("batch_month", F.concat(F.lit('{"VendorID": '), "batch_month").alias("value"))
    month = F.split("batch_month", "-")
    parts = lines.select("value", month[0].alias("year"), month[1].alias("month"))
    parts.write.mode("append").partitionBy("year", "month").text(cfg.zone_root(LANDING))
    tagged = quality.tag_quality(zones.read_landing(spark, cfg))
    unreadable = F.array_contains("failed_rules", "readable")
    return tagged.groupBy("batch_month").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("note").alias("notes"),
        F.max(F.when(unreadable, F.col(MALFORMED))).alias("line"),
        F.max(F.when(unreadable, F.col("quarantine_reason"))).alias("reason"),
    )


@query
def arrival_once(spark, sf_dir):
    """Two deliveries, each followed by a run of the stream over one checkpoint."""
    cfg = empty_lake(spark, "arrivals")
    checkpoint = storage.scratch_dir(spark, "arrivals-checkpoint")
    all_trips = trips(spark, sf_dir)
    early = F.col("batch_month") < HALFWAY
    for delivery, moment in ((all_trips.filter(early), RUN_TS), (all_trips.filter(~early), LATER)):
        land(delivery, cfg)
        ingest_stream(spark, cfg, checkpoint, moment).awaitTermination()
    processed = monitoring.quality_over_time(spark, cfg).select("batch_month", "input_rows", "valid_rows")
    runs = zones.read_raw(spark, cfg).groupBy("batch_month").agg(
        F.when(F.max("ingestion_timestamp") == F.lit(RUN_TS), 1)
        .when(F.min("ingestion_timestamp") == F.lit(LATER), 2)
        .alias("arrival")
    )
    return processed.join(runs, "batch_month", "left")


@query
def arrival_changes(spark, sf_dir):
    """All months, then the early ones again under their old file names, and one without rows."""
    cfg = empty_lake(spark, "changes")
    checkpoint = storage.scratch_dir(spark, "changes-checkpoint")
    all_trips = trips(spark, sf_dir)
    land(all_trips, cfg)
    ingest_stream(spark, cfg, checkpoint, RUN_TS).awaitTermination()
    early = [m for m in storage.batch_months(spark, cfg, LANDING) if m < HALFWAY]
    files = [file for m in early for file in storage.files(spark, cfg.batch_path(LANDING, m))]
    deliver_again(spark, files, storage.scratch_dir(spark, "again"))
    empty = all_trips.drop("batch_month").limit(0)
    empty.write.parquet(cfg.batch_path(LANDING, ROWLESS))
    ingest_stream(spark, cfg, checkpoint, LATER).awaitTermination()
    processed = monitoring.quality_over_time(spark, cfg).select("batch_month", "input_rows", "valid_rows")
    runs = zones.read_raw(spark, cfg).groupBy("batch_month").agg(
        F.when(F.min("ingestion_timestamp") == F.lit(LATER), 2)
        .when(F.max("ingestion_timestamp") == F.lit(RUN_TS), 1)
        .alias("arrival")
    )
    return processed.join(runs, "batch_month", "left").fillna(0, "arrival")


@query
def partition_pruned_scan(spark, sf_dir):
    scan = zones.trips_between(spark, full_lake(spark, sf_dir), "1995-02-01", "2001-09-30")
    return rows_by(scan, "ds", name="trip_count")


# --- sinks and catalog ---------------------------------------------------------------


def _with_path_columns(df: DataFrame) -> DataFrame:
    month = F.split("batch_month", "-")
    return df.withColumns({"year": month[0], "month": month[1]}).drop("batch_month")


def _months_of(spark: SparkSession, sf_dir: str) -> list[str]:
    return storage.batch_months(spark, landed(spark, sf_dir), LANDING)


@query
def raw_zone_roundtrip(spark, sf_dir):
    cfg = empty_lake(spark, "raw")
    months = _months_of(spark, sf_dir)
    valid = _with_path_columns(raw_trips(spark, sf_dir))
    for _ in range(2):
        sinks.write_batches(valid, cfg, RAW, months, gather=True)
    return comparable(zones.read_raw(spark, cfg))


@query
def quarantine_zone_roundtrip(spark, sf_dir):
    rejected = untraced(zones.read_quarantine(spark, full_lake(spark, sf_dir)))
    return comparable(rejected.dropDuplicates())


@query
def quarantine_missing_columns(spark, sf_dir):
    """Every month lacks its fares, so every month is rejected as a whole."""
    cfg = empty_lake(spark, "missing")
    land(trips(spark, sf_dir).drop("fare_amount"), cfg)
    months = storage.batch_months(spark, cfg, LANDING)
    raised: list[str] = []
    try:
        pipeline.landing_to_raw(spark, cfg, months, RUN_TS)
    except contract.SchemaContractError as error:
        raised = error.batches
    counts = rows_by(zones.read_quarantine(spark, cfg), "quarantine_reason", "batch_month")
    raw_rows = len(storage.batch_months(spark, cfg, RAW))
    return counts.withColumns(
        {"raw_rows": F.lit(raw_rows).cast("bigint"), "raised": F.col("batch_month").isin(raised)}
    )


@query
def structured_append(spark, sf_dir):
    cfg = empty_lake(spark, "append")
    for _ in range(2):
        sinks.write_structured(
            clean_by_day(spark, sf_dir).drop("batch_month"), cfg, mode="append", keys=("ds",), gather=False
        )
    return rows_by(zones.read_structured(spark, cfg), "ds", name="trip_count")


@query
def structured_replace(spark, sf_dir):
    cfg = empty_lake(spark, "replace")
    months = _months_of(spark, sf_dir)
    for _ in range(2):
        sinks.write_structured(clean_by_day(spark, sf_dir), cfg, months, gather=False)
    return rows_by(zones.read_structured(spark, cfg), "batch_month", "ds", name="trip_count")


@query
def sized_write(spark, sf_dir):
    """Raw zone written with a bound on the rows of a file."""
    cfg = replace(empty_lake(spark, "sized"), rows_per_file=ROWS_PER_FILE)
    months = _months_of(spark, sf_dir)
    valid = _with_path_columns(clean(spark, sf_dir))
    sinks.write_batches(valid, cfg, RAW, months, gather=True)
    written = zones.with_trace(zones.read_batches(spark, cfg, RAW), RUN_TS)
    written = written.withColumn("batch_month", zones.batch_month())
    return (
        rows_by(written, "batch_month", "source_file", name="file_rows")
        .groupBy("batch_month")
        .agg(
            F.sum("file_rows").alias("rows"),
            (F.max("file_rows") <= ROWS_PER_FILE).alias("within_size"),
            (F.count("file_rows") > 1).alias("was_split"),
        )
    )


@query
def catalog_repair(spark, sf_dir):
    """Partitions written after a table was registered show up once it is repaired."""
    cfg = empty_lake(spark, "catalog")
    table = f"{cfg.table}_{cfg.root[-12:]}"
    early = F.col("batch_month") < HALFWAY
    trips_now = clean(spark, sf_dir)
    sinks.write_structured(trips_now.filter(early), cfg, mode="append")
    sinks.register_zone(spark, table, cfg.zone_root(STRUCTURED))
    sinks.write_structured(trips_now.filter(~early), cfg, mode="append")
    count = F.count(F.lit(1)).alias("trips")
    unseen = spark.table(table).agg(count).first().trips
    sinks.repair_table(spark, table)
    after = spark.table(table).agg(F.lit("after").alias("moment"), count)
    return spark.createDataFrame([("before", unseen)], "moment string, trips bigint").union(after)


@query
def quarantine_table(spark, sf_dir):
    """The quarantine by reason, through the catalog."""
    cfg = full_lake(spark, sf_dir)
    table = f"quarantine_{cfg.table}_{cfg.root[-12:]}"
    sinks.register_zone(spark, table, cfg.zone_root(QUARANTINE), sinks.BATCH_KEYS)
    return spark.sql(f"SELECT quarantine_reason, count(*) AS count FROM `{table}` GROUP BY quarantine_reason")


@query
def structured_added_column(spark, sf_dir):
    """From one month on a source brings a new column; structured has it from then on."""
    cfg = empty_lake(spark, "added")
    all_trips = trips(spark, sf_dir)
    early = F.col("batch_month") < HALFWAY
    land(all_trips.filter(early), cfg)
    land(all_trips.filter(~early).withColumn("cbd_congestion_fee", F.lit(0.75)), cfg)
    months = storage.batch_months(spark, cfg, LANDING)
    for part in ([m for m in months if m < HALFWAY], [m for m in months if m >= HALFWAY]):
        pipeline.landing_to_raw(spark, cfg, part, RUN_TS)
        pipeline.raw_to_structured(spark, cfg, part)
    return zones.read_structured(spark, cfg).groupBy("batch_month").agg(
        F.count(F.lit(1)).alias("rows"), F.count("cbd_congestion_fee").alias("fees")
    )


@query
def structured_retyped_column(spark, sf_dir):
    """A column beyond the contract that is a number in early months and text later."""
    return zones.read_structured(spark, retyped_lake(spark, sf_dir)).groupBy("batch_month").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("zone_code").alias("codes"),
        F.min("zone_code").alias("first_code"),
        F.max("zone_code").alias("last_code"),
    )


@query
def structured_drift(spark, sf_dir):
    """What the zone's own record says of that column, with the types it was written in."""
    return zones.structured_drift(spark, retyped_lake(spark, sf_dir))


@query
def raw_retyped_column(spark, sf_dir):
    """The same column in raw, where both kinds of month are read together."""
    raw = zones.read_raw(spark, retyped_lake(spark, sf_dir))
    return rows_by(raw, F.length("zone_code").alias("digits"), name="rows")


@query
def structured_append_batches(spark, sf_dir):
    """Two appends in the layout the jobs write, by month and day."""
    cfg = empty_lake(spark, "append-batches")
    for _ in range(2):
        sinks.write_structured(clean_by_day(spark, sf_dir), cfg, mode="append", gather=False)
    return rows_by(zones.read_structured(spark, cfg), "batch_month", "ds", name="trip_count")


@query
def schema_drift(spark, sf_dir):
    """From one month on a source brings a new column; it never brought one of ours."""
    cfg = empty_lake(spark, "drift")
    all_trips = trips(spark, sf_dir).drop("airport_fee")
    early = F.col("batch_month") < HALFWAY
    land(all_trips.filter(early), cfg)
    land(all_trips.filter(~early).withColumn("cbd_congestion_fee", F.lit(0.75)), cfg)
    merged = zones.read_landing(spark, cfg).drop("batch_month")
    return contract.schema_drift(merged)


# --- projections ---------------------------------------------------------------------


@query
def typed_trips(spark, sf_dir):
    required = trips(spark, sf_dir).drop("congestion_surcharge", "airport_fee")
    return comparable(casts.cast_trips(required))


@query
def typed_trips_optional(spark, sf_dir):
    """One optional column in the publisher's other spelling, the other one absent."""
    other = trips(spark, sf_dir).drop("congestion_surcharge")
    other = other.withColumn("Airport_fee", F.col("airport_fee").cast("string"))
    typed = casts.cast_trips(contract.canonical_names(other))
    return comparable(typed.select("VendorID", PICKUP, "airport_fee", "batch_month"))


@query
def split_datetime(spark, sf_dir):
    parts = casts.split_datetimes(casts.cast_trips(trips(spark, sf_dir)))
    named = ("pickup_date", "pickup_time", "dropoff_date", "dropoff_time")
    return comparable(parts.select("VendorID", "payment_type", "fare_amount", *named))


# --- quality -------------------------------------------------------------------------


@query
def schema_check(spark, sf_dir):
    return contract.schema_check(trips(spark, sf_dir).drop("fare_amount"))


def _rule_group(group: str) -> Query:
    return lambda spark, sf_dir: quality.rule_results(trips(spark, sf_dir), group)


for _group in ("nulls", "non_negative", "temporal", "range", "location"):
    QUERIES[f"rule_{_group}"] = _rule_group(_group)


@query
def valid_trips(spark, sf_dir):
    return comparable(raw_trips(spark, sf_dir))


@query
def invalid_trips(spark, sf_dir):
    return comparable(quality.rejected_rows(trips(spark, sf_dir)))


@query
def invalid_trips_except(spark, sf_dir):
    return comparable(quality.rejected_by_set_operation(trips(spark, sf_dir)))


def _charged(df: DataFrame) -> DataFrame:
    """The trips with a map of maps, whose entries come in either order."""
    fare = [F.lit("fare"), F.create_map(F.lit("amount"), F.col("fare_amount"))]
    extra = [F.lit("extra"), F.create_map(F.lit("amount"), F.col("extra"))]
    turned = F.monotonically_increasing_id() % 2 == 0
    charges = F.when(turned, F.create_map(*fare, *extra)).otherwise(F.create_map(*extra, *fare))
    return df.withColumn("charges", charges)


@query
def invalid_trips_maps(spark, sf_dir):
    """Distinct rejected rows that hold a map; equal maps may list their entries otherwise."""
    rejected = quality.rejected_rows(_charged(trips(spark, sf_dir)))
    paid = {f"charged_{n}": F.col("charges")[n]["amount"] for n in ("fare", "extra")}
    return comparable(rejected.withColumns(paid).drop("charges"))


@query
def invalid_trips_maps_except(spark, sf_dir):
    """The same rows by the set operation."""
    rejected = quality.rejected_by_set_operation(_charged(trips(spark, sf_dir)))
    return rows_by(rejected, F.size("charges").alias("entries"))


@query
def quarantine_reason(spark, sf_dir):
    rejected = quality.rejected_rows(trips(spark, sf_dir), distinct=False)
    return comparable(quality.tag_quality(rejected).drop("failed_rules"))


@query
def failed_rules(spark, sf_dir):
    return quality.failed_rule_rows(trips(spark, sf_dir), "VendorID", "batch_month")


@query
def quality_metrics(spark, sf_dir):
    return quality.quality_metrics(trips(spark, sf_dir))


@query
def quarantine_by_reason(spark, sf_dir):
    return reports.quarantine_report("quarantine_by_reason", quarantine(spark, sf_dir))


@query
def quarantine_reason_share(spark, sf_dir):
    return quality.reason_share(quarantine(spark, sf_dir))


@query
def failures_by_rule(spark, sf_dir):
    return quality.failures_by_rule(trips(spark, sf_dir))


@query
def quarantine_by_ds(spark, sf_dir):
    rejected = zones.read_quarantine(spark, full_lake(spark, sf_dir))
    return reports.quarantine_report("quarantine_by_ds", rejected)


# --- features and outliers -----------------------------------------------------------


@query
def time_features(spark, sf_dir):
    typed = casts.cast_trips(raw_trips(spark, sf_dir)).select("VendorID", PICKUP)
    return comparable(enrich.add_time_features(typed))


@query
def trip_metrics(spark, sf_dir):
    measured = enrich.add_trip_metrics(casts.cast_trips(raw_trips(spark, sf_dir)))
    return measured.select(
        "VendorID",
        "fare_amount",
        "trip_distance",
        "trip_duration_minutes",
        "avg_speed_mph",
        "fare_per_mile",
        "tip_percentage",
        "cost_per_passenger",
    )


@query
def clean_trips(spark, sf_dir):
    return comparable(clean(spark, sf_dir))


@query
def outlier_breakdown(spark, sf_dir):
    return enrich.outlier_breakdown(enrich.enrich(raw_trips(spark, sf_dir)))


@query
def outlier_metrics(spark, sf_dir):
    return enrich.outlier_metrics(enrich.enrich(raw_trips(spark, sf_dir)))


@query
def batch_stats(spark, sf_dir):
    return rounded(enrich.batch_stats(clean(spark, sf_dir)))


# --- reports -------------------------------------------------------------------------


def _trip_report(name: str) -> Query:
    return lambda spark, sf_dir: rounded(reports.trip_report(name, clean(spark, sf_dir)))


for _name in reports.TRIP_REPORTS:
    QUERIES[_name] = _trip_report(_name)


@query
def null_audit(spark, sf_dir):
    named = clean(spark, sf_dir).select(
        *trips(spark, sf_dir).columns, "pickup_hour", "ds", "avg_speed_mph", "tip_percentage"
    )
    return reports.null_audit(named)


@query
def quality_over_time(spark, sf_dir):
    return monitoring.quality_over_time(spark, full_lake(spark, sf_dir))


@query
def quality_after_late_file(spark, sf_dir):
    """Figures of a run stay as they were when more files land after it."""
    cfg = empty_lake(spark, "late")
    land(trips(spark, sf_dir), cfg)
    months = storage.batch_months(spark, cfg, LANDING)
    report = pipeline.landing_to_raw(spark, cfg, months, RUN_TS)
    land(trips(spark, sf_dir), cfg)
    return report.quality()


@query
def quality_alerts(spark, sf_dir):
    return monitoring.quality_alerts(quality_over_time(spark, sf_dir))


@query
def quality_alerts_tight(spark, sf_dir):
    """The same with targets that many a month misses."""
    targets = QualityTargets(min_quality=98.0, max_quarantine=2.5)
    return monitoring.quality_alerts(quality_over_time(spark, sf_dir), targets)


# --- jobs ----------------------------------------------------------------------------


@query
def job_landing_to_raw(spark, sf_dir):
    cfg = fresh_lake(spark, sf_dir, "to-raw")
    months = storage.batch_months(spark, cfg, LANDING)
    return pipeline.landing_to_raw(spark, cfg, months, RUN_TS).quality()


@query
def job_raw_to_structured(spark, sf_dir):
    cfg = fresh_lake(spark, sf_dir, "to-structured")
    months = storage.batch_months(spark, cfg, LANDING)
    pipeline.landing_to_raw(spark, cfg, months, RUN_TS)
    return rounded(pipeline.raw_to_structured(spark, cfg, months).statistics())


@query
def run_month(spark, sf_dir):
    """All trips delivered as one big month."""
    cfg = empty_lake(spark, "month")
    land(trips(spark, sf_dir).withColumn("batch_month", F.lit("2001-12")), cfg)
    pipeline.run_month(spark, cfg, "2001-12", RUN_TS)
    return rows_by(zones.read_structured(spark, cfg), "batch_month", "ds", name="trip_count")


@query
def run_range(spark, sf_dir):
    """The backfill that also built the lake other queries read."""
    cfg = full_lake(spark, sf_dir)
    return pipeline.BatchReport(spark, cfg, tuple(span(spark, cfg))).outliers()


@query
def second_source(spark, sf_dir):
    """A source with other names for its times, and other letter case."""
    own_names = {"lpep_pickup_datetime": PICKUP, "lpep_dropoff_datetime": DROPOFF}
    cfg = empty_lake(spark, "second", columns=own_names)
    other = trips(spark, sf_dir).withColumnsRenamed(
        {**{new: old for old, new in own_names.items()}, "VendorID": "vendorid"}
    )
    land(other, cfg)
    months = span(spark, cfg)
    pipeline.run_range(spark, cfg, months[0], months[-1], RUN_TS)
    return comparable(untraced(zones.read_structured(spark, cfg)))


# --- remediation ---------------------------------------------------------------------


def _repairs_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("repairs", F.concat_ws(",", "remediation")).drop("remediation")


@query
def remediate_types(spark, sf_dir):
    required = trips(spark, sf_dir).select(*contract.REQUIRED_COLUMNS, "batch_month")
    return comparable(_repairs_as_text(remediation.repair_types(text_trips(required))))


@query
def remediate_values(spark, sf_dir):
    judged = remediation.remediate(quarantine(spark, sf_dir))
    return comparable(_repairs_as_text(judged.drop("quarantine_reason")))


@query
def remediate_promote(spark, sf_dir):
    cfg = fresh_lake(spark, sf_dir, "promote")
    months = storage.batch_months(spark, cfg, LANDING)
    pipeline.landing_to_raw(spark, cfg, months, RUN_TS)
    for _ in range(2):
        promote(spark, cfg, months)
    pipeline.run_range(spark, cfg, months[0], months[-1], RUN_TS)
    return monitoring.rows_by_zone(
        spark, cfg, months, promoted_rows=PROMOTED, remaining_rows=UNRESOLVED, clean_rows=STRUCTURED
    )


@query
def remediation_report(spark, sf_dir):
    return remediation.recovery_report(remediation.remediate(quarantine(spark, sf_dir)))
