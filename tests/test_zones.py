import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import GOOD_TRIP
from zoneflow import paths, storage, versions
from zoneflow.config import (
    LANDING,
    MALFORMED,
    PROMOTED,
    QUARANTINE,
    RAW,
    REQUIRED_COLUMNS,
    STRUCTURED,
    UNRESOLVED,
    SourceConfig,
)
from zoneflow.operators.contract import SchemaContractError, schema_check, schema_drift
from zoneflow.plans import monitoring, pipeline
from zoneflow.plans.remediation import promote
from zoneflow.plans.reports import quarantine_report, trip_report
from zoneflow.sources import manifest, sinks, survey, zones
from zoneflow.sources.manifest import batch_status
from zoneflow.streaming.arrivals import ingest_stream, unseen_files

PICKUP, DROPOFF = "tpep_pickup_datetime", "tpep_dropoff_datetime"
BAD = {"fare_amount": -1.0}
RUN_TS = datetime(2024, 2, 1, 12)
FEBRUARY = {PICKUP: datetime(2024, 2, 3, 8), DROPOFF: datetime(2024, 2, 3, 8, 20)}


def counts(spark, cfg, month):
    """Rows of a month in raw, quarantine and structured."""
    structured = zones.read_structured(spark, cfg).filter(F.col("batch_month") == month)
    return (
        zones.read_batches(spark, cfg, RAW, [month]).count(),
        zones.read_quarantine(spark, cfg, [month]).count(),
        structured.count(),
    )


def test_one_month_end_to_end(spark, cfg, make, deliver):
    deliver(make({}, {}, {"trip_distance": 0.0}, BAD, BAD), "2024-01")
    report = pipeline.run_month(spark, cfg, "2024-01", RUN_TS)
    assert (report.months, report.skipped, report.failed) == (("2024-01",), (), ())
    # The two bad rows lie in different files or in one; equal rows of one file collapse.
    raw, rejected, structured = counts(spark, cfg, "2024-01")
    assert raw == 3 and structured == 2 and rejected in (1, 2)
    row = report.quality().first()
    assert (row.input_rows, row.valid_rows, row.rejected_rows) == (5, 3, 2)
    assert (row.quality_rate, row.quarantine_rate, row.status) == (60.0, 40.0, "WARNING")
    outliers = report.outliers().first()
    assert (outliers.input_rows, outliers.clean_rows, outliers.outliers_removed) == (3, 2, 1)
    assert report.statistics().first().total_fare == 40.0
    traced = zones.read_raw(spark, cfg, ["2024-01"]).first()
    assert traced.ingestion_timestamp == RUN_TS
    assert "/year=2024/month=01/" in traced.source_file


def test_copies_in_one_file_are_rejected_once(spark, cfg, make, deliver):
    deliver(make(BAD, BAD, {}, {}).coalesce(1), "2024-01")
    pipeline.landing_to_raw(spark, cfg, ["2024-01"], RUN_TS)
    assert zones.read_quarantine(spark, cfg).count() == 1
    assert zones.read_raw(spark, cfg).count() == 2
    deliver(make(BAD), "2024-01")
    pipeline.landing_to_raw(spark, cfg, ["2024-01"], RUN_TS)
    assert zones.read_quarantine(spark, cfg).count() == 2
    pipeline.landing_to_raw(spark, cfg, ["2024-01"], RUN_TS, dedup=True)
    assert zones.read_raw(spark, cfg).count() == 1


def test_reruns_change_nothing(spark, cfg, make, deliver):
    deliver(make({}, {}, BAD), "2024-01")
    deliver(make(FEBRUARY, {**FEBRUARY, "passenger_count": 0.0}), "2024-02")
    for _ in range(2):
        pipeline.run_range(spark, cfg, "2024-01", "2024-02")
        assert counts(spark, cfg, "2024-01") == (2, 1, 2)
        assert counts(spark, cfg, "2024-02") == (1, 1, 1)
    # One month alone leaves the other as it is.
    pipeline.run_month(spark, cfg, "2024-02")
    assert counts(spark, cfg, "2024-01") == (2, 1, 2)
    pipeline.raw_to_structured(spark, cfg, ["2024-02"], mode="append")
    assert counts(spark, cfg, "2024-02") == (1, 1, 2)


def test_a_day_shared_by_two_batches(spark, cfg, make, deliver):
    """A late row of another month does not push out that month's own rows."""
    deliver(make({}), "2024-01")
    deliver(make(FEBRUARY, {}), "2024-02")
    pipeline.run_range(spark, cfg, "2024-01", "2024-02")
    pipeline.run_month(spark, cfg, "2024-01")
    days = trip_report("partition_row_counts", zones.read_structured(spark, cfg)).collect()
    assert sorted(tuple(day) for day in days) == [
        ("2024-01", "2024-01-06", 1),
        ("2024-02", "2024-01-06", 1),
        ("2024-02", "2024-02-03", 1),
    ]
    late = trip_report("out_of_batch_rows", zones.read_structured(spark, cfg)).collect()
    assert [tuple(row) for row in late] == [("2024-02", "2024-01", 1)]
    assert zones.trips_between(spark, cfg, "2024-02-01", "2024-02-29").count() == 1


def test_nothing_stale_survives(spark, cfg, make, deliver):
    for month in ("2024-01", "2024-02"):
        deliver(make({}, BAD), month)
    pipeline.run_range(spark, cfg, "2024-01", "2024-02")
    storage.delete(spark, [cfg.batch_path(LANDING, "2024-01"), cfg.batch_path(LANDING, "2024-02")])
    deliver(make({}, {}), "2024-01")  # no row is rejected any more
    deliver(make(BAD), "2024-02")  # every row is
    report = pipeline.run_range(spark, cfg, "2024-01", "2024-02")
    assert counts(spark, cfg, "2024-01") == (2, 0, 2)
    assert counts(spark, cfg, "2024-02") == (0, 1, 0)
    stats = {row.batch_month: row.total_trips for row in report.statistics().collect()}
    assert stats == {"2024-01": 2}


def test_empty_and_all_rejected_batches(spark, cfg, make, deliver):
    deliver(make({}).limit(0).coalesce(1), "2024-01")
    report = pipeline.landing_to_raw(spark, cfg, ["2024-01"])
    pipeline.raw_to_structured(spark, cfg, ["2024-01"])
    assert counts(spark, cfg, "2024-01") == (0, 0, 0)
    assert [r.input_rows for r in report.quality().collect()] == [0]
    deliver(make(BAD), "2024-02")
    assert pipeline.run_month(spark, cfg, "2024-02").outliers().collect() == []
    assert counts(spark, cfg, "2024-02") == (0, 1, 0)
    assert quarantine_report("quarantine_by_reason", zones.read_quarantine(spark, cfg)).count() == 1


def test_missing_columns(spark, cfg, make, deliver):
    deliver(make({}, BAD).drop("fare_amount", "VendorID"), "2024-01")
    deliver(make({}, BAD), "2024-02")
    with pytest.raises(SchemaContractError, match="2024-01: VendorID, fare_amount"):
        pipeline.landing_to_raw(spark, cfg, ["2024-01", "2024-02"])
    rejected = zones.read_quarantine(spark, cfg)
    reasons = rejected.groupBy("batch_month", "quarantine_reason").count().collect()
    assert sorted(tuple(r) for r in reasons) == [
        ("2024-01", "missing_columns", 2),
        ("2024-02", "negative_fare", 1),
    ]
    assert storage.batch_months(spark, cfg, RAW) == ["2024-02"]
    report = pipeline.run_range(spark, cfg, "2023-12", "2024-02")
    assert (report.months, report.skipped, report.failed) == (
        ("2024-02",),
        ("2023-12",),
        ("2024-01",),
    )


def test_structured_needs_its_columns(spark, cfg, make, deliver):
    deliver(make({}).drop("tip_amount"), "2024-01")
    pipeline.landing_to_raw(spark, cfg, ["2024-01"])
    with pytest.raises(SchemaContractError, match="tip_amount"):
        pipeline.raw_to_structured(spark, cfg, ["2024-01"])


def test_months_with_different_schemas(spark, cfg, make, deliver):
    deliver(make({}, BAD), "2024-01")
    whole = make({}, {}, BAD).withColumns(
        {"passenger_count": F.col("passenger_count").cast("bigint"), "VendorID": F.col("VendorID").cast("bigint")}
    )
    deliver(whole.withColumnRenamed("airport_fee", "Airport_fee"), "2024-02")
    deliver(make({}).drop("airport_fee").withColumn("note", F.lit("new")), "2024-03")
    groups = zones.batches_by_schema(spark, cfg, LANDING, ["2024-01", "2024-02", "2024-03"])
    assert groups == [["2024-01"], ["2024-02"], ["2024-03"]]
    pipeline.run_range(spark, cfg, "2024-01", "2024-03")
    assert [counts(spark, cfg, m) for m in ("2024-01", "2024-02", "2024-03")] == [
        (1, 1, 1),
        (2, 1, 2),
        (1, 0, 1),
    ]
    fees = zones.read_structured(spark, cfg)
    assert fees.filter("airport_fee IS NOT NULL").count() == 3
    assert fees.filter("note = 'new'").count() == 1


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_text_landing(spark, cfg, make, deliver, fmt):
    source = replace(cfg, fmt=fmt)
    deliver(make({}, {"passenger_count": 0.0}, {"PULocationID": None}), "2024-01", source)
    broken = make({}).withColumn("fare_amount", F.lit("much"))
    deliver(broken, "2024-01", source)
    report = pipeline.run_month(spark, source, "2024-01")
    assert counts(spark, source, "2024-01") == (1, 3, 1)
    row = zones.read_structured(spark, source).first()
    assert (row.passenger_count, row.fare_amount, row.pickup_hour) == (2, 20.0, 10)
    reasons = {r.quarantine_reason for r in zones.read_quarantine(spark, source).collect()}
    assert reasons == {"invalid_passenger_count", "multiple_issues", "null_fare"}
    assert report.quality().first().input_rows == 4


def test_second_source(spark, tmp_path, make, deliver):
    source = SourceConfig(
        root=str(tmp_path),
        source="green-trips",
        columns={"lpep_pickup_datetime": PICKUP, "lpep_dropoff_datetime": DROPOFF},
    )
    own = make({}, BAD).withColumnsRenamed(
        {PICKUP: "lpep_pickup_datetime", DROPOFF: "Lpep_dropoff_datetime"}
    )
    deliver(own, "2024-01", source)
    pipeline.run_month(spark, source, "2024-01")
    assert counts(spark, source, "2024-01") == (1, 1, 1)


def test_batch_status(spark, cfg, make, deliver, tmp_path):
    deliver(make({}), "2024-01")
    deliver(make({}), "2024-03")
    broken = tmp_path / "landing/yellow-trips/year=2024/month=03/broken.parquet"
    broken.write_bytes(b"not parquet")
    status = manifest.batch_status(spark, cfg, ["2024-01", "2024-02", "2024-03"])
    assert {r.batch_month: r.status for r in status.collect()} == {
        "2024-01": "ready",
        "2024-02": "skip",
        "2024-03": "failed",
    }
    report = pipeline.run_range(spark, cfg, "2024-01", "2024-03")
    assert (report.months, report.skipped, report.failed) == (
        ("2024-01",),
        ("2024-02",),
        ("2024-03",),
    )
    files = manifest.landing_manifest(spark, cfg).filter("date_param = '2024-03'").collect()
    assert {row.file_size_bytes for row in files} >= {len(b"not parquet")}
    nothing = SourceConfig(root=cfg.root, source="none")
    assert manifest.batch_status(spark, nothing, ["2024-01"]).first().status == "skip"


def test_schema_check_and_drift(spark, make):
    check = {r.column_name: r for r in schema_check(make({}, {"fare_amount": None}).drop("VendorID")).collect()}
    assert not check["VendorID"].present and check["VendorID"].filled_rows == 0
    assert (check["fare_amount"].present, check["fare_amount"].filled_rows) == (True, 1)
    typed = make({}).select("VendorID").withColumn("note", F.lit("x"))
    drift = schema_drift(typed, {"VendorID": "bigint", "fare_amount": "double"}).collect()
    assert sorted(tuple(r) for r in drift) == [
        ("VendorID", "retyped", 1),
        ("fare_amount", "missing", 0),
        ("note", "added", 1),
    ]
    assert schema_drift(make({}).select("VendorID"), {"VendorID": "int"}).count() == 0


def test_catalog(spark, cfg, make, deliver):
    deliver(make({}), "2024-01")
    deliver(make(FEBRUARY), "2024-02")
    pipeline.run_month(spark, cfg, "2024-01")
    sinks.register_zone(spark, cfg.table, cfg.zone_root(STRUCTURED))
    count = "SELECT count(*) AS n FROM yellow_trips"
    assert spark.sql(count).first().n == 1
    pipeline.run_month(spark, cfg, "2024-02")
    assert spark.sql(count).first().n == 1
    sinks.repair_table(spark, cfg.table)
    assert spark.sql(count).first().n == 2
    assert dict(spark.table("yellow_trips").dtypes)["ds"] == "string"
    assert spark.sql(f"{count} WHERE ds = '2024-02-03'").first().n == 1
    spark.sql("DROP TABLE yellow_trips")
    assert zones.read_structured(spark, cfg).count() == 2


def test_file_size_bound(spark, cfg, make, deliver):
    deliver(make(*[{}] * 25).coalesce(1), "2024-01")
    pipeline.run_month(spark, replace(cfg, rows_per_file=10), "2024-01")
    sizes = (
        zones.with_trace(zones.read_batches(spark, cfg, RAW), RUN_TS)
        .groupBy("source_file")
        .count()
        .collect()
    )
    assert sorted(row["count"] for row in sizes) == [5, 10, 10]


def test_writing_refuses_what_it_cannot_do(cfg, make):
    with pytest.raises(ValueError, match="overwrite"):
        sinks.write_structured(make({}), cfg, mode="overwrite")
    with pytest.raises(ValueError, match="batch_month"):
        sinks.write_structured(make({}), cfg, keys=("ds",))


def test_alerts(spark, cfg, make, deliver):
    deliver(make({}, BAD), "2024-01")
    deliver(make(*[FEBRUARY] * 30), "2024-02")
    pipeline.run_range(spark, cfg, "2024-01", "2024-02")
    alerts = monitoring.quality_alerts(monitoring.quality_over_time(spark, cfg)).collect()
    assert sorted((r.batch_month, r.alert) for r in alerts) == [
        ("2024-01", "quality_rate"),
        ("2024-01", "quarantine_rate"),
    ]


def test_promotion(spark, cfg, make, deliver):
    fixable = {"passenger_count": 0.0}
    swapped = {DROPOFF: datetime(2024, 1, 6, 10)}
    deliver(make({}, fixable, swapped, BAD).coalesce(1), "2024-01")
    pipeline.run_month(spark, cfg, "2024-01")
    assert counts(spark, cfg, "2024-01") == (1, 3, 1)
    for _ in range(2):
        assert promote(spark, cfg, ["2024-01", "2023-05"]) == ["2024-01"]
        rows = {z: zones.read_batches(spark, cfg, z).count() for z in (PROMOTED, UNRESOLVED)}
        assert rows == {PROMOTED: 2, UNRESOLVED: 1}
        pipeline.raw_to_structured(spark, cfg, ["2024-01"])
        assert counts(spark, cfg, "2024-01") == (1, 3, 3)
    kept = zones.read_structured(spark, cfg)
    assert kept.filter("origin = 'remediated'").count() == 2
    assert zones.read_raw(spark, cfg).filter("origin = 'remediated'").count() == 2
    # Running the month again judges what was promoted anew and keeps it.
    pipeline.run_month(spark, cfg, "2024-01")
    assert counts(spark, cfg, "2024-01") == (1, 3, 3)


def test_promotion_leaves_whole_batches_alone(spark, cfg, make, deliver):
    deliver(make({}).drop("fare_amount"), "2024-01")
    with pytest.raises(SchemaContractError):
        pipeline.landing_to_raw(spark, cfg, ["2024-01"])
    assert promote(spark, cfg, ["2024-01"]) == []
    assert storage.batch_months(spark, cfg, QUARANTINE) == ["2024-01"]


def test_arrivals(spark, cfg, make, deliver, tmp_path):
    checkpoint = str(tmp_path / "checkpoint")

    def watch():
        query = ingest_stream(spark, cfg, checkpoint, RUN_TS)
        query.awaitTermination()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    deliver(make({}, BAD).coalesce(1), "2024-01")
    assert watch() == [1]
    assert counts(spark, cfg, "2024-01") == (1, 1, 1)
    assert watch() == []
    deliver(make({}).coalesce(1), "2024-01")
    deliver(make(FEBRUARY).coalesce(1), "2024-02")
    assert watch() == [2]
    assert counts(spark, cfg, "2024-01") == (2, 1, 2)
    assert counts(spark, cfg, "2024-02") == (1, 0, 1)


def test_arrival_without_rows_and_under_an_old_name(spark, cfg, make, deliver, tmp_path):
    checkpoint = str(tmp_path / "checkpoint")

    def watch():
        ingest_stream(spark, cfg, checkpoint, RUN_TS).awaitTermination()
        quality = monitoring.quality_over_time(spark, cfg)
        return {r.batch_month: r.input_rows for r in quality.collect()}

    def file_of(month):
        (found,) = storage.files(spark, cfg.batch_path(LANDING, month))
        return found.removeprefix("file:")

    deliver(make({}, {}).coalesce(1), "2024-01")
    deliver(make({}).limit(0).coalesce(1), "2024-02")
    assert watch() == {"2024-01": 2, "2024-02": 0}
    first = file_of("2024-01")
    old, times = open(first, "rb").read(), os.stat(first)
    make(*[{}] * 5).coalesce(1).write.parquet(str(tmp_path / "more"))
    (more,) = storage.files(spark, str(tmp_path / "more"))
    with open(first, "wb") as target:
        target.write(open(more.removeprefix("file:"), "rb").read())
    os.remove(first.replace("/part-", "/.part-") + ".crc")
    assert watch() == {"2024-01": 5, "2024-02": 0}
    # As it was at first, time of the file included: a change all the same.
    with open(first, "wb") as target:
        target.write(old)
    os.utime(first, ns=(times.st_atime_ns, times.st_mtime_ns))
    assert watch() == {"2024-01": 2, "2024-02": 0}
    # A file that is taken away brings nothing to process.
    os.remove(file_of("2024-02"))
    assert watch() == {"2024-01": 2, "2024-02": 0}
    assert not unseen_files(spark, cfg, checkpoint).count()


def jobs_of(spark, run):
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.nextJobId()
    run()
    return scheduler.nextJobId() - before


def test_many_csv_files_take_few_jobs(spark, cfg):
    source = replace(cfg, fmt="csv")
    names = list(GOOD_TRIP)
    line = ",".join("" if v is None else str(v) for v in GOOD_TRIP.values())
    turned = ",".join(str(v) for v in reversed(GOOD_TRIP.values()))

    def land(month, count):
        for n in range(count):
            header, row = (names, line) if n % 2 else (names[::-1], turned)
            text = f"\n{','.join(header)}\r\n{row}\r\n".encode()
            put(source.batch_path(LANDING, month), f"{n}.csv", text)

    land("2024-01", 2)
    few = jobs_of(spark, lambda: zones.read_landing(spark, source))
    for month in ("2024-02", "2024-03", "2024-04"):
        land(month, 20)
    assert jobs_of(spark, lambda: zones.read_landing(spark, source)) == few <= 6
    landed = zones.read_landing(spark, source)
    assert landed.count() == 62
    assert landed.select(*names).distinct().count() == 1
    assert landed.first().trip_distance == "5.0"


def test_csv_files_the_workers_cannot_tell_apart(spark, cfg):
    source = replace(cfg, fmt="csv")
    long = "x" * (1 << 20)
    where = source.batch_path(LANDING, "2024-01")
    put(where, "a.csv", b"a,b\n1,2\n")
    put(where, "b.csv", b"")
    put(where, "c.csv", b"\n  \nb,a\n2,1")
    found = survey.first_lines(spark, list(storage.files(spark, where)))
    assert len(found) == 3 and len(set(found.values())) == 3
    rows = zones.read_batches(spark, source, LANDING, ["2024-01"]).select("a", "b").collect()
    assert [tuple(r) for r in rows] == [("1", "2")] * 2
    put(where, "d.csv", f"{long}\n1\n".encode())
    put(where, "e.csv.gz", b"this is no gzip")
    listed = list(storage.files(spark, where))
    assert set(survey.first_lines(spark, listed)) == {f for f in listed if f[-5] in "abc"}
    broken = {}
    assert zones.batches_by_schema(spark, source, LANDING, ["2024-01"], broken) == []
    assert "cannot be read together" in broken["2024-01"]


def test_scratch_lies_in_a_folder_the_session_names(spark):
    path = storage.scratch_dir(spark, "label")
    assert storage.exists(spark, path)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert path.startswith(shared)


def put(path, name, content):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "wb") as file:
        file.write(content)


def test_status_opens_every_file(spark, cfg, make, deliver):
    """Size and name say nothing: rubbish fails, an empty file of any size is sound."""
    deliver(make({}), "2024-01")
    put(cfg.batch_path(LANDING, "2024-02"), "a.parquet", b"rubbish rubbish PAR1")
    deliver(make({}).limit(0).withColumns({f"c{i}": F.lit(i) for i in range(900)}).coalesce(1), "2024-03")
    status = batch_status(spark, cfg, ["2024-01", "2024-02", "2024-03", "2024-04"]).collect()
    assert [(r.status, r.rows) for r in sorted(status)] == [
        ("ready", 1), ("failed", 0), ("ready", 0), ("skip", 0)
    ]
    report = pipeline.run_range(spark, cfg, "2024-01", "2024-04")
    assert report.months == ("2024-01", "2024-03") and report.failed == ("2024-02",)
    assert counts(spark, cfg, "2024-01") == (1, 0, 1)
    csv = replace(cfg, fmt="csv", source="text")
    put(csv.batch_path(LANDING, "2024-01"), "a.csv.gz", b"this is no gzip")
    assert batch_status(spark, csv, ["2024-01"]).first().status == "failed"


def test_unpadded_months_are_refused(spark, cfg, make, deliver):
    deliver(make({}), "2024-01")
    make({}).write.parquet(f"{cfg.zone_root(LANDING)}/year=2024/month=2")
    with pytest.raises(ValueError, match="month=MM"):
        pipeline.run_month(spark, cfg, "2024-01")


def test_three_months_at_once(spark, cfg, make, deliver):
    months = ["2024-01", "2024-02", "2024-03"]
    for month in months:
        deliver(make({}, BAD), month)
    with ThreadPoolExecutor(3) as pool:
        reports = list(pool.map(lambda m: pipeline.run_month(spark, cfg, m), months))
    assert [r.months for r in reports] == [(m,) for m in months]
    assert [counts(spark, cfg, m) for m in months] == [(1, 1, 1)] * 3


def test_a_write_that_fails_leaves_the_old_batch(spark, cfg, make, deliver):
    deliver(make({}, {}), "2024-01")
    pipeline.run_month(spark, cfg, "2024-01")
    bad = zones.read_batches(spark, cfg, RAW).withColumn("VendorID", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        sinks.write_batches(bad, cfg, RAW, ["2024-01"], gather=False)
    structured = zones.read_structured(spark, cfg)
    worse = structured.withColumn("fare_amount", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        sinks.write_structured(worse, cfg, ["2024-01"])
    assert counts(spark, cfg, "2024-01") == (2, 0, 2)


def test_figures_are_those_of_the_run(spark, cfg, make, deliver):
    deliver(make({}, {}, {}, {}).coalesce(1), "2024-01")
    report = pipeline.landing_to_raw(spark, cfg, ["2024-01"], dedup=True)
    wanted = [(4, 1, 0, 100.0, "SUCCESS")]

    def figures():
        names = ("input_rows", "valid_rows", "rejected_rows", "quality_rate", "status")
        return [tuple(r) for r in report.quality().select(*names).collect()]

    assert figures() == wanted
    deliver(make(BAD, BAD), "2024-01")
    assert figures() == wanted
    storage.delete(spark, [cfg.batch_path(LANDING, "2024-01")])
    assert figures() == wanted


def test_stream_stops_at_a_failed_month_and_tries_again(spark, cfg, make, deliver, tmp_path):
    deliver(make({}).drop("fare_amount"), "2024-01")
    deliver(make(FEBRUARY), "2024-02")
    for _ in range(2):
        with pytest.raises(Exception, match="2024-01"):
            ingest_stream(spark, cfg, str(tmp_path / "c"), RUN_TS).awaitTermination()
    assert counts(spark, cfg, "2024-02") == (1, 0, 1)


def test_one_group_without_columns_stops_no_other(spark, cfg, make, deliver):
    deliver(make({}).drop("tip_amount"), "2024-01")
    deliver(make(FEBRUARY), "2024-02")
    report = pipeline.run_range(spark, cfg, "2024-01", "2024-02")
    assert report.months == ("2024-02",) and report.failed == ("2024-01",)
    assert zones.read_structured(spark, cfg).count() == 1


def test_a_csv_line_with_a_surplus_field_is_kept_as_text(spark, cfg):
    source = replace(cfg, fmt="csv")
    names = ",".join(REQUIRED_COLUMNS)
    good = "1,2024-01-06 10:30:00,2024-01-06 10:50:00,2,5.0,20.0,100,200"
    put(source.batch_path(LANDING, "2024-01"), "a.csv", f"{names}\n{good}\n{good},more\n".encode())
    pipeline.landing_to_raw(spark, source, ["2024-01"])
    assert MALFORMED not in zones.read_raw(spark, source).columns
    assert zones.read_raw(spark, source).count() == 1
    row = zones.read_quarantine(spark, source).first()
    assert (row[MALFORMED], row.quarantine_reason) == (f"{good},more", "multiple_issues")
    assert row.failed_rules == ["readable"]


def test_a_column_appended_to_a_batch_is_read(spark, cfg, make, deliver):
    """Whichever file of the batch comes first, the columns of the others are there."""
    deliver(make({}), "2024-01")
    pipeline.run_month(spark, cfg, "2024-01")
    structured = zones.read_structured(spark, cfg)
    later = structured.withColumn("ds", F.lit("2024-01-31")).withColumn("late_fee", F.lit(1.5))
    sinks.write_structured(later, cfg, mode="append")
    earlier = structured.withColumn("ds", F.lit("2024-01-01")).withColumn("early_fee", F.lit(2.5))
    sinks.write_structured(earlier, cfg, mode="append")
    rows = zones.read_structured(spark, cfg).orderBy("ds").collect()
    assert [(r.ds, r.batch_month) for r in rows] == [(f"2024-01-{d}", "2024-01") for d in ("01", "06", "31")]
    assert [(r.early_fee, r.late_fee) for r in rows] == [(2.5, None), (None, None), (None, 1.5)]


# -- batch versions


class Killed(BaseException):
    """Stands for a driver that is gone: nothing of ours handles it."""


def kill_at(monkeypatch, module, name, calls=1):
    """The process ends when ``name`` is called for the n-th time, before it does anything."""
    left = [calls]
    original = getattr(module, name)

    def call(*args, **kwargs):
        left[0] -= 1
        if not left[0]:
            raise Killed
        return original(*args, **kwargs)

    monkeypatch.setattr(module, name, call)


def half_written(spark, path, text):
    """A note whose writer was killed in the middle: its part file is there, its name is not."""
    fs, part = paths.open_path(spark, f"{path.rsplit('/', 1)[0]}/.killed")
    stream = fs.create(part, True)
    stream.write(bytearray(text[:20].encode()))
    stream.close()
    raise Killed


@pytest.mark.parametrize("step", ["before the note", "in the note"])
@pytest.mark.parametrize("mode", ["replace", "append"])
def test_a_writer_killed_at_any_step(spark, cfg, make, deliver, monkeypatch, mode, step):
    for month, row in (("2024-01", {}), ("2024-02", FEBRUARY)):
        deliver(make(row, row), month)
    pipeline.run_range(spark, cfg, "2024-01", "2024-02")
    trips = zones.read_structured(spark, cfg)
    with monkeypatch.context() as m:
        if step == "in the note":
            m.setattr(paths, "write_note", half_written)
        else:
            kill_at(m, versions, "commit")
        with pytest.raises(Killed):
            sinks.write_structured(trips.limit(1), cfg, ["2024-01", "2024-02"], mode)
        with pytest.raises(Killed):
            kill_at(m, versions, "commit")
            sinks.write_batches(zones.read_batches(spark, cfg, RAW).limit(0), cfg, RAW, ["2024-01"], True)
    assert [counts(spark, cfg, m) for m in ("2024-01", "2024-02")] == [(2, 0, 2)] * 2
    sinks.write_structured(trips, cfg, ["2024-01", "2024-02"], mode)
    whole = 2 if mode == "replace" else 4
    assert [counts(spark, cfg, m)[2] for m in ("2024-01", "2024-02")] == [whole] * 2


def test_notes_are_summed_up_and_versions_swept(spark, cfg, make, monkeypatch):
    monkeypatch.setattr(versions, "FOLD_AFTER", 3)
    root = cfg.zone_root(RAW)
    raw = make({}).withColumns({"year": F.lit("2024"), "month": F.lit("01")})
    for n in range(6):
        sinks.write_batches(raw.withColumn("n", F.lit(n)), cfg, RAW, [f"2024-0{n % 2 + 1}"], False)
    reader = zones.read_batches(spark, cfg, RAW)
    assert storage.batch_months(spark, cfg, RAW) == ["2024-01", "2024-02"]
    assert sorted(r.n for r in reader.collect()) == [4, 5]
    assert versions.sweep(spark, root) == []  # all are young: someone may still read them
    assert len(versions.sweep(spark, root, keep_hours=0)) == 4
    assert versions.sweep(spark, root, keep_hours=0) == []
    assert sorted(r.n for r in zones.read_batches(spark, cfg, RAW).collect()) == [4, 5]
    assert len(versions._note_names(spark, root)) <= 3
    versions.remove(spark, root, ["2024-01", "1999-01"])
    assert storage.batch_months(spark, cfg, RAW) == ["2024-02"]


def test_a_note_that_a_sum_missed_still_counts(spark, cfg, make):
    """A writer at the same time as a sweep: its note is older by name than the sum."""
    root = cfg.zone_root(RAW)
    part = versions.Part(None, "{}")
    versions.commit(spark, root, {"2024-01": [part]})
    names = versions._note_names(spark, root)
    versions.commit(spark, root, {"2024-02": [part]})
    late = versions._note_names(spark, root)[-1]
    versions._write(spark, root, [f"{9:012d}-x"], versions.SUM, versions._body({"2024-01": [part]}, mode="replace", seen=names))
    assert late not in names and list(versions.batches(spark, root)) == ["2024-01", "2024-02"]


def test_a_zone_of_other_make_is_not_hidden(spark, cfg, make):
    make({}).write.parquet(cfg.batch_path(RAW, "2024-01"))
    assert zones.read_batches(spark, cfg, RAW).count() == 1
    raw = make({}).withColumns({"year": F.lit("2024"), "month": F.lit("02")})
    with pytest.raises(ValueError, match="without versions"):
        sinks.write_batches(raw, cfg, RAW, ["2024-02"], False)


# -- columns that change


def test_a_column_that_changes_its_type(spark, cfg, make, deliver):
    """Number in March, text in April: raw, structured, reports and the backfill go on."""
    march, april = "2024-03", "2024-04"
    deliver(make({}, BAD).withColumn("zone_code", F.lit(7)), march)
    deliver(make({}, {}).withColumn("zone_code", F.lit("Z7")), april)
    report = pipeline.run_range(spark, cfg, march, april)
    assert report.months == (march, april) and report.failed == ()
    raw = zones.read_raw(spark, cfg)
    assert sorted(r.zone_code for r in raw.collect()) == ["7", "Z7", "Z7"]
    for month, codes in ((march, ["7"]), (april, ["Z7", "Z7"])):
        pipeline.run_month(spark, cfg, month)
        found = zones.read_structured(spark, cfg).filter(F.col("batch_month") == month).collect()
        assert [r.zone_code for r in found] == codes
    assert zones.trips_between(spark, cfg, "2024-01-06", "2024-01-06").count() == 3
    assert trip_report("total_trips", zones.read_structured(spark, cfg)).first().total_trips == 3
    drift = {r.column_name: r for r in zones.structured_drift(spark, cfg).collect()}
    assert (drift["zone_code"].kind, drift["zone_code"].types) == ("retyped", "int,string")


def test_no_footer_is_opened_to_plan_a_read(spark, cfg, make, deliver):
    deliver(make({}), "2024-01")
    deliver(make(FEBRUARY).withColumn("note", F.lit(1)), "2024-02")
    pipeline.run_range(spark, cfg, "2024-01", "2024-02")
    file = next(f for f in storage.files(spark, cfg.zone_root(STRUCTURED)) if "ds=2024-02" in f)
    with open(file.removeprefix("file:"), "wb") as broken:
        broken.write(b"rubbish")
    assert zones.trips_between(spark, cfg, "2024-01-01", "2024-01-31").count() == 1


def test_planning_takes_two_jobs_for_any_number_of_months(spark, cfg, make, deliver):
    for month in range(1, 10):
        deliver(make({}), f"2024-0{month}")
    assert jobs_of(spark, lambda: zones.read_landing(spark, cfg)) <= 2
    months = [f"2024-0{m}" for m in range(1, 10)]
    assert jobs_of(spark, lambda: batch_status(spark, cfg, months)) <= 1
    pipeline.run_range(spark, cfg, "2024-01", "2024-09")
    assert jobs_of(spark, lambda: zones.read_raw(spark, cfg)) == 0
    assert jobs_of(spark, lambda: zones.read_structured(spark, cfg)) == 0


def test_status_names_the_broken_file(spark, cfg, make, deliver):
    deliver(make({}), "2024-01")
    put(cfg.batch_path(LANDING, "2024-01"), "broken.parquet", b"rubbish rubbish PAR1")
    row = batch_status(spark, cfg, ["2024-01"]).first()
    assert row.status == "failed" and [p.rsplit("/", 1)[1] for p in row.broken] == ["broken.parquet"]


# -- promotion and the catalog over failures


def test_promoted_rows_come_back_after_a_failed_run(spark, cfg, make, deliver, monkeypatch):
    deliver(make({}, {"passenger_count": 0.0}), "2024-01")
    pipeline.run_month(spark, cfg, "2024-01")
    promote(spark, cfg, ["2024-01"])
    pipeline.raw_to_structured(spark, cfg, ["2024-01"])
    assert zones.read_structured(spark, cfg).count() == 2
    for broken in ("write_batches", "promote"):
        with monkeypatch.context() as m:
            m.setattr(pipeline, broken, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                pipeline.run_month(spark, cfg, "2024-01")
        pipeline.run_month(spark, cfg, "2024-01")
        assert zones.read_structured(spark, cfg).count() == 2


def test_the_table_grows_in_place(spark, cfg, make, deliver):
    name, root = "growing_trips", cfg.zone_root(STRUCTURED)
    deliver(make({}), "2024-01")
    pipeline.run_month(spark, cfg, "2024-01")
    sinks.register_zone(spark, name, root)
    deliver(make(FEBRUARY).withColumn("late_fee", F.lit(2.5)), "2024-02")
    pipeline.run_range(spark, cfg, "2024-01", "2024-02")
    spark.sql(f"SELECT count(*) FROM {name}").collect()
    sinks.repair_table(spark, name)
    rows = spark.sql(f"SELECT batch_month, late_fee FROM {name} ORDER BY 1").collect()
    assert [tuple(r) for r in rows] == [("2024-01", None), ("2024-02", 2.5)]
    pipeline.raw_to_structured(spark, cfg, ["2024-02"], mode="append")
    sinks.repair_table(spark, name)
    assert spark.table(name).count() == zones.read_structured(spark, cfg).count() == 3
    versions.remove(spark, root, ["2024-02"])
    sinks.repair_table(spark, name)
    assert spark.table(name).count() == 1 and "late_fee" in spark.table(name).columns
    spark.sql(f"DROP TABLE {name}")


def test_figures_with_copies_and_dedup(spark, cfg, make, deliver):
    deliver(make({}, {}, BAD, BAD, BAD).coalesce(1), "2024-01")
    for dedup, valid in ((False, 2), (True, 1)):
        report = pipeline.landing_to_raw(spark, cfg, ["2024-01"], dedup=dedup)
        row = report.quality().first()
        assert (row.input_rows, row.valid_rows, row.rejected_rows, row.invalid_rows) == (5, valid, 3, 1)
        assert row.quality_rate == 40.0
    assert "_copies" not in zones.read_quarantine(spark, cfg).columns


def test_rejected_rows_with_maps(spark, cfg, make, deliver):
    """Equal maps, nested and listed in another order, make equal rows; the maps come back."""
    one, two = ("map('a', map('x', 1, 'y', 2), 'b', NULL)", "map('b', NULL, 'a', map('y', 2, 'x', 1))")
    inside = "named_struct('m', map(2, array(map('k', 1)), 1, NULL), 'n', 5) AS inside"
    rows = [make(BAD).selectExpr("*", f"{m} AS charges", inside) for m in (one, two)]
    rows.append(make(BAD).selectExpr("*", "CAST(NULL AS map<string, map<string, int>>) AS charges", inside))
    deliver(rows[0].union(rows[1]).union(rows[2]).coalesce(1), "2024-01")
    report = pipeline.landing_to_raw(spark, cfg, ["2024-01"])
    kept = zones.read_quarantine(spark, cfg).collect()
    assert sorted(map(str, (r.charges for r in kept))) == sorted(map(str, (None, {"a": {"x": 1, "y": 2}, "b": None})))
    assert all(r.inside.m == {1: None, 2: [{"k": 1}]} and r.inside.n == 5 for r in kept)
    row = report.quality().first()
    assert (row.input_rows, row.rejected_rows, row.invalid_rows) == (3, 3, 2)
