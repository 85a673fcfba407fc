import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from zoneflow.config import OutlierLimits
from zoneflow.functions.numeric import exact_sums
from zoneflow.operators.casts import cast_trips, split_datetimes
from zoneflow.operators.contract import canonical_names
from zoneflow.operators.enrich import (
    batch_stats,
    enrich,
    outlier_breakdown,
    outlier_metrics,
    remove_outliers,
    structure,
)
from zoneflow.plans.reports import TRIP_REPORTS, null_audit, trip_report

DROPOFF = "tpep_dropoff_datetime"


def test_features_of_one_trip(make):
    row = enrich(make({})).first()
    assert row.pickup_date == date(2024, 1, 6) and row.ds == "2024-01-06"
    assert (row.pickup_year, row.pickup_month, row.pickup_day, row.pickup_hour) == (2024, 1, 6, 10)
    assert (row.pickup_dayofweek, row.pickup_week, row.is_weekend) == (7, 1, 1)
    assert row.trip_duration_minutes == 20.0
    assert row.avg_speed_mph == 15.0 and row.fare_per_mile == 4.0
    assert row.tip_percentage == 20.0 and row.cost_per_passenger == 13.0


def test_week_days(make):
    days = [{"tpep_pickup_datetime": datetime(2024, 1, day)} for day in range(7, 14)]
    rows = enrich(make(*days)).collect()
    assert [(r.pickup_dayofweek, r.is_weekend) for r in rows] == [
        (1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 1),
    ]
    assert [r.pickup_week for r in rows] == [1, 2, 2, 2, 2, 2, 2]


def test_guarded_divisions(make):
    rows = enrich(
        make(
            {"trip_distance": 0.0},
            {"passenger_count": 0.0},
            {"payment_type": 2},
            {"fare_amount": 0.0},
            {DROPOFF: datetime(2024, 1, 6, 10, 30)},
        )
    ).collect()
    assert rows[0].avg_speed_mph is None and rows[0].fare_per_mile is None
    assert rows[1].cost_per_passenger is None
    assert rows[2].tip_percentage is None and rows[3].tip_percentage is None
    assert rows[4].avg_speed_mph is None


def test_casts(make):
    typed = cast_trips(make({"passenger_count": 1.9, "PULocationID": 2**40}))
    row = typed.first()
    assert row.passenger_count == 1 and row.PULocationID is None
    assert dict(typed.dtypes)["tpep_pickup_datetime"] == "timestamp"
    text = make({}).select(*(F.col(c).cast("string") for c in make({}).columns))
    text = text.withColumns({"passenger_count": F.lit(" 3.0 "), "fare_amount": F.lit("x"), "extra": F.lit("")})
    row = cast_trips(text).first()
    assert (row.passenger_count, row.fare_amount, row.extra, row.VendorID) == (3, None, None, 1)


def test_optional_columns_and_spelling(make):
    df = make({}).drop("congestion_surcharge").withColumn("note", F.lit("kept"))
    other = df.withColumnsRenamed({"airport_fee": "Airport_fee", "VendorID": "vendorid"})
    typed = cast_trips(canonical_names(other))
    assert set(typed.columns) == set(df.columns)
    assert structure(canonical_names(other)).first().note == "kept"


def test_split_datetimes(make):
    row = split_datetimes(cast_trips(make({}))).first()
    assert (row.pickup_date, row.pickup_time) == (date(2024, 1, 6), "10:30:00")
    assert (row.dropoff_date, row.dropoff_time) == (date(2024, 1, 6), "10:50:00")


OUTLIERS = [
    ({"trip_distance": 0.0}, "distance_too_low"),
    ({"trip_distance": 100.0}, "distance_too_high"),
    ({"fare_amount": 0.0}, "fare_too_low"),
    ({"fare_amount": 500.0}, "fare_too_high"),
    ({DROPOFF: datetime(2024, 1, 7, 10, 30)}, "duration_too_high"),
    ({DROPOFF: datetime(2024, 1, 6, 10, 33)}, "speed_too_high"),
    ({"trip_distance": math.nan}, "distance_too_high"),
]


@pytest.mark.parametrize(("change", "limit"), OUTLIERS)
def test_outliers(make, change, limit):
    df = enrich(make(change, {}))
    assert remove_outliers(df).count() == 1
    assert [tuple(r) for r in outlier_breakdown(df).collect()] == [(limit, 1)]


def test_limits_are_parameters(make):
    df = enrich(make({"trip_distance": 0.0}, {"fare_amount": 600.0}, {}))
    wide = OutlierLimits(min_distance=-1, max_fare=1000)
    assert remove_outliers(df, wide).count() == 3
    row = outlier_metrics(df).first()
    assert (row.input_rows, row.clean_rows, row.outliers_removed) == (3, 1, 2)
    assert row.outlier_pct == pytest.approx(200 / 3)
    assert outlier_metrics(df.limit(0)).first().outlier_pct == 0.0


def test_statistics(make):
    row = batch_stats(structure(make({}, {"fare_amount": 30.0, "trip_distance": 10.0}))).first()
    assert (row.total_trips, row.total_fare, row.avg_distance) == (2, 50.0, 7.5)
    assert (row.avg_duration, row.avg_speed, row.avg_fare_per_mile) == (20.0, 22.5, 3.5)
    none = batch_stats(structure(make({})).limit(0)).first()
    assert none.total_trips == 0 and none.avg_speed is None and none.total_fare is None


def test_sums_do_not_depend_on_order(spark):
    df = spark.range(20_000).select((F.col("id") % 977 / 100).alias("x"))
    sums = {exact_sums(df.repartition(n), (), ("x",)).first() for n in (1, 3, 7)}
    assert len(sums) == 1
    total = sum(i % 977 for i in range(20_000))
    assert sums.pop()["sum_x"] == total / 100


def test_sums_of_any_size(spark):
    """Against the exactly rounded sum, whatever the exponents."""
    rng = random.Random(7)
    groups = {
        "tiny": [1e-18, 1e-16, 3e-17],
        "huge": [1.7e308, -1.6e308, 1e300, 5.0],
        "mixed": [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-30, 30) for _ in range(500)],
        "close": [rng.random() * 2.0 ** rng.randint(-3, 34) for _ in range(500)] + [2.0**32, 2.0**32 - 2**-21],
        "cancel": [1e16, 1.0, -1e16],
        "zero": [0.0, -0.0],
    }
    rows = [(k, x) for k, values in groups.items() for x in [*values, None]]
    rows += [("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("inf", 2.0), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r for r in exact_sums(df, ("k",), ("x",)).collect()}
    for k, values in groups.items():
        assert got[k].sum_x == pytest.approx(math.fsum(values), rel=1e-15, abs=0)
        assert (got[k].count_x, got[k].rows) == (len(values), len(values) + 1)
        assert got[k].avg_x == got[k].sum_x / len(values)
    assert math.isnan(got["nan"].sum_x) and got["inf"].sum_x == float("inf")
    assert (got["none"].sum_x, got["none"].avg_x, got["none"].count_x) == (None, None, 0)
    empty = exact_sums(df.limit(0), (), ("x",)).first()
    assert (empty.rows, empty.sum_x) == (0, None)


def test_statistics_of_tiny_distances(make):
    tiny = [make({"trip_distance": d}) for d in (1e-18, 1e-16)]
    for frame, distance in zip(tiny, (1e-18, 1e-16), strict=True):
        row = batch_stats(structure(frame)).first()
        assert row.avg_distance == distance and row.avg_fare_per_mile == 20.0 / distance


def test_reports_run_on_any_trips(make):
    trips = structure(make({}, {"payment_type": 2})).withColumn("batch_month", F.lit("2023-12"))
    found = {name: trip_report(name, trips).collect() for name in TRIP_REPORTS}
    assert found["total_trips"][0].total_trips == 2
    assert tuple(found["trips_by_month"][0]) == (2024, 1, 2, 40.0, 5.0)
    assert tuple(found["trips_by_hour"][0]) == (10, 2, 20.0)
    assert tuple(found["out_of_batch_rows"][0]) == ("2023-12", "2024-01", 2)
    audit = {row.column_name: row.nulls for row in null_audit(trips).collect()}
    assert audit["fare_amount"] == 0 and audit["tip_percentage"] == 1
