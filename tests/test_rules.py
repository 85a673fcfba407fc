from datetime import datetime

import pytest
from pyspark.sql import functions as F

from zoneflow.functions.rules import trip_rules
from zoneflow.operators.quality import (
    failed_rule_rows,
    failures_by_rule,
    quality_metrics,
    reason_share,
    rejected_by_set_operation,
    rejected_rows,
    rule_results,
    split_quality,
    tag_quality,
    valid_rows,
)

PICKUP, DROPOFF = "tpep_pickup_datetime", "tpep_dropoff_datetime"
NAN = float("nan")
EARLY, LATE = datetime(2024, 1, 6, 9), datetime(2024, 1, 6, 23)

# (changes to a good trip, rules that fail, reason)
CASES = [
    ({}, [], None),
    ({PICKUP: None}, ["pickup_present", "time_order"], "null_pickup_datetime"),
    ({DROPOFF: None}, ["dropoff_present", "time_order"], "null_dropoff_datetime"),
    ({"fare_amount": None}, ["fare_present", "fare_sign", "fare_range"], "null_fare"),
    (
        {"trip_distance": None},
        ["distance_present", "distance_sign", "distance_range"],
        "null_distance",
    ),
    ({"fare_amount": -0.01}, ["fare_sign"], "negative_fare"),
    ({"fare_amount": 0.0}, [], None),
    ({"fare_amount": 999.99}, [], None),
    ({"fare_amount": 1000.0}, ["fare_range"], "excessive_fare"),
    ({"fare_amount": NAN}, ["fare_range"], "excessive_fare"),
    ({"trip_distance": -0.1}, ["distance_sign"], "negative_distance"),
    ({"trip_distance": 0.0}, [], None),
    ({"trip_distance": 499.99}, [], None),
    ({"trip_distance": 500.0}, ["distance_range"], "excessive_distance"),
    ({"trip_distance": NAN}, ["distance_range"], "excessive_distance"),
    ({"passenger_count": 0.0}, ["passengers_sign"], "invalid_passenger_count"),
    ({"passenger_count": 1.0}, [], None),
    ({"passenger_count": 8.0}, [], None),
    ({"passenger_count": 9.0}, ["passengers_range"], "multiple_issues"),
    ({"passenger_count": None}, ["passengers_sign", "passengers_range"], "multiple_issues"),
    ({"passenger_count": NAN}, ["passengers_range"], "multiple_issues"),
    ({DROPOFF: EARLY}, ["time_order"], "temporal_inconsistency"),
    ({PICKUP: EARLY, DROPOFF: EARLY}, ["time_order"], "temporal_inconsistency"),
    ({DROPOFF: LATE}, [], None),
    ({"PULocationID": 0}, ["pickup_zone"], "invalid_pickup_location"),
    ({"PULocationID": 1}, [], None),
    ({"PULocationID": 263}, [], None),
    ({"PULocationID": 264}, ["pickup_zone"], "invalid_pickup_location"),
    ({"PULocationID": None}, ["pickup_zone"], "multiple_issues"),
    ({"DOLocationID": 0}, ["dropoff_zone"], "invalid_dropoff_location"),
    ({"DOLocationID": 264}, ["dropoff_zone"], "invalid_dropoff_location"),
    ({"DOLocationID": None}, ["dropoff_zone"], "multiple_issues"),
    # The first broken rule names the reason.
    ({"fare_amount": -1.0, "passenger_count": 0.0}, ["fare_sign", "passengers_sign"], "negative_fare"),
    ({"passenger_count": 9.0, "DOLocationID": 0}, ["passengers_range", "dropoff_zone"], "invalid_dropoff_location"),
    ({"passenger_count": 0.0, DROPOFF: EARLY}, ["passengers_sign", "time_order"], "invalid_passenger_count"),
    ({"fare_amount": 2000.0, "trip_distance": 600.0}, ["distance_range", "fare_range"], "excessive_distance"),
    ({PICKUP: None, "fare_amount": None}, None, "null_pickup_datetime"),
]


@pytest.fixture(scope="module")
def tagged(spark):
    from tests.conftest import GOOD_TRIP, LANDING_DDL

    rows = [
        (number, *{**GOOD_TRIP, **changes}.values()) for number, (changes, _, _) in enumerate(CASES)
    ]
    df = spark.createDataFrame(rows, f"number int, {LANDING_DDL}")
    return {row.number: row for row in tag_quality(df).collect()}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_truth_table(tagged, number):
    changes, failed, reason = CASES[number]
    row = tagged[number]
    assert row.quarantine_reason == reason, changes
    if failed is not None:
        assert row.failed_rules == failed, changes


def test_split_is_complete(make):
    df = make(*(changes for changes, _, _ in CASES), {"fare_amount": -1.0}, {"fare_amount": -1.0})
    valid, rejected = valid_rows(df), rejected_rows(df, distinct=False)
    assert valid.count() + rejected.count() == df.count()
    once, by_set = rejected_rows(df), rejected_by_set_operation(df)
    assert once.count() == rejected.count() - 1
    assert once.exceptAll(by_set).count() == by_set.exceptAll(once).count() == 0
    _, labelled = split_quality(df)
    assert labelled.filter((F.size("failed_rules") < 1) | F.col("quarantine_reason").isNull()).isEmpty()


def test_text_is_judged_by_its_type(make):
    df = make({}, {"passenger_count": 0.0}, {"fare_amount": -3.0})
    text = df.select(*(F.col(name).cast("string") for name in df.columns))
    bad = text.limit(1).withColumn("fare_amount", F.lit("x"))
    reasons = [r.quarantine_reason for r in tag_quality(text.union(bad)).collect()]
    assert sorted(str(r) for r in reasons) == sorted(
        ["None", "invalid_passenger_count", "negative_fare", "null_fare"]
    )


def test_rule_results(make):
    df = make({}, {"fare_amount": None}, {"fare_amount": -1.0}, {"fare_amount": 5000.0})
    found = {row.rule: row for row in rule_results(df).collect()}
    assert list(found) == [rule.name for rule in trip_rules(df.schema)]
    assert (found["fare_sign"].passed, found["fare_sign"].broken, found["fare_sign"].undecided) == (2, 1, 1)
    assert {row.rule for row in rule_results(df, "range").collect()} == {
        "passengers_range",
        "distance_range",
        "fare_range",
    }
    per_rule = {row.rule: row.failures for row in failures_by_rule(df).collect() if row.failures}
    listed = failed_rule_rows(df).groupBy("rule").count().collect()
    assert per_rule == {row.rule: row["count"] for row in listed}
    assert per_rule == {"fare_present": 1, "fare_sign": 2, "fare_range": 2}


def test_quality_metrics(make):
    bad = {"fare_amount": -1.0}
    row = quality_metrics(make({}, {}, {}, bad, bad)).first()
    assert (row.input_rows, row.valid_rows, row.rejected_rows, row.invalid_rows) == (5, 3, 2, 1)
    assert (row.quality_rate, row.invalid_rate, row.status) == (60.0, 40.0, "WARNING")
    empty = quality_metrics(make({}).limit(0)).first()
    assert (empty.input_rows, empty.invalid_rows, empty.quality_rate) == (0, 0, 0.0)
    assert quality_metrics(make({}, {})).first().status == "SUCCESS"


def test_reason_share(make):
    rejected = split_quality(make({}, {"fare_amount": -1.0}, {"fare_amount": -2.0}, {"PULocationID": 0}))[1]
    shares = {row.quarantine_reason: row.share_pct for row in reason_share(rejected).collect()}
    assert shares == {
        "negative_fare": pytest.approx(200 / 3),
        "invalid_pickup_location": pytest.approx(100 / 3),
    }
