from datetime import datetime

from pyspark.sql import functions as F

from zoneflow.operators.quality import split_quality
from zoneflow.operators.remediation import recovery_report, remediate, repair_types, repair_values

PICKUP, DROPOFF = "tpep_pickup_datetime", "tpep_dropoff_datetime"


def as_text(df, **changes):
    text = df.select(*(F.col(name).cast("string") for name in df.columns))
    return text.withColumns({name: F.lit(value) for name, value in changes.items()})


def test_formats(make):
    one = make({})
    us_time = as_text(one, **{PICKUP: "01/06/2024 10:30:00"})
    cases = {
        "plain": as_text(one, fare_amount=" 20.0 "),
        "money": as_text(one, fare_amount="$1,020.50"),
        "time": us_time,
        "both": us_time.withColumn("trip_distance", F.lit("1 000")),
        "hopeless": as_text(one, fare_amount="x", trip_distance=""),
    }
    rows = {name: repair_types(df).first() for name, df in cases.items()}
    assert rows["plain"].remediation == [] and rows["plain"].fare_amount == 20.0
    assert rows["money"].remediation == ["number_format"] and rows["money"].fare_amount == 1020.5
    assert rows["time"].remediation == ["time_format"]
    assert rows["time"][PICKUP] == datetime(2024, 1, 6, 10, 30)
    assert rows["both"].remediation == ["number_format", "time_format"]
    assert rows["hopeless"].fare_amount is None and rows["hopeless"].remediation == []
    assert repair_types(one).first().remediation == []


def test_values(make):
    df = make(
        {},
        {"passenger_count": None},
        {"passenger_count": 0.0, "payment_type": 0},
        {DROPOFF: datetime(2024, 1, 6, 10)},
        {DROPOFF: None, "fare_amount": -2.0},
    )
    rows = repair_values(df).collect()
    assert [row.remediation for row in rows] == [
        [],
        ["default_passengers"],
        ["default_passengers", "unknown_payment"],
        ["swapped_times"],
        [],
    ]
    assert (rows[1].passenger_count, rows[2].payment_type) == (1.0, 5)
    assert rows[3][PICKUP] == datetime(2024, 1, 6, 10) and rows[3][DROPOFF] == datetime(2024, 1, 6, 10, 30)
    assert rows[4].fare_amount == -2.0
    assert repair_values(df).drop("remediation").schema.simpleString() == df.schema.simpleString()


def test_recovery(make):
    rejected = split_quality(
        make(
            {},
            {"passenger_count": 0.0},
            {"passenger_count": 0.0, "fare_amount": 3000.0},
            {"fare_amount": -1.0},
            {DROPOFF: datetime(2024, 1, 6, 10)},
        )
    )[1]
    judged = remediate(rejected)
    assert sorted(tuple(r) for r in recovery_report(judged).collect()) == [
        ("invalid_passenger_count", 1, 1),
        ("negative_fare", 0, 1),
        ("temporal_inconsistency", 1, 0),
    ]
    still = judged.filter("original_reason = 'invalid_passenger_count' AND quarantine_reason IS NOT NULL")
    assert still.first().quarantine_reason == "excessive_fare"
