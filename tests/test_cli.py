import json

import pytest

from zoneflow.__main__ import parse, run
from zoneflow.config import LANDING
from zoneflow.sources import zones


def call(spark, cfg, *args):
    return run(spark, parse([*args, "--root", cfg.root, "--source", cfg.source]))


def test_commands(spark, cfg, make, deliver, capsys):
    deliver(make({}, {"passenger_count": 0.0}), "2024-01")
    call(spark, cfg, "status", "--month", "2024-01", "--last", "2024-02")
    call(spark, cfg, "landing-to-raw", "--month", "2024-01")
    call(spark, cfg, "raw-to-structured", "--month", "2024-01")
    call(spark, cfg, "run", "--month", "2024-01")
    call(spark, cfg, "backfill", "--month", "2024-01", "--last", "2024-03")
    call(spark, cfg, "promote", "--month", "2024-01")
    call(spark, cfg, "report")
    call(spark, cfg, "alerts")
    call(spark, cfg, "watch")
    with pytest.raises(SystemExit, match="lasting catalog"):
        call(spark, cfg, "register")
    printed = capsys.readouterr().out
    assert "skip" in printed and "quarantine_rate" in printed and "recovered" in printed
    assert "skipped: ('2024-02', '2024-03')" in printed


def test_failed_months_are_the_callers_business(spark, cfg, make, deliver):
    deliver(make({}), "2024-01")
    deliver(make({}).drop("fare_amount"), "2024-02")
    assert call(spark, cfg, "run", "--month", "2024-01") == 0
    assert call(spark, cfg, "backfill", "--month", "2024-01", "--last", "2024-02") == 1


def test_source_from_a_file(spark, cfg, make, deliver, tmp_path, capsys):
    params = {
        "root": cfg.root,
        "source": cfg.source,
        "columns": {"vendor": "VendorID"},
        "targets": {"min_quality": 10.0, "max_quarantine": 90.0},
    }
    path = tmp_path / "source.json"
    path.write_text(json.dumps(params))
    deliver(make({}, {"passenger_count": 0.0}).withColumnRenamed("VendorID", "vendor"), "2024-01")
    assert run(spark, parse(["run", "--config", str(path), "--month", "2024-01"])) == 0
    capsys.readouterr()
    run(spark, parse(["alerts", "--config", str(path), "--output", str(tmp_path / "out")]))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "alerts")).count() == 0
    assert zones.read_structured(spark, cfg).first().VendorID == 1


def test_month_is_needed(spark, cfg):
    with pytest.raises(SystemExit, match="needs --month"):
        call(spark, cfg, "run")
    with pytest.raises(SystemExit):
        parse(["fly", "--root", "r", "--source", "s"])


def test_landing_of_unknown_source_is_absent(spark, cfg, capsys):
    call(spark, cfg, "status", "--month", "2024-01")
    assert "skip" in capsys.readouterr().out
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        zones.read_batches(spark, cfg, LANDING, ["2024-01"])


def test_reports_of_some_months(spark, cfg, make, deliver, capsys):
    deliver(make({}, {"fare_amount": -1.0}), "2024-01")
    deliver(make(*[{"trip_distance": -1.0}] * 2).coalesce(1), "2024-02")
    call(spark, cfg, "backfill", "--month", "2024-01", "--last", "2024-02")
    capsys.readouterr()
    call(spark, cfg, "report", "--month", "2024-01")
    printed = capsys.readouterr().out
    assert "negative_fare\t1" in printed and "negative_distance" not in printed
    assert "quarantine_by_ds" in printed and "2024-01-06\t1" in printed
    call(spark, cfg, "report", "--month", "2023-01")
    call(spark, cfg, "report")
    assert "negative_distance\t1" in capsys.readouterr().out
