"""What keeps the shuffles and writes of large tables small."""

import re
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

from pyspark.sql import functions as F

from checks import lake, queries
from checks.trips import derive_trips
from tests.conftest import GOOD_TRIP, TESTDATA
from zoneflow import storage
from zoneflow.config import LANDING, PICKUP, STRUCTURED
from zoneflow.operators.enrich import structure
from zoneflow.sources import sinks
from zoneflow.sources.zones import read_landing, read_structured


def rebalanced(df):
    """Shuffle partitions and columns of the rebalance in a plan."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while not plan.nodeName().startswith("RebalancePartitions"):
        plan = plan.children().head()
    columns = plan.output()
    return plan.toString().split("\n")[0], [columns.apply(i).name() for i in range(columns.size())]


def test_directories_do_not_make_a_shuffle_hold_its_rows(spark):
    df = spark.range(9).withColumn("ds", F.col("id").cast("string"))
    for directories, wanted in ((31, 31), (31 * 83, 200)):
        head, _ = rebalanced(sinks.size_for_write(df, "ds", directories=directories))
        assert re.search(rf"\b{wanted}\b", head), head


def test_raw_rows_are_shuffled_before_they_get_their_features(spark, make):
    days = [GOOD_TRIP[PICKUP] + timedelta(days=n) for n in range(5)]
    raw = make(*({PICKUP: day, "tpep_dropoff_datetime": day + timedelta(minutes=9)} for day in days))
    raw = raw.withColumn("batch_month", F.lit("2024-01"))
    gathered = structure(sinks.gather_days(raw, 31))
    _, shuffled = rebalanced(gathered)
    assert "fare_amount" in shuffled and "avg_speed_mph" not in shuffled
    assert gathered.columns == structure(raw).columns
    assert sorted(map(str, gathered.collect())) == sorted(map(str, structure(raw).collect()))


def test_derived_trips_are_gathered_before_most_columns_are_there(spark):
    gathered = derive_trips(spark, f"{TESTDATA}/sf0.001", gather=True)
    _, shuffled = rebalanced(gathered)
    assert len(shuffled) <= 8 and len(gathered.columns) == 19
    plain = derive_trips(spark, f"{TESTDATA}/sf0.001")
    assert gathered.exceptAll(plain).isEmpty() and plain.exceptAll(gathered).isEmpty()


def test_writes_sort_nothing_while_few_directories_are_met(spark, tmp_path):
    assert spark.conf.get(sinks.OPEN_FILES, "0") == "0"
    rows = spark.range(0, 1000, 1, 2).withColumn("month", F.col("id") % 3)

    def write(n):
        with sinks.files_kept_open(spark):
            rows.write.partitionBy("month").parquet(f"{tmp_path}/{n}")
            return spark.conf.get(sinks.OPEN_FILES)

    with ThreadPoolExecutor(4) as pool:
        assert set(pool.map(write, range(4))) == {str(sinks.FILES_AT_ONCE)}
    assert spark.conf.get(sinks.OPEN_FILES, "0") == "0"
    assert [spark.read.parquet(f"{tmp_path}/{n}").count() for n in range(4)] == [1000] * 4


def test_a_task_meets_no_more_days_than_it_keeps_files_open(spark, cfg):
    months = [f"2024-{m:02d}" for m in range(1, 7)]
    rows = spark.range(0, 6 * 28 * 20, 1, 3).select(
        "id",
        F.concat(F.lit("2024-"), F.lpad((F.col("id") % 6 + 1).cast("string"), 2, "0")).alias("batch_month"),
        F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0").alias("ds"),
    )
    sinks.write_structured(rows, cfg, months)
    days = {}
    for name in storage.files(spark, cfg.zone_root(STRUCTURED)):
        if found := re.search(r"batch_month=(.*)/ds=(.*)/part-(\d+)-", name):
            days.setdefault(found[3], set()).add(found.group(1, 2))
    assert sum(map(len, days.values())) == 84
    assert max(map(len, days.values())) <= sinks.FILES_AT_ONCE
    assert read_structured(spark, cfg).count() == rows.count()
    assert spark.conf.get(sinks.MERGED) == "true"


def test_a_number_of_open_files_of_the_session_stays(spark):
    spark.conf.set(sinks.OPEN_FILES, 7)
    try:
        with sinks.files_kept_open(spark):
            assert spark.conf.get(sinks.OPEN_FILES) == "7"
        assert spark.conf.get(sinks.OPEN_FILES) == "7"
    finally:
        spark.conf.unset(sinks.OPEN_FILES)


def test_landed_text_is_packed_and_in_files_a_task_can_take(spark, monkeypatch):
    monkeypatch.setattr(lake, "TEXT_ROWS", 20)
    trips = derive_trips(spark, f"{TESTDATA}/sf0.001", gather=True)
    for fmt in ("csv", "json"):
        cfg = lake.empty_lake(spark, f"packed-{fmt}", fmt)
        lake.land(trips, cfg)
        files = list(storage.files(spark, cfg.zone_root(LANDING)))
        assert all(name.endswith(f".{fmt}.gz") for name in files)
        assert len(files) > 6009 / 20
        assert read_landing(spark, cfg).count() == 6009


def test_rows_written_by_day_are_gathered_without_their_features(spark):
    sf = f"{TESTDATA}/sf0.001"
    gathered = queries.clean_by_day(spark, sf)
    _, shuffled = rebalanced(gathered)
    assert "fare_amount" in shuffled and "avg_speed_mph" not in shuffled
    assert gathered.columns == queries.clean(spark, sf).columns
    assert gathered.exceptAll(queries.clean(spark, sf)).isEmpty()
