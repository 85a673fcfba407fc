import os
import sys
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from zoneflow.config import SourceConfig  # noqa: E402
from zoneflow.session import SETTINGS  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").appName("zoneflow-tests")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "4g",
        "spark.ui.enabled": "false",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="zoneflow-warehouse-"),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def cfg(tmp_path):
    return SourceConfig(root=str(tmp_path), source="yellow-trips")


LANDING_DDL = (
    "VendorID int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
    "passenger_count double, trip_distance double, RatecodeID double, PULocationID bigint, "
    "DOLocationID bigint, payment_type bigint, fare_amount double, extra double, mta_tax double, "
    "tip_amount double, tolls_amount double, improvement_surcharge double, total_amount double, "
    "congestion_surcharge double, airport_fee double"
)
GOOD_TRIP = {
    "VendorID": 1,
    "tpep_pickup_datetime": datetime(2024, 1, 6, 10, 30),
    "tpep_dropoff_datetime": datetime(2024, 1, 6, 10, 50),
    "passenger_count": 2.0,
    "trip_distance": 5.0,
    "RatecodeID": 1.0,
    "PULocationID": 100,
    "DOLocationID": 200,
    "payment_type": 1,
    "fare_amount": 20.0,
    "extra": 0.5,
    "mta_tax": 0.5,
    "tip_amount": 4.0,
    "tolls_amount": 0.0,
    "improvement_surcharge": 1.0,
    "total_amount": 26.0,
    "congestion_surcharge": 2.5,
    "airport_fee": 0.0,
}


@pytest.fixture
def make(spark):
    """Trips like ``GOOD_TRIP``, each with the changes of one dict."""

    def build(*changes):
        rows = [tuple({**GOOD_TRIP, **change}.values()) for change in changes]
        return spark.createDataFrame(rows, LANDING_DDL)

    return build


@pytest.fixture
def deliver(cfg):
    """Write a frame to the landing directory of a month."""

    def write(df, month, config=None):
        config = config or cfg
        df.write.mode("append").format(config.fmt).option("header", True).save(
            config.batch_path("landing", month)
        )

    return write
