"""All queries against DuckDB, and the trips themselves against their known counts."""

import os

import duckdb
import pytest

import __spark_entry__
from checks import queries as own
from checks.compare import TABLES, connect, difference
from checks.lake import trips
from tests.conftest import TESTDATA
from zoneflow.operators.quality import quality_metrics

SF = f"{TESTDATA}/sf0.001"
QUERIES, ORACLE = own.QUERIES, __spark_entry__.oracle_sql()
# Each writes a directory a day several times; three months on either side of the queries' own
# turning point show the same.
BY_DAY = {
    "arrival_changes",
    "arrival_once",
    "catalog_repair",
    "job_raw_to_structured",
    "remediate_promote",
    "run_month",
    "second_source",
    "structured_append",
    "structured_replace",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def few_months(tmp_path_factory):
    """The smallest tables with three months of ``lineitem``."""
    where = tmp_path_factory.mktemp("months")
    for table in TABLES:
        if table != "lineitem":
            os.symlink(f"{SF}/{table}.parquet", where / f"{table}.parquet")
    duckdb.sql(f"""COPY (SELECT * FROM '{SF}/lineitem.parquet'
      WHERE l_shipdate >= DATE '1998-05-15' AND l_shipdate < DATE '1998-08-01')
      TO '{where}/lineitem.parquet' (FORMAT parquet)""")
    return str(where)


def test_every_query_has_an_answer():
    assert own.QUERIES.keys() == ORACLE.keys() & own.QUERIES.keys()


@pytest.mark.parametrize("name", [name for name in QUERIES if name not in BY_DAY])
def test_same_rows(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(BY_DAY))
def test_same_rows_of_few_months(spark, few_months, name):
    assert difference(QUERIES[name](spark, few_months), connect(few_months), ORACLE[name]) is None


def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 13 and sum(row["count"] for row in rows) == 106


@pytest.mark.parametrize(
    ("sf", "rows", "valid", "rejected", "distinct"),
    [("0.001", 6009, 5898, 111, 106), ("0.01", 60135, 58894, 1241, 1169)],
)
def test_known_counts(spark, sf, rows, valid, rejected, distinct):
    found = quality_metrics(trips(spark, f"{TESTDATA}/sf{sf}")).first()
    assert tuple(found)[:4] == (rows, valid, rejected, distinct)
