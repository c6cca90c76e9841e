"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as suite
import verify
from epitally.suite.registry import QUERIES, TWINS

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the supplied tables are not here")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, note = verify.compare(spark, FOLDER, name)
    assert ok, note


def test_entry(spark):
    df = suite.entry(spark)
    assert df.columns == ["region", "date", "times", "values"]
    assert df.count() > 0


def test_twins_belong_to_queries():
    assert set(suite.oracle_sql()) <= set(suite.queries())
    assert set(QUERIES) == set(TWINS)


def test_icu_job_without_complete_days(spark, folder):
    """Where every day lacks a report no total is left, and the job's regional folder gets no file."""
    days = spark.range(200).selectExpr(
        "id AS l_suppkey", "211 * id AS l_orderkey", "5.0D AS l_quantity",
        "CAST(date_add(DATE'1996-01-01', CAST(id % 20 AS INT)) AS TIMESTAMP) AS l_shipdate",
    )
    days.write.parquet(f"{folder}/lineitem.parquet")
    assert suite.queries()["icu_job"](spark, folder).collect() == []
