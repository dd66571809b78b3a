"""The reference's own unit cases, as inline DataFrames."""

from __future__ import annotations

import datetime as dt

from finlens.operators import metrics as M
from tests.conftest import rows


def test_realization_zero_and_null_committed(spark):
    df = spark.createDataFrame(
        [("a", 100.0, 50.0), ("b", 0.0, 10.0), ("c", None, 20.0)],
        "project_id string, committed_usd double, disbursed_usd double",
    )
    got = dict(rows(M.realization_by_project(df), "project_id", "realization_rate"))
    assert got == {"a": 0.5, "b": None, "c": None}


def test_implementation_days_null_either_side(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2020, 1, 1), dt.date(2020, 1, 11)), ("b", None, dt.date(2020, 2, 1)),
         ("c", dt.date(2021, 1, 1), None)],
        "project_id string, approval_date date, operation_date date",
    )
    got = dict(rows(M.with_implementation_days(df), "project_id", "time_to_implementation_days"))
    assert got == {"a": 10, "b": None, "c": None}


def test_exposure_excludes_cancelled_and_stalled(spark):
    df = spark.createDataFrame(
        [("A", 2021, 100.0, "operational"), ("A", 2021, 50.0, "cancelled"), ("A", 2021, 20.0, "stalled"),
         ("B", 2021, 40.0, "delayed")],
        "province string, year int, disbursed_usd double, status string",
    ).withColumn("approval_date", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("date"))
    got = rows(M.province_year_exposure(df), "province", "year", "province_year_exposure")
    assert got == [("A", 2021, 100.0), ("B", 2021, 40.0)]


def test_risk_index_default_weights(spark):
    df = spark.createDataFrame(
        [("cancelled", 100.0), ("stalled", 100.0), ("delayed", 100.0), ("operational", 100.0)],
        "status string, committed_usd double",
    )
    assert M.risk_index_global(df).first()["status_risk_index"] == 57.5


def test_concentration_zero_total_gives_null_shares(spark):
    df = spark.createDataFrame([("Energy", 0.0), ("Transport", 0.0)], "sector string, committed_usd double")
    out = M.sector_concentration(df).collect()
    assert len(out) == 2 and all(r["share"] is None for r in out)
