"""One test per semantic trap (null, tie, order and parsing rules)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from finlens.functions.dates import parse_date_any
from finlens.functions.numeric import clean_numeric
from finlens.functions.text import name_key, title_case_words
from finlens.operators import browser as B
from finlens.operators import facets as FC
from finlens.operators import metrics as M
from finlens.operators import reports as R
from finlens.operators.conform import clean_column_names, resolve_column
from tests.conftest import rows


def test_t1_short_candidates_do_not_substring_match():
    cols = ["Investor", "Sector", "Country", "Year"]
    assert resolve_column(cols, ["Latitude", "latitude", "Lat", "lat", "Y", "y_coord"]) is None
    assert resolve_column(["Project Latitude"], ["Latitude"]) == "Project Latitude"
    assert resolve_column(["Status", "Status.1"], ["Status"]) == "Status"


def test_b1_header_cleanup(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], "x string, y string, z string, w string")
    df = df.toDF("﻿Country", " ", "Status", "Status")
    assert clean_column_names(df).columns == ["Country", "Unnamed: 1", "Status", "Status.1"]


def test_t2_null_status_is_active(spark):
    df = spark.createDataFrame([("A", 2020, 10.0, None), ("A", 2020, 5.0, "Cancelled")],
                               "province string, year int, disbursed_usd double, status string")
    df = df.withColumn("approval_date", F.lit(None).cast("date"))
    assert rows(M.province_year_exposure(df), "province_year_exposure") == [(10.0,)]


def test_t3_nsum_vs_zsum(spark):
    df = spark.createDataFrame([("P", None, None, dt.date(2020, 1, 1), None)],
                               "province string, committed_usd double, disbursed_usd double, "
                               "approval_date date, operation_date date")
    cohort = M.approval_cohorts(df).first()
    assert cohort["committed_usd"] == 0.0 and cohort["disbursed_usd"] == 0.0
    assert M.overall_realization(df).first()["committed_total"] is None


def test_t6_id_hash_null_parts_keep_positions(spark):
    from finlens.functions.ids import deterministic_id

    df = spark.createDataFrame([(None, 2020, "Indonesia")], "name string, year int, country string")
    got = df.select(deterministic_id("src", F.col("name"), F.col("year"), F.col("country")).alias("id")).first()["id"]
    import hashlib

    assert got == "gen_" + hashlib.sha1(b"src||2020|Indonesia").hexdigest()[:16]


def test_t8_dates_row_local_formats(spark):
    vals = ["2020-01-02", "1/2/2020", "2019", "43831", "not a date", "2020-01-02 00:00:00", None, ""]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r["d"] for r in df.select(parse_date_any("s").alias("d")).collect()]
    assert got == [dt.date(2020, 1, 2), dt.date(2020, 1, 2), dt.date(2019, 1, 1), dt.date(2020, 1, 1), None,
                   dt.date(2020, 1, 2), None, None]


def test_t9_numeric_cleaning(spark):
    vals = ["$1,234", "(500)", "1d", "", "NaN", " 42 ", "1e3", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r["v"] for r in df.select(clean_numeric("s").alias("v")).collect()]
    assert got == [1234.0, -500.0, None, None, None, 42.0, 1000.0, None]


def test_t10_title_case_after_any_non_word(spark):
    vals = ["UNALLOCATED/UNSPECIFIED", "  oil  &  gas ", "e-commerce", "3d printing", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r["t"] for r in df.select(title_case_words("s").alias("t")).collect()]
    assert got == ["Unallocated/Unspecified", "Oil & Gas", "E-Commerce", "3d Printing", None]


def test_t11_name_key_collapses_before_stripping(spark):
    df = spark.createDataFrame([("A - B",)], "s string")
    assert df.select(name_key("s").alias("k")).first()["k"] == "a  b"


def test_t13_custom_risk_weights(spark):
    df = spark.createDataFrame([("Suspended", 100.0), ("Completion", 100.0)], "status string, committed_usd double")
    assert M.risk_index_global(df).first()["status_risk_index"] == 0.0
    assert M.risk_index_global(df, {"suspended": 1.0}).first()["status_risk_index"] == 50.0


def test_t16_all_selected_keeps_nulls(spark):
    df = spark.createDataFrame([("1", "DF", None), ("2", "FDI", "x"), ("3", None, "y")],
                               "project_id string, finance_type string, status string")
    dashboard = FC.apply_facets(df, {"finance_type": ["DF", "FDI"]})
    strict = FC.apply_facets_strict(df, {"finance_type": ["DF", "FDI"]})
    assert dashboard.count() == 3 and strict.count() == 2
    narrowed = FC.apply_facets(df, {"finance_type": ["fdi"]})
    assert [r["project_id"] for r in narrowed.collect()] == ["2"]


def test_t19_other_bucket_scope_is_the_input(spark):
    df = spark.createDataFrame([(f"s{i}", float(10 - i)) for i in range(9)], "sector string, value double")
    out = R.sector_share_with_other(df, top=6).orderBy("position").collect()
    assert [r["sector"] for r in out][-1] == "Other sectors"
    assert out[-1]["committed_usd"] == 4.0 + 3.0 + 2.0
    assert abs(sum(r["share_pct"] for r in out) - 100.0) < 1e-4


def test_browser_unknown_groups_and_zsum(spark):
    df = spark.createDataFrame([("1", "", 5.0), ("2", None, None), ("3", "Energy", 1.0)],
                               "project_id string, sector string, committed_usd double")
    got = rows(B.top_sectors(df, 5), "sector", "value")
    assert got == [("Energy", 1.0), ("Unknown", 5.0)]


def test_histogram_constant_values_fall_in_bin_one(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    out = R.histogram(df, "v").collect()
    assert len(out) == 30 and out[0]["projects"] == 2 and sum(r["projects"] for r in out) == 2


def test_e47_finance_fallback_and_order(spark):
    df = spark.createDataFrame([("1", " ", "S", 2020), ("2", None, "S", 2019)],
                               "project_id string, finance_type string, sector string, year int")
    got = [(r["facet"], r["position"], r["value"]) for r in FC.facet_values(df).collect()]
    assert ("finance_type", 1, "DF") in got and ("finance_type", 2, "FDI") in got
    assert ("year", 1, "2019") in got and ("year", 2, "2020") in got
    typed = spark.createDataFrame([("1", "fdi"), ("2", "DF"), ("3", "OTHER")], "project_id string, finance_type string")
    got = sorted((r["position"], r["value"]) for r in FC.facet_values(typed).collect())
    assert got == [(1, "DF"), (2, "FDI"), (3, "OTHER")]


def test_b11_blank_rows_dropped_before_counting(spark):
    from finlens.operators.conform import conform_source, source_profile
    from finlens.sources.registry import COUNTRY_SOURCE

    raw = spark.createDataFrame(
        [("Alpha", "Energy", "Indonesia", "2020", 0), (" ", None, "", None, 1), (None, None, None, None, 2)],
        "a string, b string, c string, d string, row_ord long",
    ).toDF("Investor or Builder", "Sector", "Country", "Year", "row_ord")
    assert conform_source(raw, COUNTRY_SOURCE).count() == 1
    counts = source_profile(raw, COUNTRY_SOURCE).first()
    assert counts["rows_in_source"] == 1 and counts["rows_excluded"] == 0


def test_c13_fallback_view_only_when_coordinates_are_sparse(spark):
    rows = [(str(i), None if i % 2 else f"P{i}", float(i), None if i else "Done", None, None) for i in range(25)]
    df = spark.createDataFrame(rows, "project_id string, project_name string, committed_usd double, status string, "
                                     "latitude double, longitude double").withColumn("finance_type", F.lit("DF")) \
        .withColumn("year", F.lit(2020))
    out = R.fallback_top_projects(df).collect()
    assert len(out) == 20 and out[0]["committed_usd"] == 24.0 and out[0]["project_name"] == "P24"
    assert out[1]["project_name"] == "Unnamed Project" and out[1]["status"] == "Unknown"
    assert out[-1]["committed_usd"] == 5.0
    covered = df.withColumn("latitude", F.lit(1.0)).withColumn("longitude", F.lit(2.0))
    assert R.fallback_top_projects(covered).count() == 0
