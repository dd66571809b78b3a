"""Sources and sinks by write / read-back, and the streaming ingest."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from finlens.functions.dates import parse_date_any
from finlens.operators.conform import coerce_schema, conform_source, resolve_column
from finlens.operators.enrich import keep_first
from finlens.schema import (
    CANONICAL_FIELDS,
    DISTRICT_CANDIDATES,
    LATITUDE_CANDIDATES,
    LONGITUDE_CANDIDATES,
    PROVINCE_CANDIDATES,
)
from finlens.sources import files as FS
from finlens.sources.fixtures import projects
from finlens.sources.registry import COUNTRY_SOURCE
from finlens.streaming.ingest import start_incremental_conform

HEADER = ["Investor or Builder", "Sector", "Country", "Province", "Status", "Amount_musd", "Amount", "Year"]
LINES = [
    ["Alpha Corp", "Metals", "Indonesia", "Central Sulawesi", "Completion", "1.5", "", "2019"],
    ["Beta Ltd", "Energy", "Malaysia", "Johor", "Completion", "", "$2,000", "2020"],
    ["Gamma", "Energy", "IDN", "Banten", "", "", "(300)", "2021"],
    ["Alpha Corp", "Metals", "Indonesia", "Central Sulawesi", "Suspended", "9", "", "2019"],
]


def _write_csv(path, header, lines, bom=True):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(("﻿" if bom else "") + ",".join(header) + "\n")
        for ln in lines:
            fh.write(",".join(f'"{v}"' if "," in v else v for v in ln) + "\n")


def test_csv_discover_and_conform(spark, tmp_path):
    raw = tmp_path / "raw"
    os.makedirs(raw / "sub")
    _write_csv(raw / "sub" / "country.csv", HEADER, LINES)
    (raw / "notes.txt").write_text("ignored")
    listing = FS.discover_raw_files(spark, str(raw)).collect()
    assert [r["file_name"] for r in listing] == ["country.csv"]
    df = FS.read_csv_source(spark, str(raw / "sub" / "country.csv"))
    out = conform_source(df, COUNTRY_SOURCE).orderBy("row_ord").collect()
    assert [r["project_name"] for r in out] == ["Alpha Corp", "Gamma", "Alpha Corp"]
    assert [r["committed_usd"] for r in out] == [1_500_000.0, -300.0, 9_000_000.0]
    assert out[0]["project_id"] == out[2]["project_id"]  # same name|year|country -> same id
    first = keep_first(conform_source(df, COUNTRY_SOURCE), ["project_id", "finance_type"], ["source_rank", "row_ord"])
    assert sorted(r["status"] or "" for r in first.collect()) == ["", "Completion"]


def test_projects_parquet_roundtrip(spark, tmp_path, small_dir):
    p = projects(spark, small_dir)
    out = str(tmp_path / "projects")
    FS.write_projects(p, out)
    back = FS.read_projects_parquet(spark, out)
    assert back.columns == CANONICAL_FIELDS
    assert back.count() == p.count()
    assert back.where(F.col("finance_type") == "FDI").count() == p.where(F.col("finance_type") == "FDI").count()


def test_quality_report_roundtrip_and_fallbacks(spark, tmp_path, small_dir):
    p = projects(spark, small_dir)
    warnings = spark.createDataFrame([("s", "missing_primary_source", "m")], FS.WARNING_STRUCT)
    loads = spark.createDataFrame([], FS.LOAD_STRUCT)
    report = FS.quality_report(p, warnings, loads, 3)
    path = str(tmp_path / "report")
    FS.write_quality_report(report, path)
    back = FS.read_quality_report(spark, path).first()
    assert back["raw_file_count"] == 3 and back["warning_count"] == 1
    assert back["missing_pct"]["district"] == 100.0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part.json").write_text("{not json\n")
    (stub,) = FS.read_quality_report(spark, str(bad)).collect()
    assert stub["warning_count"] == 1 and stub["warnings"][0]["warning_type"] == "invalid_quality_json"
    assert set(stub["missing_pct"].values()) == {100.0} and stub["row_count"] == 0
    (absent,) = FS.read_quality_report(spark, str(tmp_path / "absent"), p).collect()
    assert absent["missing_pct"]["district"] == 100.0 and absent["missing_pct"]["project_id"] == 0.0
    assert absent["warning_count"] == 1 and absent["warnings"][0]["warning_type"] == "quality_file_missing"
    assert absent["row_count"] == p.count()
    indented = tmp_path / "indented.json"
    indented.write_text(json.dumps(json.loads(report.toJSON().first()), indent=2))
    (whole,) = FS.read_quality_report(spark, str(indented)).collect()
    assert whole["row_count"] == p.count() and whole["warnings"][0]["warning_type"] == "missing_primary_source"


def test_strict_coercion_on_read(spark):
    df = spark.createDataFrame(
        [("1", "(500)", "43831", "2020.0", " x "), ("2", "$1,234", "2020-01-02", "2020.5", ""), ("3", "1e3", "1/2/2020", "abc", None)],
        "project_id string, committed_usd string, approval_date string, year string, sector string")
    got = [(r["committed_usd"], str(r["approval_date"]), r["year"], r["sector"]) for r in
           coerce_schema(df).orderBy("project_id").collect()]
    assert got == [(None, "None", 2020, "x"), (None, "2020-01-02", None, None), (1000.0, "2020-01-02", None, None)]


def test_file_order_over_several_files(spark, tmp_path):
    """The later-named file loses, although it is larger and read first."""
    raw = tmp_path / "raw" / "country_investments"
    raw.mkdir(parents=True)
    _write_csv(raw / "a.csv", HEADER, [LINES[0]], bom=False)
    _write_csv(raw / "b.csv", HEADER, [LINES[3], *([LINES[2]] * 500)], bom=False)
    df = FS.read_csv_source(spark, str(raw))
    out = keep_first(conform_source(df, COUNTRY_SOURCE), ["project_id", "finance_type"], ["source_rank", "row_ord"])
    assert {r["project_name"]: r["status"] for r in out.collect()} == {"Alpha Corp": "Completion", "Gamma": None}


def test_file_order_in_a_split_file(spark, tmp_path):
    path = tmp_path / "country.csv"
    lines = [["Alpha Corp", "Metals", "Indonesia", "", f"s{i}", "1", "", "2019"] for i in range(3000)]
    _write_csv(path, HEADER, lines, bom=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = FS.read_csv_source(spark, str(path))
        assert df.select("row_ord.block").distinct().count() > 3 and df.count() == 3000
        assert [r["Status"] for r in df.orderBy("row_ord").collect()] == [f"s{i}" for i in range(3000)]
        first = keep_first(conform_source(df, COUNTRY_SOURCE), ["project_id"], ["row_ord"])
        assert [r["status"] for r in first.collect()] == ["s0"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_run_from_folder(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    _write_csv(raw / "country_investments_1.csv", HEADER, LINES)
    _write_csv(raw / "country_investments_2.csv", HEADER, [LINES[3]])
    (raw / "other.xlsx").write_bytes(b"x")
    result = FS.run_from_folder(spark, str(raw), str(tmp_path / "out"))
    assert sorted(r["project_name"] for r in result.projects.collect()) == ["Alpha Corp", "Gamma"]
    loads = {r["source_name"]: r for r in result.loads.collect()}
    assert loads["country_investments"]["rows_in_source"] == 5 and loads["country_investments"]["parser_used"] == "csv"
    assert loads["development_finance"]["note"] == "required_primary_source_missing"
    (report,) = FS.read_quality_report(spark, str(tmp_path / "out" / "quality_report")).collect()
    assert report["raw_file_count"] == 3 and report["row_count"] == 2
    assert "generated_id_collision" in {w["warning_type"] for w in report["warnings"]}


def test_two_enrichment_sources_and_unknown_names(spark):
    from dataclasses import replace

    from finlens.operators.etl import run_etl
    from finlens.sources.registry import DF_SOURCE, ENRICHMENT_SOURCE

    primary = spark.createDataFrame([("1", "A", "Indonesia", 0), ("2", "B", "Indonesia", 1)], "a string, b string, c string, row_ord bigint").toDF(
        "AidData Record ID", "Title", "Recipient", "row_ord")
    def extra(rows):
        return spark.createDataFrame([(i, "Indonesia", s, k) for k, (i, s) in enumerate(rows)], "a string, b string, c string, row_ord bigint").toDF(
            "AidData Record ID", "Recipient", "Status", "row_ord")
    second = replace(ENRICHMENT_SOURCE, name="more_details", rank=10)
    run = run_etl(spark, {"development_finance": primary, "project_details": extra([("1", "first")]),
                          "more_details": extra([("1", "late"), ("2", "second")]), "typo": primary},
                  [DF_SOURCE, ENRICHMENT_SOURCE, second])
    assert {r["project_id"]: r["status"] for r in run.projects.collect()} == {"1": "first", "2": "second"}
    assert ("typo", "unregistered_source") in {(r["source_name"], r["warning_type"]) for r in run.warnings.collect()}


def test_headers_that_only_look_alike_resolve_to_nothing():
    columns = ["Related Deals", "Long Term Debt", "Capacity MW", "Xylophone", "Recipient ISO-3"]
    for candidates in (LATITUDE_CANDIDATES, LONGITUDE_CANDIDATES, DISTRICT_CANDIDATES, PROVINCE_CANDIDATES):
        assert resolve_column(columns, candidates) is None
    assert resolve_column(["Project Latitude (deg)", "LAT"], LATITUDE_CANDIDATES) == "LAT"
    assert resolve_column(["x", "Host Province Name"], PROVINCE_CANDIDATES) == "Host Province Name"
    assert resolve_column(["project_id", "ProjectID"], ["Project ID"]) == "project_id"


def test_more_date_layouts(spark):
    values = ["2020-01-02T00:00:00", "2020/01/02", "1/2/2020 12:00:00 AM", "2020-1-2", "02 Jan 2020", "2020-13-01"]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    got = [str(r[0]) for r in df.select(parse_date_any("d")).collect()]
    assert got == ["2020-01-02"] * 4 + ["None", "None"]


def test_streaming_ingest_matches_batch(spark, tmp_path):
    raw = tmp_path / "incoming"
    raw.mkdir()
    _write_csv(raw / "a.csv", HEADER, LINES[:3], bom=False)
    table = str(tmp_path / "table")
    q = start_incremental_conform(spark, str(raw), HEADER, COUNTRY_SOURCE, table, str(tmp_path / "chk"))
    q.awaitTermination(120)
    got = spark.read.parquet(table)
    assert sorted(r["project_name"] for r in got.collect()) == ["Alpha Corp", "Gamma"]
    # a later file: a key already loaded (kept first) and a new project; the
    # restarted query resumes from its checkpoint and only reads the new file
    _write_csv(raw / "c.csv", HEADER, [LINES[3], ["Delta", "Energy", "Indonesia", "Bali", "", "2", "", "2022"]],
               bom=False)
    q = start_incremental_conform(spark, str(raw), HEADER, COUNTRY_SOURCE, table, str(tmp_path / "chk"))
    q.awaitTermination(120)
    got = spark.read.parquet(table).collect()
    assert sorted(r["project_name"] for r in got) == ["Alpha Corp", "Delta", "Gamma"]
    alpha = [r for r in got if r["project_name"] == "Alpha Corp"][0]
    assert alpha["status"] == "Completion" and alpha["committed_usd"] == 1_500_000.0
