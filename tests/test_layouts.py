"""Files of one source under different headers, and the one-execution run."""

from __future__ import annotations

import json
import os

from finlens.operators.conform import conform_source
from finlens.sources import files as FS
from finlens.sources import layouts as L
from finlens.sources.registry import COUNTRY_SOURCE


def _file(path, text):
    os.makedirs(path.parent, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_columns_go_by_name(spark, tmp_path):
    _file(tmp_path / "in" / "a.csv", "Title,Year\nalpha,2001\n")
    _file(tmp_path / "in" / "b.csv", "Year,Title\n2002,beta\n")
    _file(tmp_path / "in" / "sub dir" / "c d.csv", '﻿Title,"Note, long"\ngamma,"x\ty"\n')
    _file(tmp_path / "in" / "e.csv", "Title,Year\ndelta,\n")
    rows = FS.read_csv_source(spark, str(tmp_path / "in"))
    assert rows.columns == ["Title", "Year", "Note, long", "row_ord"]
    got = sorted(tuple(r)[:3] for r in rows.collect())
    assert got == [("alpha", "2001", None), ("beta", "2002", None), ("delta", None, None), ("gamma", None, "x\ty")]
    found = L.layouts(spark, str(tmp_path / "in"))
    assert [len(x.files) for x in found] == [2, 1, 1] and found[0].header == ("Title", "Year")
    order = [r["Title"] for r in rows.orderBy("row_ord").collect()]
    assert order == ["alpha", "beta", "delta", "gamma"]


def test_one_header_stays_as_it_stands(spark, tmp_path):
    _file(tmp_path / "a.csv", "Status,,Status\nx,y,z\n")
    rows = FS.read_csv_source(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["Status", "", "Status", "row_ord"] and [tuple(r)[:3] for r in rows.collect()] == [("x", "y", "z")]


def test_blank_lines_empty_files_and_no_files(spark, tmp_path):
    _file(tmp_path / "in" / "a.csv", "\n  \nTitle\nalpha\n")
    _file(tmp_path / "in" / "b.csv", "")
    rows = FS.read_csv_source(spark, str(tmp_path / "in"))
    assert rows.columns == ["Title", "row_ord"]
    assert "alpha" in [r["Title"] for r in rows.collect()]
    _file(tmp_path / "none" / "b.csv", "")
    assert FS.read_csv_source(spark, str(tmp_path / "none")).collect() == []


def test_header_over_several_lines(spark, tmp_path):
    _file(tmp_path / "a.csv", '"Two\nlines",Year\n"x\ny",2001\n')
    rows = FS.read_csv_source(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert rows.columns[:2] == ["Two\nlines", "Year"] and [tuple(r)[:2] for r in rows.collect()] == [("x\ny", "2001")]


def test_large_files_are_not_read_for_their_header(spark, tmp_path):
    """Every split after the first rows is left, whole or not, and small files
    that share a task are all found."""
    for k in range(12):
        _file(tmp_path / "in" / f"s{k:02d}.csv", f"Title,k{k % 3}\n" + f"t{k},1\n" * 3)
    _file(tmp_path / "in" / "big.csv", "Year,Title\n" + "2001,some title here\n" * 60_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000b")
    try:
        headers = L.file_headers(spark, str(tmp_path / "in")).collect()
        rows = FS.read_csv_source(spark, str(tmp_path / "in"))
        assert len(headers) == 13 and rows.count() == 60_036
        assert rows.where("Year is not null").count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_conform_resolves_columns_per_layout(spark, tmp_path):
    _file(tmp_path / "a.csv", "Investor,Country,Year,Amount\nA,Indonesia,2001,5\n")
    _file(tmp_path / "b.csv", "Amount_musd,Year,Investor or Builder,Country\n2,2002,B,IDN\n")
    frames = FS.read_csv_layouts(spark, str(tmp_path))
    rows = [r for f in frames for r in conform_source(f, COUNTRY_SOURCE).collect()]
    assert sorted((r["project_name"], r["committed_usd"], r["year"]) for r in rows) == [("A", 5.0, 2001), ("B", 2e6, 2002)]


def test_raw_files_are_read_once(spark, tmp_path):
    """The run reads every raw file for its header and once for its rows: what
    comes after reads the stages.  The files are gone before the outputs."""
    raw = tmp_path / "raw"
    lines = "".join(f"P{i},Indonesia,{2000 + i % 9},{i}\n" for i in range(200))
    _file(raw / "country_investments_1.csv", "Investor,Country,Year,Amount\n" + lines)
    result = FS.run_from_folder(spark, str(raw), str(tmp_path / "out"))
    os.remove(raw / "country_investments_1.csv")
    assert result.enriched.count() == 200 and result.projects.count() == 200
    assert result.warnings.count() >= 1 and result.mapping_audit.count() > 5
    for frame in (result.enriched, result.loads, result.mapping_audit, result.projects, result.warnings):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "csv" not in plan.lower().replace("country_investments", "") and "Investor" not in plan
    report = json.loads("".join(p.read_text() for p in (tmp_path / "out" / "quality_report").glob("part-*")))
    assert report["row_count"] == 200
