"""What keeps the run from files in proportion to its input."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from finlens.functions.text import name_key
from finlens.operators.conform import conform_rows
from finlens.operators.enrich import heavy_keys
from finlens.plans.etl_queries import ROWS_PER_FILE, file_number
from finlens.sources import files as FS
from finlens.sources.raw_fixtures import DF_HEADER, ENRICH_HEADER
from finlens.sources.registry import DF_SOURCE, ENRICHMENT_SOURCE

JIT_LIMIT = 8000  # bytes of code of a method that the JVM still compiles


def test_files_grow_with_the_table(spark):
    """100 million lines once went to 25,000 files of one size."""
    def files(last):
        rows = spark.range(2001).select((F.col("id") * (last // 2000)).alias("row_ord")).union(
            spark.createDataFrame([(-5,), (None,)], "row_ord bigint"))
        parts = rows.select("row_ord", file_number(rows, ROWS_PER_FILE).alias("part")).orderBy(F.col("row_ord").asc_nulls_first()).collect()
        assert [r["part"] for r in parts] == sorted(r["part"] for r in parts)
        return len({r["part"] for r in parts})

    assert files(2000) == 1 and files(30_000) > 3
    assert files(100_000_000) < 400
    none = spark.createDataFrame([], "row_ord bigint")
    assert none.select(file_number(none, ROWS_PER_FILE)).collect() == []


@pytest.mark.parametrize(("spec", "header"), [(DF_SOURCE, DF_HEADER), (ENRICHMENT_SOURCE, ENRICH_HEADER)])
def test_the_conform_stage_can_be_compiled(spark, capsys, spec, header):
    """One method of 28,892 bytes parsed the development finance rows."""
    cells = ", ".join(f"c{i} string" for i in range(len(header) - 1)) + ", row_ord bigint"
    raw = spark.createDataFrame([("x",) * (len(header) - 1) + (1,)], cells).toDF(*header)
    conform_rows(raw, spec).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < JIT_LIMIT


def test_the_conformed_stage_lies_by_source(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    (raw / "project_details.csv").write_text("AidData Record ID,Recipient,Status\n1,Indonesia,late\n")
    (raw / "development_finance.csv").write_text("AidData Record ID,Title,Recipient\n1,A,Indonesia\n2,B,Malaysia\n")
    first = FS.run_from_folder(spark, str(raw), out)
    assert [(r["project_id"], r["status"]) for r in first.projects.collect()] == [("1", "late")]
    stage = os.path.join(out, "stages", "conformed")
    assert {d for d in os.listdir(stage) if "=" in d} == {"source_name=development_finance", "source_name=project_details"}
    # a second run without the enrichment leaves nothing of the first
    (raw / "project_details.csv").unlink()
    again = FS.run_from_folder(spark, str(raw), out)
    assert [(r["project_id"], r["status"]) for r in again.projects.collect()] == [("1", None)]
    assert {d for d in os.listdir(stage) if "=" in d} == {"source_name=development_finance"}


def test_name_keys_and_their_sketch(spark):
    names = ["a  b", "a\t\tb", " A\nb ", "a \t b", "a - b", "a b", "", None, "x\r\n\r\ny"]
    old = F.trim(F.regexp_replace(F.regexp_replace(F.lower("s"), r"\s+", " "), r"[^a-z0-9 ]+", ""))
    df = spark.createDataFrame([(s,) for s in names], "s string")
    assert [r[0] == r[1] for r in df.select(name_key("s"), old).collect()] == [True] * len(names)
    rows = spark.createDataFrame([("a",)] * 5 + [(None,)] * 20 + [("b",)], "s string")
    keyed = rows.withColumn("k", name_key("s"))
    assert heavy_keys(keyed, "k", 4, F.col("s").isNotNull()).collect() == heavy_keys(keyed, "k", 4).collect() != []
