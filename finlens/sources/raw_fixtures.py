"""Raw-file-shaped stand-in sources, derived from the ``projects`` fixture.

These only format canonical values back into the text columns a raw
spreadsheet export would have (with the messy variants conform must handle:
currency symbols, thousands separators, parentheses, junk numbers, four date
spellings, blank ids, duplicate and blank headers, copies of rows).  They do
none of the conform work.  Each builder is one SQL text with a small dialect
shim (string building uses the null-propagating ``||`` in both engines) so Spark (``spark.sql(text, projects=df)``) and the DuckDB oracle start
from identical rows.  ``row_ord`` plays the role of the line number in the
file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finlens.sources.fixtures import materialize, memo_plan, projects

SPARK, DUCKDB = "spark", "duckdb"


def _thousands(x: str, dialect: str) -> str:
    if dialect == SPARK:
        return f"format_number(CAST({x} AS BIGINT), 0)"
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def _serial(d: str, dialect: str) -> str:
    if dialect == SPARK:
        return f"CAST(datediff({d}, DATE'1899-12-30') AS STRING)"
    return f"CAST(date_diff('day', DATE '1899-12-30', {d}) AS STRING)"


def _mdy(d: str) -> str:
    return (f"(CAST(month({d}) AS STRING) || '/' || CAST(day({d}) AS STRING) || '/' || "
            f"CAST(year({d}) AS STRING))")


def _int(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS STRING)"


def _millions(x: str) -> str:
    """Exact decimal text of x / 1e6 built with integer arithmetic."""
    v = f"CAST({x} AS BIGINT)"
    return (f"(CAST(CAST(floor({v} / 1000000) AS BIGINT) AS STRING) || '.' || "
            f"lpad(CAST({v} % 1000000 AS STRING), 6, '0'))")


def _src(dialect: str) -> str:
    return "{projects}" if dialect == SPARK else "projects"


# Header lists as a spreadsheet would carry them; '' is a blank header cell
# and 'Status' appears twice.
DF_HEADER = [
    "AidData Record ID", "Title", "Recipient", "Recipient ISO-3", "Sector Name", "Available ADM1 Level",
    "Status", "Commitment Date", "Actual Implementation Start Date", "Planned Implementation Start Date",
    "Actual Completion Date", "Planned Completion Date", "Adjusted Amount (Nominal USD)",
    "Amount (Nominal USD)", "Disbursed Amount (Nominal USD)", "Commitment Year", "", "Status", "row_ord",
]


def raw_df_sql(dialect: str) -> str:
    k = "CAST(project_id AS BIGINT)"
    iso_date = "CAST(approval_date AS STRING)"
    return f"""
SELECT
  CASE WHEN {k} % 31 = 5 THEN '' ELSE project_id END AS c0,
  project_name AS c1,
  CASE {k} % 5 WHEN 0 THEN 'Indonesia' WHEN 1 THEN 'Republic of Indonesia' WHEN 2 THEN 'Indonesian'
               WHEN 3 THEN 'Viet Nam' ELSE NULL END AS c2,
  CASE {k} % 5 WHEN 0 THEN 'IDN' WHEN 3 THEN 'VNM' WHEN 4 THEN 'IDN' ELSE NULL END AS c3,
  sector AS c4,
  province AS c5,
  CASE WHEN copy = 2 THEN 'Suspended' ELSE status END AS c6,
  CASE WHEN {k} % 37 = 0 THEN 'not a date'
       WHEN {k} % 8 = 0 THEN {iso_date}
       WHEN {k} % 8 = 1 THEN {_mdy('approval_date')}
       WHEN {k} % 8 = 2 THEN {_serial('approval_date', dialect)}
       WHEN {k} % 8 = 3 THEN ({iso_date} || 'T00:00:00')
       WHEN {k} % 8 = 4 THEN replace({iso_date}, '-', '/')
       WHEN {k} % 8 = 5 THEN ({_mdy('approval_date')} || ' 12:00:00 AM')
       ELSE ({iso_date} || ' 00:00:00') END AS c7,
  CASE WHEN {k} % 2 = 0 THEN CAST(construction_start_date AS STRING) END AS c8,
  CASE WHEN {k} % 2 = 0 THEN CAST(construction_start_date + 30 AS STRING)
       ELSE {_mdy('construction_start_date')} END AS c9,
  {_mdy('operation_date')} AS c10,
  CASE WHEN operation_date IS NULL AND {k} % 3 = 1 THEN CAST(approval_date + 365 AS STRING) END AS c11,
  CASE {k} % 6 WHEN 0 THEN ('$' || {_thousands('committed_usd', dialect)})
               WHEN 1 THEN {_int('committed_usd')}
               WHEN 2 THEN NULL
               WHEN 3 THEN '1d'
               WHEN 4 THEN 'NaN'
               ELSE ('  ' || {_int('committed_usd')} || ' ') END AS c12,
  CASE WHEN {k} % 6 = 4 THEN ('(' || {_int('committed_usd')} || ')') ELSE {_int('committed_usd')} END AS c13,
  CASE WHEN {k} % 10 = 7 THEN {_thousands('disbursed_usd', dialect)} ELSE {_int('disbursed_usd')} END AS c14,
  CASE WHEN {k} % 43 = 0 THEN '2019.5'
       WHEN {k} % 8 = 3 THEN (CAST(year AS STRING) || '.0')
       ELSE CAST(year AS STRING) END AS c15,
  'x' AS c16,
  lower(status) AS c17,
  {k} * 2 + copy - 1 AS row_ord
FROM (SELECT *, 1 AS copy FROM {_src(dialect)} WHERE finance_type = 'DF'
      UNION ALL
      SELECT *, 2 AS copy FROM {_src(dialect)} WHERE finance_type = 'DF' AND CAST(project_id AS BIGINT) % 53 = 0) t"""


TRACKER_HEADER = ["Transaction Party", "Investor/Contractor", "Sector", "Region", "Quantity in Millions", "Year",
                  "Country", "row_ord"]


def raw_tracker_sql(dialect: str) -> str:
    k = "CAST(project_id AS BIGINT)"
    return f"""
SELECT CASE WHEN {k} % 4 = 0 THEN '' ELSE project_name END AS c0,
       ('Investor ' || CAST({k} % 89 AS STRING)) AS c1,
       sector AS c2, province AS c3,
       {_millions('committed_usd')} AS c4,
       CAST(year AS STRING) AS c5,
       CASE {k} % 8 WHEN 0 THEN 'Indonesia' WHEN 2 THEN 'indonesia ' WHEN 4 THEN 'Republic of Indonesia'
                    ELSE 'Malaysia' END AS c6,
       {k} AS row_ord
FROM {_src(dialect)} WHERE finance_type = 'FDI' AND CAST(project_id AS BIGINT) % 2 = 0"""


COUNTRY_HEADER = ["Investor or Builder", "Sector", "Country", "Province", "Status", "Amount_musd", "Amount", "Year",
                  "Finance Class", "row_ord"]


def raw_country_sql(dialect: str) -> str:
    k = "CAST(project_id AS BIGINT)"
    return f"""
SELECT project_name AS c0, sector AS c1,
       CASE {k} % 5 WHEN 0 THEN 'Indonesia' WHEN 1 THEN 'INDONESIA' WHEN 2 THEN 'Malaysia'
                    WHEN 3 THEN 'Indonesia ' ELSE 'IDN' END AS c2,
       province AS c3, status AS c4,
       CASE WHEN {k} % 4 = 1 THEN {_millions('committed_usd')} END AS c5,
       CASE WHEN {k} % 3 = 0 THEN ('$' || {_thousands('committed_usd', dialect)}) ELSE {_int('committed_usd')} END AS c6,
       CAST(year AS STRING) AS c7,
       CASE {k} % 7 WHEN 0 THEN 'Grant' WHEN 1 THEN '' ELSE ' FDI ' END AS c8,
       {k} AS row_ord
FROM {_src(dialect)} WHERE finance_type = 'FDI' AND CAST(project_id AS BIGINT) % 2 = 1
UNION ALL
SELECT '', ' ', NULL, '', NULL, '', NULL, '  ', '', -{k}
FROM {_src(dialect)} WHERE finance_type = 'FDI' AND CAST(project_id AS BIGINT) % 59 = 0"""


ENRICH_HEADER = ["AidData Record ID", "Title", "Recipient", "Sector Name", "Status", "Implementation Start Date",
                 "Financial Close Date", "Latitude", "Longitude", "Commitment Year", "row_ord"]


def raw_enrichment_sql(dialect: str) -> str:
    k = "CAST(project_id AS BIGINT)"
    return f"""
SELECT CASE WHEN {k} % 4 = 2 THEN '' ELSE project_id END AS c0,
       project_name AS c1,
       CASE {k} % 5 WHEN 0 THEN 'Indonesia' WHEN 1 THEN 'indonesia' WHEN 2 THEN NULL WHEN 3 THEN 'Viet Nam'
                    ELSE 'IDN' END AS c2,
       sector AS c3, status AS c4,
       CAST(construction_start_date AS STRING) AS c5,
       CASE WHEN financial_close_date IS NOT NULL THEN {_mdy('financial_close_date')}
            ELSE CAST(approval_date + 90 AS STRING) END AS c6,
       CASE WHEN {k} % 47 = 0 THEN '500' ELSE CAST(latitude + (copy - 1) AS STRING) END AS c7,
       CAST(longitude AS STRING) AS c8,
       CAST(year AS STRING) AS c9,
       {k} * 2 + copy - 1 AS row_ord
FROM (SELECT *, 1 AS copy FROM {_src(dialect)} WHERE finance_type = 'DF'
      UNION ALL
      SELECT *, 2 AS copy FROM {_src(dialect)}
      WHERE finance_type = 'DF' AND CAST(project_id AS BIGINT) % 8 = 0) t"""


WIDE_HEADER_PREFIX = ["﻿Country", "Indicator", "Unit"]


def raw_wide_sql(dialect: str) -> str:
    return f"""
SELECT coalesce(province, '') AS c0, 'Projects' AS c1, 'count' AS c2,
       CAST(count(*) FILTER (WHERE year < 1998) AS STRING) AS c3,
       CAST(count(*) FILTER (WHERE year >= 1998) AS STRING) AS c4
FROM {_src(dialect)} GROUP BY province"""


WIDE_HEADER = WIDE_HEADER_PREFIX + ["before 1998", "1998 on"]

_BUILDERS = {
    "raw_df_source": (raw_df_sql, DF_HEADER),
    "raw_tracker_source": (raw_tracker_sql, TRACKER_HEADER),
    "raw_country_source": (raw_country_sql, COUNTRY_HEADER),
    "enrichment_source": (raw_enrichment_sql, ENRICH_HEADER),
    "wide_yearly_source": (raw_wide_sql, WIDE_HEADER),
}


def raw_source(spark: SparkSession, sf_dir: str, name: str, base: DataFrame | None = None) -> DataFrame:
    """One raw-shaped source as Spark sees a freshly read file (headers as
    in the file, including blanks and repeats)."""
    builder, header = _BUILDERS[name]
    if base is not None:
        return spark.sql(builder(SPARK), projects=base).toDF(*header)

    def build() -> DataFrame:
        # stored like a raw file on shared storage: text cells under positional
        # names; the header (blanks, repeats and all) is applied on read
        text = spark.sql(builder(SPARK), projects=projects(spark, sf_dir))
        return materialize(spark, text, name).toDF(*header)

    return memo_plan(spark, ("raw", sf_dir, name), build)


def raw_source_sql(name: str) -> str:
    """The same source as DuckDB SQL over a ``projects`` relation."""
    builder, _ = _BUILDERS[name]
    return builder(DUCKDB)
