"""Data-quality and lineage reports.

Each report is one aggregate pass (all columns at once), never a job per
column.  Results are long-format rows produced with ``stack``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlens.functions.numeric import exact_pct
from finlens.functions.text import blank_to_null
from finlens.schema import CANONICAL_FIELDS, STRING_FIELDS

# --- fixed values: key fields of the coverage report
COVERAGE_FIELDS = [
    "project_id",
    "project_name",
    "year",
    "sector",
    "committed_usd",
    "province",
    "latitude",
    "longitude",
    "approval_date",
    "disbursed_usd",
    "status",
]


def field_coverage(projects: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Per key field, non-null count / pct and missing count / pct
    (pcts to 1 decimal).  Text fields must be non-blank.  Missing fields
    count as 0 non-null."""
    keys = fields or COVERAGE_FIELDS
    aggs: list[Column] = [F.count(F.lit(1)).alias("_total")]
    for f in keys:
        if f not in projects.columns:
            aggs.append(F.lit(0).cast("bigint").alias(f"n_{f}"))
        elif f in STRING_FIELDS:
            aggs.append(F.count(blank_to_null(f)).alias(f"n_{f}"))
        else:
            aggs.append(F.count(F.col(f)).alias(f"n_{f}"))
    counts = projects.agg(*aggs)
    long = counts.select("_total", *[f"n_{f}" for f in keys]).selectExpr(
        "_total", "stack({}, {}) AS (field, non_null_count)".format(
            len(keys), ", ".join(f"'{f}', n_{f}" for f in keys))
    )
    return long.withColumn("missing_count", F.col("_total") - F.col("non_null_count")).select(
        "field",
        F.coalesce(exact_pct("non_null_count", "_total", 1), F.lit(0.0)).alias("non_null_pct"),
        F.coalesce(exact_pct("missing_count", "_total", 1), F.lit(100.0)).alias("missing_pct"),
        F.col("non_null_count").cast("bigint").alias("non_null_count"),
        F.col("missing_count").cast("bigint").alias("missing_count"),
    ).orderBy(F.col("missing_pct").desc(), F.col("field"))


def missing_pct(projects: DataFrame, columns: list[str] | None = None, by: str | None = None) -> DataFrame:
    """E26 (and E28's null rates): percent null per column, 2 decimals;
    100 for an empty input.  ``by`` groups (e.g. by source)."""
    cols = columns or [c for c in CANONICAL_FIELDS if c in projects.columns]
    aggs = [F.count(F.lit(1)).alias("_total")] + [F.count(F.col(c)).alias(f"n_{c}") for c in cols]
    grouped = projects.groupBy(by).agg(*aggs) if by else projects.agg(*aggs)
    keep = [by] if by else []
    long = grouped.selectExpr(
        *keep, "_total",
        "stack({}, {}) AS (column_name, non_null)".format(len(cols), ", ".join(f"'{c}', n_{c}" for c in cols)),
    )
    return long.withColumn("_missing", F.col("_total") - F.col("non_null")).select(
        *keep,
        "column_name",
        F.coalesce(exact_pct("_missing", "_total", 2), F.lit(100.0)).alias("missing_pct"),
    )


def source_missingness(conformed: DataFrame, by: str = "source_name") -> DataFrame:
    """Per source, % rows without province and % rows missing latitude
    or longitude (2 decimals)."""
    counts = conformed.groupBy(by).agg(
        F.count_if(F.col("province").isNull()).alias("_no_province"),
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("_no_coords"),
        F.count(F.lit(1)).alias("rows_loaded"),
    )
    return counts.select(
        by,
        exact_pct("_no_province", "rows_loaded", 2).alias("province_missing_pct"),
        exact_pct("_no_coords", "rows_loaded", 2).alias("coordinate_missing_pct"),
        "rows_loaded",
    )


WARNING_SCHEMA = "source_name string, warning_type string, message string"
# our own wording; the types are what programs test
WARNING_MESSAGES = {
    "no_raw_files": "The raw folder holds no source files; the project table is empty.",
    "unregistered_source": "No source mapping goes by this name; its rows were not read.",
    "missing_primary_source": "A primary source was not found; its projects are absent.",
    "missing_country_filter_columns": "The source names no country; none of its rows can pass the country filter.",
    "invalid_finance_type": "Finance types other than DF and FDI were blanked.",
    "missing_finance_type": "Rows without a finance type were left out of the table.",
    "fractional_year": "years with a fraction were blanked.",
    "unparsed_date": "rows hold a date in no known layout; it was blanked.",
    "coordinate_out_of_range": "rows hold a coordinate out of range; it was blanked.",
    "generated_id_collision": "rows share a generated id with an earlier row and were dropped as repeats.",
    "status_without_risk_weight": "rows have a status without a risk weight; they count as no risk.",
}
PROFILE_RULES = {
    "fractional_year": "fractional_years",
    "unparsed_date": "unparsed_dates",
    "coordinate_out_of_range": "bad_coordinates",
}


def message(rule: str) -> Column:
    """The message of the rule named in column ``rule``."""
    text = F.create_map(*[F.lit(x) for kv in WARNING_MESSAGES.items() for x in kv])
    return text[F.col(rule)].alias("message")


def counted_message(rule: str, n: str) -> Column:
    """'<n> <message>'."""
    return F.concat_ws(" ", F.col(n).cast("string"), message(rule)).alias("message")
