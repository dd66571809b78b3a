"""Dimension inputs for the geography reports, derived from the driver's
``nation`` / ``region`` tables and the ``projects`` fixture.

The reference ships these as hand-typed tables (a province report, alias
names, fallback coordinates, regional CAPEX); here they are inputs built by
simple rules over the driver data, so the reports have something of the
right shape at every scale.  They compute none of the report logic.  Each is
one SQL text with a dialect shim, run by Spark (``spark.sql(text, ...)``)
and by the DuckDB oracle alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finlens.sources.fixtures import materialize, memo_plan, projects
from finlens.sources.tables import read_table

SPARK, DUCKDB = "spark", "duckdb"


def _t(name: str, dialect: str) -> str:
    return "{" + name + "}" if dialect == SPARK else name


def _sorted_join(col: str, dialect: str) -> str:
    if dialect == SPARK:
        return f"array_join(array_sort(collect_list({col})), ', ')"
    return f"array_to_string(list_sort(list({col})), ', ')"


def _report_name(dialect: str) -> str:
    return "CASE WHEN n.n_nationkey % 4 = 1 THEN 'Province ' || CAST(n.n_nationkey AS STRING) ELSE n.n_name END"


def province_report_sql(dialect: str) -> str:
    return f"""
SELECT r.r_name AS region, {_report_name(dialect)} AS province_name,
       coalesce(s.v, 0.0) / CAST(1000000000 AS DOUBLE) AS project_value_b,
       CAST(coalesce(s.n, 0) AS BIGINT) AS project_count,
       CASE WHEN n.n_nationkey % 5 = 0 THEN NULL
            ELSE coalesce(s.v, 0.0) / CAST(1000000 * (n.n_nationkey + 1) AS DOUBLE) END AS per_capita_usd
FROM {_t('nation', dialect)} n JOIN {_t('region', dialect)} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT province, sum(committed_usd) AS v, count(*) AS n FROM {_t('projects', dialect)}
           WHERE finance_type = 'DF' GROUP BY province) s ON s.province = n.n_name"""


def aliases_sql(dialect: str) -> str:
    return f"""
SELECT lower('Province ' || CAST(n_nationkey AS STRING)) AS name_key, lower(n_name) AS alias_key
FROM {_t('nation', dialect)} WHERE n_nationkey % 8 = 1"""


def province_fallback_sql(dialect: str) -> str:
    return f"""
SELECT {_report_name(dialect)} AS province_name, -8.0 + n.n_nationkey * 0.5 AS lat,
       CAST(100 + n.n_nationkey AS DOUBLE) AS lon
FROM {_t('nation', dialect)} n WHERE n.n_nationkey % 3 = 0"""


def region_fallback_sql(dialect: str) -> str:
    return f"""
SELECT r_name AS region, CAST(r_regionkey - 5 AS DOUBLE) AS lat, CAST(105 + 5 * r_regionkey AS DOUBLE) AS lon
FROM {_t('region', dialect)}"""


def region_coords_sql(dialect: str) -> str:
    return f"""
SELECT r_name AS region, CAST(2 * r_regionkey - 6 AS DOUBLE) AS lat, CAST(110 + 3 * r_regionkey AS DOUBLE) AS lon
FROM {_t('region', dialect)} WHERE r_regionkey < 4"""


def region_capex_sql(dialect: str) -> str:
    return f"""
SELECT r.r_name AS region, {_sorted_join('n.n_name', dialect)} AS included_provinces,
       sum(pv.fdi) / CAST(1000000000 AS DOUBLE) AS china_capex_b,
       sum(pv.allc) / CAST(1000000000 AS DOUBLE) AS all_source_capex_b
FROM {_t('nation', dialect)} n JOIN {_t('region', dialect)} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT province, sum(CASE WHEN finance_type = 'FDI' THEN committed_usd END) AS fdi,
                  sum(committed_usd) AS allc
           FROM {_t('projects', dialect)} GROUP BY province) pv ON pv.province = n.n_name
GROUP BY r.r_name
UNION ALL
SELECT 'Not Specified', CAST(NULL AS STRING), sum(CASE WHEN finance_type = 'FDI' THEN committed_usd END)
       / CAST(1000000000 AS DOUBLE), sum(committed_usd) / CAST(1000000000 AS DOUBLE)
FROM {_t('projects', dialect)} WHERE province IS NULL"""


_DIMS = {
    "province_report": province_report_sql,
    "aliases": aliases_sql,
    "province_fallback": province_fallback_sql,
    "region_fallback": region_fallback_sql,
    "region_coords": region_coords_sql,
    "region_capex": region_capex_sql,
}


def dimension(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One dimension input: derived once per session, then a Parquet scan."""
    def build() -> DataFrame:
        text = _DIMS[name](SPARK)
        kwargs = {}
        if "{nation}" in text:
            kwargs["nation"] = read_table(spark, sf_dir, "nation")
        if "{region}" in text:
            kwargs["region"] = read_table(spark, sf_dir, "region")
        if "{projects}" in text:
            kwargs["projects"] = projects(spark, sf_dir)
        # an input like the others: derived once, written to shared storage
        return materialize(spark, spark.sql(text, **kwargs), f"dim_{name}")

    return memo_plan(spark, ("dim", sf_dir, name), build)


def dimension_sql(name: str) -> str:
    return _DIMS[name](DUCKDB)
