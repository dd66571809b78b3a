"""Driver queries over the metric operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finlens.operators import metrics as M
from finlens.plans.registry import register
from finlens.sources.fixtures import projects, with_projects

# risk weight CASE shared by the oracle queries (fixed default weights)
RISK_W_SQL = (
    "CASE lower(status) WHEN 'cancelled' THEN 1.0 WHEN 'stalled' THEN 0.8 "
    "WHEN 'delayed' THEN 0.5 ELSE 0.0 END"
)
RISK_X_SQL = "CASE WHEN committed_usd > 0 THEN committed_usd ELSE 1.0 END"
ACTIVE_SQL = "NOT coalesce(lower(status) IN ('cancelled', 'stalled'), false)"


@register("realization_by_project", ["B17"], with_projects("""
SELECT project_id, round(disbursed_usd / nullif(committed_usd, 0), 6) AS realization_rate
FROM projects"""))
def realization_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-project realization rate."""
    return M.realization_by_project(projects(spark, sf_dir))


@register("implementation_days", ["B18", "E8"], with_projects("""
SELECT project_id, CAST(date_diff('day', approval_date, operation_date) AS INTEGER) AS time_to_implementation_days
FROM projects
WHERE approval_date IS NOT NULL AND operation_date IS NOT NULL"""))
def implementation_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implementation days per project with nulls dropped."""
    return M.delay_distribution(projects(spark, sf_dir))


@register("overall_realization", ["E1"], with_projects("""
SELECT sum(committed_usd) AS committed_total, sum(disbursed_usd) AS disbursed_total,
       round(sum(disbursed_usd) / nullif(sum(committed_usd), 0), 6) AS overall_realization_rate
FROM projects"""))
def overall_realization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio realization from totals."""
    return M.overall_realization(projects(spark, sf_dir))


@register("province_year_exposure", ["E2", "C7", "G1"], with_projects(f"""
SELECT province, year, sum(exposure) AS province_year_exposure FROM (
  SELECT province, CAST(coalesce(year, year(approval_date)) AS INTEGER) AS year,
         CASE WHEN {ACTIVE_SQL} THEN coalesce(disbursed_usd, 0.0) ELSE 0.0 END AS exposure
  FROM projects) t
WHERE province IS NOT NULL AND year IS NOT NULL
GROUP BY province, year"""))
def province_year_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active disbursed exposure per province and year."""
    return M.province_year_exposure(projects(spark, sf_dir))


@register("sector_concentration", ["E3", "D10", "C7", "G2"], with_projects("""
WITH g AS (SELECT sector, sum(committed_usd) AS value FROM projects WHERE sector IS NOT NULL GROUP BY sector),
     t AS (SELECT sum(value) AS total FROM g)
SELECT sector, value, round(value / nullif(total, 0), 6) AS share FROM g CROSS JOIN t"""))
def sector_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed value and share per sector."""
    return M.sector_concentration(projects(spark, sf_dir))


@register("risk_index_global", ["E4", "D6"], with_projects(f"""
SELECT round(100.0 * sum({RISK_W_SQL} * {RISK_X_SQL}) / nullif(sum({RISK_X_SQL}), 0), 6) AS status_risk_index
FROM projects"""))
def risk_index_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio status risk index."""
    return M.risk_index_global(projects(spark, sf_dir))


@register("risk_index_by_province", ["E5", "D6", "C7"], with_projects(f"""
SELECT province,
       round(CASE WHEN sum({RISK_X_SQL}) > 0 THEN 100.0 * sum({RISK_W_SQL} * {RISK_X_SQL}) / sum({RISK_X_SQL}) END, 6)
         AS status_risk_index
FROM projects WHERE province IS NOT NULL GROUP BY province"""))
def risk_index_by_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status risk index per province."""
    return M.risk_index_by(projects(spark, sf_dir), "province")


@register("lifecycle_funnel", ["E6"], with_projects("""
SELECT * FROM (
  SELECT 1 AS stage_order, 'Approved' AS stage, count(approval_date) AS projects FROM projects
  UNION ALL SELECT 2, 'Financial Close', count(financial_close_date) FROM projects
  UNION ALL SELECT 3, 'Construction Start', count(construction_start_date) FROM projects
  UNION ALL SELECT 4, 'Operation', count(operation_date) FROM projects)"""))
def lifecycle_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects reaching each lifecycle stage."""
    return M.lifecycle_funnel(projects(spark, sf_dir))


@register("approval_cohorts", ["E7", "G1"], with_projects("""
SELECT CAST(year(approval_date) AS INTEGER) AS approval_year,
       count(*) AS projects,
       coalesce(sum(committed_usd), 0.0) AS committed_usd,
       coalesce(sum(disbursed_usd), 0.0) AS disbursed_usd,
       round(avg(disbursed_usd / nullif(committed_usd, 0)), 6) AS avg_realization_rate,
       CAST(median(date_diff('day', approval_date, operation_date)) AS DOUBLE) AS median_time_to_implementation_days
FROM projects WHERE approval_date IS NOT NULL
GROUP BY 1"""))
def approval_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval-year cohorts."""
    return M.approval_cohorts(projects(spark, sf_dir))


@register("status_mix", ["E9"], with_projects("""
SELECT status, count(*) AS projects FROM projects WHERE status IS NOT NULL GROUP BY status"""))
def status_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per status."""
    return M.status_mix(projects(spark, sf_dir))


EXPOSURE_FRICTION_SQL = f"""
WITH p AS (
  SELECT province,
         coalesce(year, year(approval_date)) IS NOT NULL AS year_ok,
         CASE WHEN {ACTIVE_SQL} THEN coalesce(disbursed_usd, 0.0) ELSE 0.0 END AS exposure,
         disbursed_usd / nullif(committed_usd, 0) AS rr,
         {RISK_W_SQL} * {RISK_X_SQL} AS rc, {RISK_X_SQL} AS rx
  FROM projects WHERE province IS NOT NULL),
e AS (SELECT province, sum(exposure) AS total_exposure FROM p WHERE year_ok GROUP BY province),
r AS (SELECT province, avg(rr) AS avg_rr,
             CASE WHEN sum(rx) > 0 THEN 100.0 * sum(rc) / sum(rx) END AS risk
      FROM p GROUP BY province),
m AS (SELECT median(total_exposure) AS med FROM e)
SELECT e.province, e.total_exposure, round(r.avg_rr, 6) AS avg_realization_rate,
       round(r.risk, 6) AS status_risk_index,
       CASE WHEN e.total_exposure >= m.med THEN 'High Exposure' ELSE 'Low Exposure' END AS exposure_band
FROM e LEFT JOIN r ON e.province = r.province CROSS JOIN m"""


@register("exposure_vs_friction", ["E10", "D1", "E2", "E5", "B17", "G3"], with_projects(EXPOSURE_FRICTION_SQL))
def exposure_vs_friction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which provinces combine high exposure with delivery friction."""
    return M.exposure_vs_friction(projects(spark, sf_dir))
