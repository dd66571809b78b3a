"""Driver queries over facet filters and option lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finlens.operators import cube as C
from finlens.operators import facets as FC
from finlens.operators import reports as R
from finlens.plans.metric_queries import RISK_W_SQL, RISK_X_SQL
from finlens.plans.registry import register
from finlens.sources.fixtures import materialize, memo_plan, projects, with_projects

# A dashboard selection: every finance type (so the facet is skipped and
# null types survive), two statuses, a year window.  The strict variant
# applies the same lists as plain IN predicates.
DASHBOARD_SELECTION = {
    "finance_type": ["DF", "FDI"],
    "status": ["Completion", "Delayed"],
    "year": [1996, 1997, 1998, 1999],
}
NARROWING_SELECTION = {
    "finance_type": ["fdi"],
    "sector": ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"],
    "province": ["NATION_1", "NATION_2"],
    "status": ["Cancelled", "Completion", "Delayed", "Implementation", "Pipeline: Commitment", "Pipeline: Pledge",
               "Stalled", "Suspended"],
}



def facet_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facet cube of ``projects``, written once per session as a
    deployment keeps it."""
    return memo_plan(spark, ("cube", sf_dir), lambda: materialize(
        spark, C.build_cells(projects(spark, sf_dir)), "facet-cube", "year"))


KPI_SELECT = f"""
SELECT count(*) AS projects,
       count(*) FILTER (WHERE upper(finance_type) = 'DF') AS df_projects,
       count(*) FILTER (WHERE upper(finance_type) = 'FDI') AS fdi_projects,
       sum(committed_usd) AS committed_usd, sum(disbursed_usd) AS disbursed_usd,
       round(sum(disbursed_usd) / nullif(sum(committed_usd), 0), 6) AS portfolio_realization_rate,
       round(avg(disbursed_usd / nullif(committed_usd, 0)), 6) AS avg_project_realization_rate,
       CAST(median(date_diff('day', approval_date, operation_date)) AS DOUBLE) AS median_implementation_days,
       round(100.0 * sum({RISK_W_SQL} * {RISK_X_SQL}) / nullif(sum({RISK_X_SQL}), 0), 6) AS status_risk_index"""


@register("facet_filtered_kpis", ["C4", "C3", "E21"], with_projects("""
WITH f AS (SELECT * FROM projects
           WHERE status IN ('Completion', 'Delayed') AND CAST(year AS INTEGER) IN (1996, 1997, 1998, 1999))
""" + KPI_SELECT + " FROM f"))
def facet_filtered_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio KPIs after the dashboard facet filter (all finance types
    selected, so that facet is skipped), from the facet cube."""
    cells = facet_cube(spark, sf_dir)
    options = FC.option_lists(cells, list(DASHBOARD_SELECTION))
    return C.cell_kpis(FC.apply_facets(cells, DASHBOARD_SELECTION, options))


@register("facet_cube", ["E21", "C3", "C4"], with_projects(f"""
SELECT year, finance_type, sector, province, status, {KPI_SELECT.strip().removeprefix('SELECT')}
FROM projects GROUP BY ALL"""))
def facet_cube_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs of every facet combination, from cells built anew."""
    cells = C.build_cells(projects(spark, sf_dir))
    return C.each_cell_kpis(cells)


@register("facet_filtered_kpis_strict", ["C3", "E21"], with_projects("""
WITH f AS (SELECT * FROM projects WHERE finance_type IN ('DF', 'FDI')
           AND status IN ('Completion', 'Delayed') AND year IN (1996, 1997, 1998, 1999))
""" + KPI_SELECT + " FROM f"))
def facet_filtered_kpis_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio KPIs after the strict facet filter (every list applies)."""
    return R.portfolio_kpis(FC.apply_facets_strict(projects(spark, sf_dir), DASHBOARD_SELECTION))


@register("facet_values", ["E47", "H3"], with_projects("""
WITH v AS (
  SELECT DISTINCT 'year' AS facet, CAST(CAST(year AS INTEGER) AS VARCHAR) AS value, lpad(CAST(CAST(year AS INTEGER) AS VARCHAR), 12, '0') AS k FROM projects WHERE year IS NOT NULL
  UNION SELECT DISTINCT 'finance_type', nullif(trim(upper(finance_type)), ''),
        CASE nullif(trim(upper(finance_type)), '') WHEN 'DF' THEN '0' WHEN 'FDI' THEN '1' ELSE '2' || nullif(trim(upper(finance_type)), '') END FROM projects
  UNION SELECT DISTINCT 'sector', nullif(trim(sector), ''), nullif(trim(sector), '') FROM projects
  UNION SELECT DISTINCT 'province', nullif(trim(province), ''), nullif(trim(province), '') FROM projects
  UNION SELECT DISTINCT 'status', nullif(trim(status), ''), nullif(trim(status), '') FROM projects)
SELECT facet, CAST(row_number() OVER (PARTITION BY facet ORDER BY k) AS INTEGER) AS position, value
FROM v WHERE value IS NOT NULL"""))
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted option list of every facet."""
    return FC.facet_values(projects(spark, sf_dir))


@register("facet_narrowing", ["E52", "C4"], with_projects("""
WITH o AS (SELECT count(*) FILTER (WHERE finance_type IS NOT NULL AND upper(finance_type) NOT IN ('FDI')) AS ft_out,
                  count(DISTINCT CASE WHEN upper(finance_type) IN ('FDI') THEN upper(finance_type) END) AS ft_in,
                  count(DISTINCT nullif(trim(upper(finance_type)), '')) AS ft_opts,
                  count(*) FILTER (WHERE sector IS NOT NULL AND sector NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')) AS se_out,
                  count(DISTINCT CASE WHEN sector IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') THEN sector END) AS se_in,
                  count(DISTINCT nullif(trim(sector), '')) AS se_opts,
                  count(*) FILTER (WHERE province IS NOT NULL AND province NOT IN ('NATION_1', 'NATION_2')) AS pr_out,
                  count(DISTINCT CASE WHEN province IN ('NATION_1', 'NATION_2') THEN province END) AS pr_in,
                  count(DISTINCT nullif(trim(province), '')) AS pr_opts,
                  count(*) FILTER (WHERE status IS NOT NULL AND status NOT IN ('Cancelled', 'Completion', 'Delayed', 'Implementation', 'Pipeline: Commitment', 'Pipeline: Pledge', 'Stalled', 'Suspended')) AS st_out,
                  count(DISTINCT CASE WHEN status IN ('Cancelled', 'Completion', 'Delayed', 'Implementation', 'Pipeline: Commitment', 'Pipeline: Pledge', 'Stalled', 'Suspended') THEN status END) AS st_in,
                  count(DISTINCT nullif(trim(status), '')) AS st_opts,
                  count(*) FILTER (WHERE upper(finance_type) IN ('FDI')) AS ft_hit,
                  count(*) FILTER (WHERE sector IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')) AS se_hit,
                  count(*) FILTER (WHERE province IN ('NATION_1', 'NATION_2')) AS pr_hit,
                  count(*) FILTER (WHERE status IN ('Cancelled', 'Completion', 'Delayed', 'Implementation', 'Pipeline: Commitment', 'Pipeline: Pledge', 'Stalled', 'Suspended')) AS st_hit
           FROM projects),
a AS (SELECT *, ft_out = 0 AND ft_in = 1 AS ft_all, se_out = 0 AND se_in = 5 AS se_all,
             pr_out = 0 AND pr_in = 2 AS pr_all, st_out = 0 AND st_in = 8 AS st_all FROM o),
k AS (SELECT count(*) AS rows_after_filter FROM projects, a
      WHERE (ft_all OR coalesce(upper(finance_type) IN ('FDI'), false))
        AND (se_all OR coalesce(sector IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'), false))
        AND (pr_all OR coalesce(province IN ('NATION_1', 'NATION_2'), false))
        AND (st_all OR coalesce(status IN ('Cancelled', 'Completion', 'Delayed', 'Implementation', 'Pipeline: Commitment', 'Pipeline: Pledge', 'Stalled', 'Suspended'), false)))
SELECT 'finance_type' AS facet, 'Finance Type' AS label, 'FDI' AS selected, ft_opts > 0 AND NOT ft_all AS narrowing,
       ft_hit AS rows_matching, rows_after_filter FROM a, k
UNION ALL SELECT 'sector', 'Sector', 'AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY', se_opts > 0 AND NOT se_all, se_hit, rows_after_filter FROM a, k
UNION ALL SELECT 'province', 'Province', 'NATION_1, NATION_2', pr_opts > 0 AND NOT pr_all, pr_hit, rows_after_filter FROM a, k
UNION ALL SELECT 'status', 'Status', 'Cancelled, Completion, Delayed, Implementation, Pipeline: Commitment, Pipeline: Pledge, Stalled, Suspended', st_opts > 0 AND NOT st_all, st_hit, rows_after_filter FROM a, k"""))
def facet_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which facets of a selection narrow the result, with per-facet hits, from
    the facet cube."""
    return FC.facet_narrowing(facet_cube(spark, sf_dir), NARROWING_SELECTION, "projects")
