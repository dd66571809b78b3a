"""Driver queries over the dashboard report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finlens.operators import metrics as M
from finlens.operators import reports as R
from finlens.plans.metric_queries import ACTIVE_SQL, EXPOSURE_FRICTION_SQL, RISK_W_SQL, RISK_X_SQL
from finlens.plans.registry import register
from finlens.sources.fixtures import (
    COORDINATE_POOR_SQL,
    YEARLESS_SQL,
    coordinate_poor,
    projects,
    with_projects,
    yearless,
)

# the trends / sector pages are locked to development finance, the
# investment pages to foreign direct investment
TRENDS_TYPE = "DF"
INVESTMENT_TYPE = "FDI"

BAND_SQL = f"""
WITH p AS (
  SELECT province,
         coalesce(year, year(approval_date)) IS NOT NULL AS year_ok,
         CASE WHEN {ACTIVE_SQL} THEN coalesce(disbursed_usd, 0.0) ELSE 0.0 END AS exposure,
         disbursed_usd / nullif(committed_usd, 0) AS rr,
         {RISK_W_SQL} * {RISK_X_SQL} AS rc, {RISK_X_SQL} AS rx
  FROM projects WHERE province IS NOT NULL),
g AS (SELECT province, sum(CASE WHEN year_ok THEN exposure END) AS total_exposure,
             count(*) FILTER (WHERE year_ok) AS n_year, avg(rr) AS avg_rr,
             CASE WHEN sum(rx) > 0 THEN 100.0 * sum(rc) / sum(rx) END AS risk
      FROM p GROUP BY province HAVING count(*) FILTER (WHERE year_ok) > 0),
m AS (SELECT median(total_exposure) AS med FROM g),
b AS (SELECT CASE WHEN total_exposure >= med THEN 'High Exposure' ELSE 'Low Exposure' END AS exposure_band,
             province, total_exposure, avg_rr, risk FROM g CROSS JOIN m),
s AS (SELECT exposure_band, count(province) AS provinces, avg(total_exposure) AS avg_exposure,
             round(avg(risk), 6) AS avg_risk_index, round(avg(avg_rr), 6) AS avg_realization_rate
      FROM b GROUP BY exposure_band)
SELECT exposure_band, provinces, avg_exposure, 'avg_risk_index' AS metric, avg_risk_index AS value FROM s
UNION ALL
SELECT exposure_band, provinces, avg_exposure, 'avg_realization_rate', avg_realization_rate FROM s"""


@register("exposure_band_summary", ["E11", "R2"], with_projects(BAND_SQL))
def exposure_band_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High vs low exposure band comparison, long format."""
    return R.exposure_band_summary(projects(spark, sf_dir))


@register("province_table_top10", ["E12", "G7"], with_projects("""
SELECT province, count(*) AS projects, coalesce(sum(committed_usd), 0.0) AS committed_usd,
       coalesce(sum(disbursed_usd), 0.0) AS disbursed_usd
FROM projects WHERE province IS NOT NULL GROUP BY province
ORDER BY disbursed_usd DESC, province LIMIT 10"""))
def province_table_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top provinces by disbursed capital."""
    return R.province_table(projects(spark, sf_dir), 10)


TREND_SQL = """
WITH f AS (SELECT count(year) AS n FROM projects),
t AS (SELECT CAST(CASE WHEN f.n > 0 THEN year ELSE year(approval_date) END AS INTEGER) AS year,
             committed_usd, disbursed_usd FROM projects CROSS JOIN f),
y AS (SELECT year, sum(committed_usd) AS committed_usd, sum(disbursed_usd) AS disbursed_usd
      FROM t WHERE year IS NOT NULL GROUP BY year)"""


@register("yearly_trend_long", ["E13", "R1"], with_projects(TREND_SQL + """
SELECT year, 'committed_usd' AS metric, committed_usd AS usd FROM y
UNION ALL SELECT year, 'disbursed_usd', disbursed_usd FROM y"""))
def yearly_trend_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed vs disbursed by year, long format."""
    return R.yearly_trend_long(projects(spark, sf_dir))


@register("yoy_change", ["E48", "W3"], with_projects(TREND_SQL + """,
l AS (SELECT year, committed_usd, lag(year) OVER (ORDER BY year) AS previous_year,
             lag(committed_usd) OVER (ORDER BY year) AS previous_committed_usd
      FROM (SELECT * FROM y ORDER BY year DESC LIMIT 2))
SELECT CAST(previous_year AS INTEGER) AS previous_year, year, previous_committed_usd, committed_usd,
       round(100.0 * (committed_usd - previous_committed_usd) / nullif(previous_committed_usd, 0), 6) AS change_pct
FROM l WHERE previous_year IS NOT NULL"""))
def yoy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed change between the last two trend years."""
    return R.yoy_change(projects(spark, sf_dir))


@register("yearly_sums_by_type", ["E14", "C6"], with_projects(f"""
SELECT year, sum(committed_usd) AS committed_usd, sum(disbursed_usd) AS disbursed_usd
FROM projects WHERE upper(finance_type) = '{TRENDS_TYPE}' AND year IS NOT NULL GROUP BY year"""))
def yearly_sums_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly sums for the development-finance view."""
    return R.yearly_sums(R.lock_finance_type(projects(spark, sf_dir), TRENDS_TYPE))


@register("yearly_counts", ["E15", "E16", "C6"], with_projects(f"""
SELECT year, count(*) AS projects, sum(committed_usd) AS committed_usd
FROM projects WHERE upper(finance_type) = '{INVESTMENT_TYPE}' AND year IS NOT NULL GROUP BY year"""))
def yearly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly counts and committed sums for the investment view."""
    return R.yearly_counts(R.lock_finance_type(projects(spark, sf_dir), INVESTMENT_TYPE))


SECTOR_CLEAN_SQL = "coalesce(nullif(trim(sector), ''), 'Unknown')"


@register("top_sectors_committed", ["E17", "B12", "C6"], with_projects(f"""
SELECT {SECTOR_CLEAN_SQL} AS sector_clean, sum(committed_usd) AS committed_usd
FROM projects WHERE upper(finance_type) = '{TRENDS_TYPE}'
GROUP BY 1 HAVING sum(committed_usd) IS NOT NULL
ORDER BY committed_usd DESC, sector_clean LIMIT 15"""))
def top_sectors_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 15 sectors by committed value."""
    return R.sectors_by_committed(R.lock_finance_type(projects(spark, sf_dir), TRENDS_TYPE), 15)


@register("top_sectors_count", ["E18", "B12", "C6"], with_projects(f"""
SELECT {SECTOR_CLEAN_SQL} AS sector_clean, count(*) AS projects
FROM projects WHERE upper(finance_type) = '{TRENDS_TYPE}'
GROUP BY 1 ORDER BY projects DESC, sector_clean LIMIT 15"""))
def top_sectors_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 15 sectors by project count."""
    return R.sectors_by_count(R.lock_finance_type(projects(spark, sf_dir), TRENDS_TYPE), 15)


@register("top3_sector_share", ["E19", "E17"], with_projects(f"""
WITH t AS (SELECT {SECTOR_CLEAN_SQL} AS sector_clean, sum(committed_usd) AS committed_usd
           FROM projects WHERE upper(finance_type) = '{TRENDS_TYPE}'
           GROUP BY 1 HAVING sum(committed_usd) IS NOT NULL
           ORDER BY committed_usd DESC, sector_clean LIMIT 15),
r AS (SELECT committed_usd, row_number() OVER (ORDER BY committed_usd DESC, sector_clean) AS rn FROM t)
SELECT count(*) AS sectors, sum(CASE WHEN rn <= 3 THEN committed_usd END) AS top3_committed,
       sum(committed_usd) AS pool_committed,
       round(CASE WHEN count(*) >= 3 THEN coalesce(100.0 * sum(CASE WHEN rn <= 3 THEN committed_usd END)
             / nullif(sum(committed_usd), 0), 0.0) END, 6) AS top3_share_pct
FROM r"""))
def top3_sector_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the top three sectors within the top 15."""
    return R.top3_sector_share(R.lock_finance_type(projects(spark, sf_dir), TRENDS_TYPE), 15)


@register("sector_share_with_other", ["E20", "W4", "H4", "E3"], with_projects("""
WITH g AS (SELECT sector, sum(committed_usd) AS v FROM projects WHERE sector IS NOT NULL
           GROUP BY sector HAVING sum(committed_usd) IS NOT NULL),
r AS (SELECT sector, v, row_number() OVER (ORDER BY v DESC, sector) AS rn FROM g),
u AS (SELECT CAST(rn AS INTEGER) AS position, sector, v AS committed_usd FROM r WHERE rn <= 6
      UNION ALL
      SELECT 7, 'Other sectors', sum(v) FROM r WHERE rn > 6 HAVING sum(v) > 0)
SELECT position, sector, committed_usd,
       round(100.0 * committed_usd / nullif(sum(committed_usd) OVER (), 0), 6) AS share_pct FROM u"""))
def sector_share_with_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top six sectors plus an Other bucket, with shares."""
    conc = M.sector_concentration(projects(spark, sf_dir))
    return R.sector_share_with_other(conc, 6, "sector", "value")


@register("portfolio_kpis", ["E21", "E1", "E4", "B17", "B18"], with_projects(f"""
SELECT count(*) AS projects,
       count(*) FILTER (WHERE upper(finance_type) = 'DF') AS df_projects,
       count(*) FILTER (WHERE upper(finance_type) = 'FDI') AS fdi_projects,
       sum(committed_usd) AS committed_usd, sum(disbursed_usd) AS disbursed_usd,
       round(sum(disbursed_usd) / nullif(sum(committed_usd), 0), 6) AS portfolio_realization_rate,
       round(avg(disbursed_usd / nullif(committed_usd, 0)), 6) AS avg_project_realization_rate,
       CAST(median(date_diff('day', approval_date, operation_date)) AS DOUBLE) AS median_implementation_days,
       round(100.0 * sum({RISK_W_SQL} * {RISK_X_SQL}) / nullif(sum({RISK_X_SQL}), 0), 6) AS status_risk_index
FROM projects"""))
def portfolio_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio KPI row."""
    return R.portfolio_kpis(projects(spark, sf_dir))


@register("investment_kpis", ["E22", "C6"], with_projects(f"""
WITH a AS (SELECT *, {SECTOR_CLEAN_SQL} AS sector_clean FROM projects WHERE upper(finance_type) = '{INVESTMENT_TYPE}'),
t AS (SELECT count(*) AS projects, sum(committed_usd) AS committed_usd,
             CAST(median(committed_usd) AS DOUBLE) AS median_committed_usd,
             CAST(min(year) AS INTEGER) AS min_year, CAST(max(year) AS INTEGER) AS max_year FROM a),
s AS (SELECT sector_clean AS top_sector, sum(committed_usd) AS v FROM a GROUP BY 1
      HAVING sum(committed_usd) IS NOT NULL ORDER BY v DESC, top_sector LIMIT 1)
SELECT t.projects, t.committed_usd, t.median_committed_usd, t.min_year, t.max_year, s.top_sector,
       round(CASE WHEN s.top_sector IS NOT NULL THEN coalesce(100.0 * s.v / nullif(t.committed_usd, 0), 0.0) END, 6)
         AS top_sector_share_pct
FROM t LEFT JOIN s ON true"""))
def investment_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investment KPI row for the FDI view (exact median deal)."""
    return R.investment_kpis(R.lock_finance_type(projects(spark, sf_dir), INVESTMENT_TYPE))


@register("status_counts_gated", ["E23", "C13", "C6"], with_projects(f"""
WITH a AS (SELECT * FROM projects WHERE upper(finance_type) = '{INVESTMENT_TYPE}'),
g AS (SELECT round(100.0 * avg(CASE WHEN nullif(trim(status), '') IS NOT NULL THEN 1.0 ELSE 0.0 END), 1) AS pct FROM a)
SELECT coalesce(nullif(trim(status), ''), 'Unknown') AS status, count(*) AS projects
FROM a CROSS JOIN g WHERE g.pct >= 40 GROUP BY 1"""))
def status_counts_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts shown only with enough status coverage."""
    return R.status_counts_gated(R.lock_finance_type(projects(spark, sf_dir), INVESTMENT_TYPE))


def _histogram_sql(values_sql: str) -> str:
    return f"""
WITH v AS ({values_sql}),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
c AS (SELECT CASE WHEN hi - lo > 0 THEN least(CAST(floor((v - lo) * 30 / (hi - lo)) AS INTEGER) + 1, 30)
                  ELSE 1 END AS bin, count(*) AS n
      FROM v CROSS JOIN b GROUP BY 1),
s AS (SELECT CAST(i AS INTEGER) AS bin, lo, hi FROM b, range(1, 31) r(i) WHERE lo IS NOT NULL)
SELECT s.bin, lo + (s.bin - 1) * (hi - lo) / 30 AS bin_start, lo + s.bin * (hi - lo) / 30 AS bin_end,
       CAST(coalesce(c.n, 0) AS BIGINT) AS projects
FROM s LEFT JOIN c ON s.bin = c.bin"""


@register("committed_histogram", ["E24", "C6"], with_projects(_histogram_sql(
    f"SELECT CAST(committed_usd AS DOUBLE) AS v FROM projects "
    f"WHERE upper(finance_type) = '{INVESTMENT_TYPE}' AND committed_usd IS NOT NULL")))
def committed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-bin histogram of committed deal value (FDI view)."""
    a = R.lock_finance_type(projects(spark, sf_dir), INVESTMENT_TYPE)
    return R.histogram(a, "committed_usd")


@register("delay_histogram", ["E24", "E8", "B18"], with_projects(_histogram_sql(
    "SELECT CAST(date_diff('day', approval_date, operation_date) AS DOUBLE) AS v FROM projects "
    "WHERE approval_date IS NOT NULL AND operation_date IS NOT NULL")))
def delay_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-bin histogram of implementation days."""
    return R.histogram(M.delay_distribution(projects(spark, sf_dir)), "time_to_implementation_days")


@register("top_deals_share", ["E34", "G4", "C6"], with_projects(f"""
WITH a AS (SELECT * FROM projects WHERE upper(finance_type) = '{INVESTMENT_TYPE}'),
h AS (SELECT project_id, project_name, year, sector, province, status, committed_usd FROM a
      WHERE committed_usd IS NOT NULL ORDER BY committed_usd DESC, project_id LIMIT 20),
s AS (SELECT round(coalesce(100.0 * (SELECT sum(committed_usd) FROM h)
                   / nullif((SELECT sum(committed_usd) FROM a), 0), 0.0), 6) AS top_share_pct)
SELECT h.*, s.top_share_pct FROM h CROSS JOIN s"""))
def top_deals_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 deals and their share of committed value (FDI view)."""
    return R.top_deals_share(R.lock_finance_type(projects(spark, sf_dir), INVESTMENT_TYPE), 20)


@register("longest_implementation", ["G5", "B18", "B17"], with_projects("""
SELECT project_id, project_name, province, status,
       CAST(date_diff('day', approval_date, operation_date) AS INTEGER) AS time_to_implementation_days,
       round(disbursed_usd / nullif(committed_usd, 0), 6) AS realization_rate
FROM projects ORDER BY time_to_implementation_days DESC NULLS LAST, project_id LIMIT 20"""))
def longest_implementation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 longest implementation durations."""
    return R.longest_implementation(projects(spark, sf_dir), 20)


RANKING_SQL = """
WITH v AS (""" + EXPOSURE_FRICTION_SQL + """)
SELECT * FROM v ORDER BY status_risk_index DESC NULLS LAST, province LIMIT 15"""


@register("risk_ranking_top15", ["G6", "E10"], with_projects(RANKING_SQL))
def risk_ranking_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 15 provinces by status risk index."""
    return R.risk_ranking(projects(spark, sf_dir), 15)


@register("timeline_by_period", ["B10", "E44"], with_projects("""
SELECT CAST(date_trunc('year', coalesce(approval_date, make_date(CAST(year AS BIGINT), 1, 1))) AS DATE) AS period,
       count(*) AS projects
FROM projects WHERE coalesce(approval_date, make_date(CAST(year AS BIGINT), 1, 1)) IS NOT NULL GROUP BY 1"""))
def timeline_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects per year of the plotting date."""
    return R.timeline_by_period(projects(spark, sf_dir))


@register("counts_with_unknown", ["E45"], with_projects("""
SELECT 'sector' AS dimension, coalesce(sector, 'Unknown') AS value, count(*) AS projects FROM projects GROUP BY 2
UNION ALL
SELECT 'status', coalesce(status, 'Unknown'), count(*) FROM projects GROUP BY 2"""))
def counts_with_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector and status counts with an Unknown bucket."""
    return R.counts_with_unknown(projects(spark, sf_dir))


@register("coordinate_validity", ["C8", "E46"], with_projects("""
SELECT count(*) AS projects,
       count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS with_coordinates,
       round(100.0 * avg(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1.0 ELSE 0.0 END), 6)
         AS coordinate_coverage_pct,
       count(*) FILTER (WHERE latitude BETWEEN -90 AND 90) AS browser_mappable
FROM projects"""))
def coordinate_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate coverage under the dashboard and browser rules."""
    return R.coordinate_validity(projects(spark, sf_dir))


FALLBACK_SQL = """
g AS (SELECT 100.0 * avg(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1.0 ELSE 0.0 END) AS pct
      FROM p),
h AS (SELECT project_id, coalesce(project_name, 'Unnamed Project') AS project_name, finance_type, year,
             committed_usd, coalesce(status, 'Unknown') AS status
      FROM p ORDER BY committed_usd DESC NULLS LAST, project_id LIMIT 20)
SELECT h.* FROM h CROSS JOIN g WHERE g.pct < 40"""


@register("fallback_top_projects", ["C13", "G4"], with_projects(f"WITH p AS ({COORDINATE_POOR_SQL})," + FALLBACK_SQL))
def fallback_top_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-20 projects view, shown as this slice has too few coordinates for
    the map."""
    return R.fallback_top_projects(coordinate_poor(projects(spark, sf_dir)))


@register("yearly_trend_by_approval", ["E13", "R1"], with_projects(f"""
WITH p AS ({YEARLESS_SQL}),
y AS (SELECT year(approval_date) AS year, sum(committed_usd) AS committed_usd, sum(disbursed_usd) AS disbursed_usd
      FROM p WHERE approval_date IS NOT NULL GROUP BY 1)
SELECT CAST(year AS INTEGER) AS year, 'committed_usd' AS metric, committed_usd AS usd FROM y
UNION ALL SELECT CAST(year AS INTEGER), 'disbursed_usd', disbursed_usd FROM y"""))
def yearly_trend_by_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly trend of a slice without years: approval years stand in."""
    return R.yearly_trend_long(yearless(projects(spark, sf_dir)))
